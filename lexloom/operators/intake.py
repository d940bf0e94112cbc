"""Validation of documents, questions and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import rules as R
from lexloom.functions import text as T


def document_error(text: Column) -> Column:
    n = F.length(T.trim(text))
    return F.when(text.isNull(), "missing").when(n < R.MIN_TEXT, "too_short").when(n > R.MAX_TEXT, "too_long")


def question(text: Column) -> Column:
    return T.one_spaced(text)


def question_error(text: Column) -> Column:
    n = F.length(question(text))
    return F.when(text.isNull(), "missing_question").when(n < R.MIN_QUESTION, "question_too_short").when(n > R.MAX_QUESTION, "question_too_long")


def doc_type(value: Column) -> Column:
    """An accepted type, else null, so that the document gets classified."""
    return F.when(value.isin(*R.DOC_TYPES), value)


def classified(reply: Column) -> Column:
    """The first type that a reply mentions."""
    word = F.lower(T.trim(reply))
    return F.coalesce(*(F.when(word.contains(t), F.lit(t)) for t in R.DOC_TYPES), F.lit("other"))


def label(value: Column, fallback: str) -> Column:
    short = F.substring(T.one_spaced(value), 1, 60)
    return F.coalesce(F.when(short != "", short), F.lit(fallback))


def rate_limited(requests: DataFrame, client: str, ts: str, key: str, limit: int = R.RATE_LIMIT, seconds: int = R.RATE_SECONDS) -> DataFrame:
    """Adds ``allowed``: among the first ``limit`` requests of a client in its tumbling window."""
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)).cast("long")
    order = Window.partitionBy(client, slot).orderBy(ts, key)
    return requests.withColumn("allowed", F.row_number().over(order) <= limit)


def status(content_type: Column, fetch_site: Column, allowed: Column) -> Column:
    """HTTP status of the guard's checks, in their order."""
    json = F.coalesce(F.lower(content_type).startswith("application/json"), F.lit(False))
    own = fetch_site.isNull() | fetch_site.isin("same-origin", "none")
    return F.when(~json, 415).when(~own, 403).when(~allowed, 429).otherwise(200)
