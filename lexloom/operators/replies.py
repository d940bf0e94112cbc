"""Model replies: untrusted JSON, read, checked against the text and reduced to what verifies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import rules as R
from lexloom.functions import text as T
from lexloom.operators.grounding import verified

CLAUSE = "struct<heading:string,plain:string,risk:string,why:string,ask:string,quote:string,obligations:array<struct<who:string,what:string,when:string,quote:string>>>"
ANSWER = "struct<answered:string,answer:string,quote:string,clauseIndex:string>"
DIFFERENCE = "struct<heading:string,summary:string,direction:string,quoteA:string,quoteB:string>"


def object_text(reply: Column) -> Column:
    """The JSON object in a reply, or in the ``response`` that it wraps."""
    inner = lambda x: F.when(x.contains('"response"'), F.coalesce(_object_in(F.get_json_object(x, "$.response")), x)).otherwise(x)
    return T.let(_object_in(reply), inner)


def _object_in(reply: Column) -> Column:
    """A reply without code fences, else from the first brace to the last; null if neither parses."""
    opened = lambda x: F.when(x.startswith("```"), F.regexp_replace(x, f"(?i)^```(?:json)?[{R.WS}]*", "")).otherwise(x)
    closed = lambda x: F.when(x.endswith("```"), F.rtrim(F.substring(x, F.lit(1), F.length(x) - 3), F.lit(R.WS_CHARS))).otherwise(x)
    between = lambda x: T.let(F.regexp_extract(x, r"(?s)\{.*\}", 0), lambda y: F.when(F.try_parse_json(y).isNotNull(), y))
    # Text that starts like no JSON value is not tried as a whole, as a failure costs more than a look.
    whole = lambda x: x.rlike('^[\\[{"0-9tfn-]') & F.try_parse_json(x).isNotNull()
    return T.let(T.trim(reply), lambda r: T.let(opened(r), lambda o: T.let(closed(o), lambda x: F.when(whole(x), F.when(x.startswith("{"), x)).otherwise(between(x)))))


def analyses(rows: DataFrame, reply: str = "reply", text: str = "text") -> DataFrame:
    """Validated analysis columns for rows with a clause and a reply; a claim whose quote is not in the clause has no weight."""
    rows = rows.withColumn("_r", F.from_json(object_text(F.col(reply)), CLAUSE))
    r = F.col("_r")
    risk = F.lower(T.capped(r["risk"], 12))
    rows = rows.withColumn("quote", T.capped(r["quote"], 800)).withColumn("_folded", T.folded(F.col(text)))
    rows = rows.withColumn("grounded", verified(F.col("quote"), F.col(text), F.col("_folded")))
    kept = F.transform(
        F.slice(F.coalesce(r["obligations"], F.array().cast("array<struct<who:string,what:string,when:string,quote:string>>")), 1, R.MAX_OBLIGATIONS),
        lambda o: F.struct(F.when(T.capped(o["who"], 20).isin("you", "other-party", "both"), T.capped(o["who"], 20)).otherwise("you").alias("who"), T.capped(o["what"], 300).alias("what"), F.nullif(T.capped(o["when"], 120), F.lit("")).alias("when"), T.capped(o["quote"], 400).alias("quote")),
    )
    kept = F.filter(kept, lambda o: (o["what"] != "") & verified(o["quote"], F.col(text), F.col("_folded")))
    heading = T.capped(r["heading"], 80)
    rows = rows.withColumns({
        "heading": F.when(heading == "", "Clause").otherwise(heading), "plain": T.capped(r["plain"], 1200), "why": T.capped(r["why"], 600), "ask": T.capped(r["ask"], 300),
        "risk": F.when(F.col("grounded") & risk.isin(*R.RISK_WEIGHT), risk).otherwise("info"),
        "obligations": F.when(F.col("grounded"), kept).otherwise(F.array().cast("array<struct<who:string,what:string,when:string,quote:string>>")),
    })
    return rows.drop("_r", "_folded")


def first_parsed(rows: DataFrame, replies: dict[str, str], out: str = "reply") -> DataFrame:
    """The first reply, in the order given, that holds an object: ``out`` and ``source``, the name it came under, or nulls and none."""
    named = lambda name: lambda x: F.when(x.isNotNull(), F.struct(F.lit(name).alias("source"), x.alias("text")))
    # A later reply is read only where the earlier ones hold no object.
    first = F.coalesce(*(T.let(object_text(F.col(column)), named(name)) for name, column in replies.items()))
    rows = rows.withColumn("_first", first)
    return rows.withColumn("source", F.coalesce("_first.source", F.lit("none"))).withColumn(out, F.col("_first.text")).drop("_first")


#: What stands where no provider gave a readable reply, in this package's words.
NO_REPLY = {"heading": "Not analysed", "plain": "No reply could be read for this clause."}


def analysed(rows: DataFrame, replies: dict[str, str], text: str = "text") -> DataFrame:
    """``analyses`` of the first readable of several replies (cache, provider, second provider); a placeholder where none is.

    ``keep`` tells what may be written to the cache: grounded replies that did not come from it.
    """
    rows = analyses(first_parsed(rows, replies), "reply", text)
    for name, words in NO_REPLY.items():
        rows = rows.withColumn(name, F.when(F.col("source") == "none", words).otherwise(F.col(name)))
    return rows.withColumn("keep", F.col("grounded") & ~F.col("source").isin("cache", "none"))


def explained(rows: DataFrame, replies: dict[str, str]) -> DataFrame:
    """``difference`` of the first readable of several replies; a placeholder where none is."""
    rows = difference(first_parsed(rows, replies), "reply")
    return rows.withColumn("heading", F.when(F.col("source") == "none", NO_REPLY["heading"]).otherwise(F.col("heading")))


def run_statistics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, clauses, cache_hits, model_calls, fallback_calls) of rows (keys, source); a clause without a reply has asked the first model."""
    n = lambda *names: F.count_if(F.col("source").isin(*names))
    return rows.groupBy(*keys).agg(F.count("*").alias("clauses"), n("cache").alias("cache_hits"), n("primary", "none").alias("model_calls"), n("fallback").alias("fallback_calls"))


def difference(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """Validated difference columns for rows (kind, text_a, text_b, reply): both sides must verify for a direction to count."""
    rows = rows.withColumn("_r", F.from_json(object_text(F.col(reply)), DIFFERENCE))
    qa, qb = T.capped(F.col("_r.quoteA"), 600), T.capped(F.col("_r.quoteB"), 600)
    ok_a = F.when(F.col("text_a") == "", qa == "").otherwise(verified(qa, F.col("text_a")))
    ok_b = F.when(F.col("text_b") == "", qb == "").otherwise(verified(qb, F.col("text_b")))
    rows = rows.withColumn("grounded", ok_a & ok_b)
    direction = T.capped(F.col("_r.direction"), 24)
    heading = T.capped(F.col("_r.heading"), 80)
    return rows.withColumns({
        "direction": F.when(F.col("grounded") & direction.isin(*R.DIRECTIONS), direction).otherwise("no-material-change"),
        "heading": F.when(heading == "", "Changed term").otherwise(heading), "summary": T.capped(F.col("_r.summary"), 800),
        "quote_a": F.when(F.col("grounded"), qa).otherwise(""), "quote_b": F.when(F.col("grounded"), qb).otherwise(""),
    }).drop("_r")


def provided(rows: DataFrame, provider: Callable[..., list[str | None]], prompt: str, out: str = "reply", pool: int = 10, task: str | None = None) -> DataFrame:
    """Adds a provider's replies to prompts, ``pool`` calls at a time in each task; a failed call leaves a null.

    With a task, the provider is told its most tokens and its temperature.
    """
    settings = {} if task is None else dict(zip(("max_tokens", "temperature"), R.MODEL[task], strict=True))
    schema = rows.withColumn(out, F.lit(None).cast("string")).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        def ask(text: str) -> str | None:
            try:
                return provider([text], **settings)[0]
            except Exception:
                return None

        with ThreadPoolExecutor(pool) as threads:
            for part in parts:
                yield part.assign(**{out: list(threads.map(ask, part[prompt]))})

    return rows.mapInPandas(run, schema)
