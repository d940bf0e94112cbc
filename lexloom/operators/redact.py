"""Replacement of personal identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import rules as R
from lexloom.functions import text as T


#: What every match of a kind holds.
NEEDS = {"EMAIL": "@", "PAN": "[0-9]{4}[A-Z]", "IFSC": "[A-Z]{4}0", "PHONE": "[6-9][0-9]{9}", "ACCOUNT": "[Aa](?:/[Cc]|[Cc]{2}[Oo][Uu][Nn][Tt])"}
_NEEDS_ID = "[0-9]{4}[^A-Za-z0-9_]?[0-9]{4}[^A-Za-z0-9_]?[0-9]{4}"


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces ``text`` and adds a count for each kind, n_<kind>, in the order of the rules."""
    found = F.regexp_extract_all(F.col(text), F.lit(T.java(R.CHECKED_ID)), F.lit(0))
    valid = F.filter(found, lambda x: T.verhoeff(F.regexp_replace(x, "[^0-9]", "")))
    docs = docs.withColumn("_ids", F.when(F.col(text).rlike(_NEEDS_ID), valid).otherwise(F.array().cast("array<string>")))
    # A valid id is replaced wherever it stands as a whole word; equal digits are equally valid.
    fold = F.aggregate(F.array_distinct("_ids"), F.col(text), lambda t, x: F.regexp_replace(t, F.concat(F.lit("(?<![A-Za-z0-9_])\\Q"), x, F.lit("\\E(?![A-Za-z0-9_])")), F.lit("[REDACTED:AADHAAR]")))
    docs = docs.withColumn("n_aadhaar", F.size("_ids").cast("long")).withColumn(text, F.when(F.size("_ids") > 0, fold).otherwise(F.col(text))).drop("_ids")
    for kind, pattern in R.REDACTIONS:
        # A cheap look first: most texts hold nothing that the pattern could match.
        may = F.col(text).contains(NEEDS[kind]) if len(NEEDS[kind]) == 1 else F.col(text).rlike(NEEDS[kind])
        docs = docs.withColumn("_may", F.coalesce(may, F.lit(False)))
        docs = docs.withColumn(f"n_{kind.lower()}", F.when(F.col(text).isNull(), None).when(F.col("_may"), F.regexp_count(F.col(text), F.lit(T.java(pattern)))).otherwise(0).cast("long"))
        docs = docs.withColumn(text, F.when(F.col("_may"), F.regexp_replace(text, T.java(pattern), f"[REDACTED:{kind}]")).otherwise(F.col(text))).drop("_may")
    return docs


KINDS = ("aadhaar", *(k.lower() for k, _ in R.REDACTIONS))


def total() -> Column:
    return sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col(f"n_{KINDS[0]}"))
