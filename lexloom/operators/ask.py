"""Answers to questions, allowed to stand only on quotes that verify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators.grounding import ranked_first, salvage
from lexloom.operators.replies import ANSWER, object_text


def grounded(rows: DataFrame, reply: str = "reply", consulted: str = "consulted", out: str = "found") -> DataFrame:
    """Adds ``out``, a struct (answered, cited_idx, quote, answer), to rows with a reply and an array of consulted clauses (idx, rank, text).

    The cited clause is tried first, then the others by rank; the first in which the quote, or a run of its sentences, verifies is the citation.
    """
    rows = rows.withColumn("_o", object_text(F.col(reply)))
    rows = rows.withColumn("_r", F.from_json("_o", ANSWER))
    # The word counts as yes, the boolean as true; the word true does not.
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("_o"), "$.answered", "variant"))
    claimed = (F.col("_r.answered") == "yes") | (F.col("_r.answered") == "true") & (kind == "BOOLEAN")
    rows = rows.withColumns({"_claimed": F.coalesce(claimed, F.lit(False)), "_answer": T.capped(F.col("_r.answer"), 1200), "_quote": T.capped(F.col("_r.quote"), 800), "_cited": F.expr("try_cast(_r.clauseIndex as int)")})
    order = F.array_sort(F.transform(consulted, lambda c: F.struct(F.when(c["idx"] == F.col("_cited"), 0).otherwise(1).alias("o"), c["rank"].alias("rank"), c["idx"].alias("idx"), c["text"].alias("text"))))
    tried = F.transform(order, lambda c: F.struct(c["idx"].alias("idx"), salvage(F.col("_quote"), c["text"]).alias("quote")))
    asked = F.col("_claimed") & (F.col("_quote") != "")
    rows = rows.withColumn("_first", F.when(asked, F.get(F.filter(tried, lambda t: t["quote"] != ""), F.lit(0))))
    stands = F.col("_first").isNotNull()
    answer = F.when(stands | (F.col("_answer") != "") & ~asked, F.col("_answer")).otherwise("")
    rows = rows.withColumn(out, F.struct(stands.alias("answered"), F.col("_first.idx").alias("cited_idx"), F.coalesce("_first.quote", F.lit("")).alias("quote"), answer.alias("answer")))
    return rows.drop("_o", "_r", "_claimed", "_answer", "_quote", "_cited", "_first")


def grounded_answers(replies: DataFrame, consulted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, answered, cited_idx, quote, answer): ``grounded`` for replies (keys, reply) and consulted clauses (keys, idx, rank, text)."""
    lists = consulted.groupBy(*keys).agg(F.collect_list(F.struct("idx", "rank", "text")).alias("consulted"))
    return grounded(replies.join(lists, keys, "left")).select(*keys, "found.*")


def best(*found: Column) -> Column:
    """Of several grounded answers the first that stands; else the first honest no, whose answer is kept; else the first."""
    order = lambda f: F.when(f["answered"], 0).when(f["answer"] != "", 1).otherwise(2)
    return F.array_min(F.array(*(F.struct(order(f).alias("o"), F.lit(n).alias("n"), f.alias("found")) for n, f in enumerate(found))))["found"]


def best_of(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Of two providers' grounded answers the first that stands; else the first honest no, whose answer is kept; else the first that is there."""
    both = first.withColumn("o", F.lit(0)).unionByName(second.withColumn("o", F.lit(1)))
    return ranked_first(both, keys, F.when(F.col("answered"), 0).when(F.col("answer") != "", 1).otherwise(2), F.col("o")).drop("o")
