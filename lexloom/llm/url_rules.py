"""URL filtering by association rules.

Labelled pages become transactions of URL tokens (host labels, path parts, query keys) and, for
pages that are toxic or of low quality, a label item.  FP-growth mines frequent token
combinations; rules that imply the label are kept from ``CONFIDENCE`` and ``SUPPORT`` on, and a
rule counts only if at least ``LEAST`` labelled pages bear it out.  Single tokens are counted by a
plain aggregation, so that ``LEAST`` pages bear out a rule of one token however many pages are
labelled; ``SUPPORT`` binds combinations only.  Rules are matched through an
inverted index: each is listed under its rarest token, URLs look their tokens up there, and a
listed rule fires if the URL has all its tokens.  Fixed (host, path) rules come before mined ones.

Everything is DataFrame and SQL functions and the JVM's FP-growth; there is no Python in the data path.

Defined results: a null URL, or one without ``://``, has empty host, path and tokens, fits no
rule and is allowed; labels of a repeated id count as bad if any of them is; without labelled bad
pages nothing is mined and the method allows; repeated rows get equal results.  Among fired rules
the one with the highest confidence, then the fewest tokens, then the first by code point is told.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import core

CONFIDENCE = 0.7
SUPPORT = 0.0005
LEAST = 10
BAD = "label:bad"
#: (host, path, verdict) of the rules that come before mined ones.
FIXED = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, rest): host lower-cased in A-Z only, path up to ? or #."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(rest, r"^[^?#]*(?s:(.*))", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path, tail


def tokens(host: Column, path: Column, tail: Column) -> Column:
    """Distinct tokens, marked by the part of the URL they stand in."""

    def marked(mark: str, text: Column, cut: str) -> Column:
        return F.transform(F.filter(F.split(text, cut), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    keys = F.regexp_extract_all(tail, F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    return F.array_distinct(F.concat(marked("host:", host, r"\."), marked("path:", F.lower(path), r"[^\p{L}\p{N}]+"), F.transform(keys, lambda x: F.concat(F.lit("query:"), x))))


def fixed_rule(host: Column, path: Column, rules=FIXED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; nulls if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def bad_ids(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.col("doc_id").alias("id")).agg(F.coalesce(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)), F.lit(False)).alias("bad"))


def mine(transactions: DataFrame, confidence: float = CONFIDENCE, support: float = SUPPORT, least: int = LEAST) -> DataFrame:
    """Rules (antecedent, confidence, support, key) from rows (tokens, bad); key is the rarest token of the antecedent."""
    spark = transactions.sparkSession
    count = transactions.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    none = spark.createDataFrame([], "antecedent array<string>, confidence double, support double, key string")
    if count["bad"] < least:
        return none
    items = transactions.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items")).where(F.size("items") > 0)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / count["n"])), minConfidence=confidence).fit(items)
    rules = model.associationRules.where((F.col("consequent") == F.array(F.lit(BAD))) & (F.size("antecedent") > 1)).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq").alias("n"))
    key = rules.withColumn("token", F.explode("antecedent")).join(single, "token").groupBy("antecedent", "confidence", "support").agg(F.min(F.struct("n", "token")).alias("rare"))
    seen = transactions.select(F.explode("tokens").alias("token"), "bad").groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    alone = seen.where((F.col("bad") >= least) & (F.col("bad") / F.col("n") >= confidence))
    alone = alone.select(F.array("token").alias("antecedent"), (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / count["n"]).alias("support"), F.col("token").alias("key"))
    return core.stored(key.select("antecedent", "confidence", "support", F.col("rare.token").alias("key")).unionByName(alone))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, why, confidence) of the distinct urls (url, tokens) on which a rule fires."""
    listed = urls.withColumn("key", F.explode("tokens")).join(rules, "key")
    fired = listed.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), F.size("antecedent").alias("n"), F.concat_ws(" ", "antecedent").alias("why"))).alias("best")
    return fired.groupBy("url").agg(best).select("url", F.col("best.why").alias("why"), (-F.col("best.c")).alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules=FIXED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, the mined rule that fired and its confidence."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path, tail = split_url(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path, "tail": tail})
    marked = rows.where("url is not null").select("page_id", "url", tokens(F.col("host"), F.col("path"), F.col("tail")).alias("tokens"))
    told = bad_ids(labels)
    mined = mine(marked.join(told, marked["page_id"] == told["id"]).select("tokens", "bad"))
    hits = match(marked.select("url", "tokens").dropDuplicates(["url"]), mined)
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    joined = rows.join(hits, "url", "left")
    return joined.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("why").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "why", "confidence")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(core.documents(spark, sf_dir, "pages"), core.documents(spark, sf_dir, "labels"))
