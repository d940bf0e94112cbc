"""Reports over validated analyses (doc, idx, label, risk, grounded, ask, obligations, heading, plain)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import rules as R
from lexloom.functions import text as T


def weight(risk: Column) -> Column:
    return F.coalesce(*(F.when(risk == r, F.lit(w)) for r, w in R.RISK_WEIGHT.items()), F.lit(0))


def score(raw: Column) -> Column:
    return F.when(raw == 0, 0).otherwise(F.round(F.lit(100) * raw / (raw + R.SATURATION))).cast("long")


def summary(analyses: DataFrame, doc: str) -> DataFrame:
    """(doc, clauses, ungrounded, high, medium, low, info, score) in one aggregation."""
    raw = F.sum(F.when(F.col("grounded"), weight(F.col("risk"))).otherwise(0))
    counts = [F.count_if(F.col("risk") == r).alias(r) for r in R.RISK_WEIGHT]
    return analyses.groupBy(doc).agg(F.count("*").alias("clauses"), F.count_if(~F.col("grounded")).alias("ungrounded"), *counts, score(raw).alias("score"))


def band(value: Column) -> Column:
    return F.coalesce(*(F.when(value >= low, F.lit(n)) for low, n in R.SCORE_BANDS))


def read_first(analyses: DataFrame, doc: str, limit: int = R.READ_FIRST) -> DataFrame:
    rows = analyses.where(F.col("grounded") & (weight(F.col("risk")) > 0))
    order = Window.partitionBy(doc).orderBy(weight(F.col("risk")).desc(), "idx")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(doc, "rank", "idx", "risk")


def obligations(analyses: DataFrame, doc: str) -> DataFrame:
    """Each duty once, at its first clause; those with a date first."""
    rows = analyses.where("grounded").select(doc, "idx", F.posexplode("obligations").alias("pos", "o")).select(doc, "idx", "pos", "o.*").where(T.trim(F.col("what")) != "")
    first = Window.partitionBy(doc, F.concat("who", F.lit("|"), T.dedupe_key(F.col("what")))).orderBy("idx", "pos")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    order = Window.partitionBy(doc).orderBy(F.when(F.col("when").isNotNull(), 0).otherwise(1), "idx", "pos")
    return rows.select(doc, F.row_number().over(order).alias("rank"), "idx", "who", "what", "when", "quote")


def questions(analyses: DataFrame, doc: str, limit: int = R.MAX_QUESTIONS) -> DataFrame:
    rows = analyses.where(F.col("grounded") & (weight(F.col("risk")) > 0)).withColumn("ask", T.trim(F.col("ask"))).where("ask <> ''")
    by = [weight(F.col("risk")).desc(), F.col("idx")]
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(doc, T.dedupe_key(F.col("ask"))).orderBy(*by))).where("n = 1")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy(*by))).where(F.col("rank") <= limit).select(doc, "rank", "idx", "ask")


def step_kind(text: Column) -> Column:
    return F.coalesce(*(F.when(text.rlike("(?i)" + p), F.lit(k)) for k, p in R.STEP_RULES))


def type_steps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, n, s) for t, steps in R.TYPE_STEPS.items() for n, s in enumerate(steps)], "doc_type string, n int, step string")


def next_steps(analyses: DataFrame, types: DataFrame, doc: str) -> DataFrame:
    """(doc, rank, kind, idx, step): one per rule that a severe clause meets first, then those of the document's type."""
    rows = analyses.where(F.col("grounded") & F.col("risk").isin("high", "medium"))
    rows = rows.withColumn("kind", step_kind(F.concat_ws(" ", "heading", "plain"))).where("kind is not null")
    by = [F.when(F.col("risk") == "high", 0).otherwise(1), F.col("idx")]
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(doc, "kind").orderBy(*by))).where("n = 1")
    own = rows.select(doc, F.lit(0).alias("o"), by[0].alias("r"), "idx", "kind", F.lit(None).cast("string").alias("step"))
    # A constant table of some ten rows.
    more = types.join(F.broadcast(type_steps(analyses.sparkSession)), "doc_type").select(doc, F.lit(1).alias("o"), F.col("n").alias("r"), F.lit(None).cast("int").alias("idx"), F.lit("document-type").alias("kind"), "step")
    order = Window.partitionBy(doc).orderBy("o", "r", "idx")
    return own.unionByName(more).select(doc, F.row_number().over(order).alias("rank"), "kind", "idx", "step")


def document_report(analyses: DataFrame, clauses: DataFrame, types: DataFrame, doc: str) -> DataFrame:
    """One row per document: the summary and the sizes of its lists. All parts are keyed by doc and share its partitioning."""
    from lexloom.operators.consistency import inconsistencies

    count = lambda rows, name: rows.groupBy(doc).agg(F.count("*").alias(name))
    out = summary(analyses, doc).join(types, doc, "left")
    first = read_first(analyses, doc).groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "idx"))), lambda x: x["idx"].cast("string")), ",").alias("read_first"))
    parts = [first, count(obligations(analyses, doc), "obligations"), count(questions(analyses, doc), "questions"), count(next_steps(analyses, types, doc), "steps")]
    terms = inconsistencies(clauses, [doc]).groupBy(doc).agg(F.count_distinct("kind").alias("inconsistencies"))
    for part in (*parts, terms):
        out = out.join(part, doc, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("obligations", "questions", "steps", "inconsistencies")}
    return out.withColumns(zero).withColumn("read_first", F.coalesce("read_first", F.lit(""))).withColumn("band", band(F.col("score")))


def verdict(differences: DataFrame, key: str) -> DataFrame:
    """(key, better, worse, same, favours) of differences (direction, grounded)."""
    counted = F.col("grounded") | (F.col("direction") == "no-material-change")
    n = lambda d: F.count_if(counted & (F.col("direction") == d))
    rows = differences.groupBy(key).agg(n("better-for-you").alias("better"), n("worse-for-you").alias("worse"), n("no-material-change").alias("same"))
    return rows.withColumn("favours", F.when(F.col("worse") > F.col("better"), "a").when(F.col("better") > F.col("worse"), "b"))


#: What a comparison comes to, in this package's words, by the side it favours.
VERDICTS = {"a": "The first draft treats you better.", "b": "The second draft treats you better.", "same": "Both drafts say the same.", "open": "Neither draft is better for you."}


def verdict_sentence(favours: Column, differences: Column) -> Column:
    return F.when(favours == "a", VERDICTS["a"]).when(favours == "b", VERDICTS["b"]).when(differences == 0, VERDICTS["same"]).otherwise(VERDICTS["open"])


#: Words for display, in this package's wording.
RISK_WORDS = {"high": "serious", "medium": "worth a question", "low": "minor", "info": "for information"}
DIRECTION_WORDS = {"better-for-you": "better for you", "worse-for-you": "worse for you", "no-material-change": "no real change"}


def shown_as(value: Column, words: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(value == k, F.lit(w)) for k, w in words.items()), value)


def clause_name(label: Column, idx: Column) -> Column:
    """A clause's own label, else its place counted from 1."""
    return F.coalesce(label, (idx + 1).cast("string"))


def difference_order(differences: DataFrame, key: str) -> DataFrame:
    rank = F.when(F.col("direction") == "worse-for-you", 0).when(F.col("direction") == "better-for-you", 1).otherwise(2)
    return differences.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(rank, F.coalesce("idx_a", "idx_b"), "kind", "idx_b")))


def clause_filter(analyses: DataFrame, doc: str, mode: str) -> DataFrame:
    """(doc, idx, shown, total): clauses a view shows; mode is all, obligations or a list of risks."""
    if mode == "all":
        seen = F.lit(True)
    elif mode == "obligations":
        seen = F.size("obligations") > 0
    else:
        seen = F.col("risk").isin(*mode.split(","))
    by = Window.partitionBy(doc)
    rows = analyses.select(doc, "idx", seen.alias("seen"))
    return rows.withColumn("shown", F.count_if("seen").over(by)).withColumn("total", F.count("*").over(by)).where("seen").drop("seen")


def progress(done: DataFrame, doc: str) -> DataFrame:
    """(doc, done, expected): when progress is told, at each quarter and at the end."""
    rows = done.withColumn("done", F.row_number().over(Window.partitionBy(doc).orderBy("idx"))).withColumn("expected", F.count("*").over(Window.partitionBy(doc)))
    return rows.where((F.col("done") == F.col("expected")) | (F.col("done") % F.greatest(F.lit(1), F.ceil(F.col("expected") / 4)) == 0)).select(doc, "done", "expected")
