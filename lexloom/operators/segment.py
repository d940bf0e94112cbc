"""Splitting a normalised document into clauses with offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import rules as R
from lexloom.functions import text as T


def family(text: Column) -> Column:
    """Number of the marker family that splits a text: the first with two markers, else the first with the most; -1 if none has any."""
    counts = [F.regexp_count(text, F.lit(T.java(p))) for _, p in R.MARKERS]
    two = F.coalesce(*(F.when(c >= 2, F.lit(n)) for n, c in enumerate(counts)))
    one = F.coalesce(*(F.when(c >= 1, F.lit(n)) for n, c in enumerate(counts)))
    return F.coalesce(two, one, F.lit(-1))


def markers(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, family, n): the family that a text is split by and how many markers it has."""
    kind = family(F.col(text))
    count = F.lit(0)
    for n, (_, p) in enumerate(R.MARKERS):
        count = F.when(F.col("f") == n, F.regexp_count(F.col(text), F.lit(T.java(p)))).otherwise(count)
    name = F.coalesce(*(F.when(F.col("f") == n, F.lit(m)) for n, (m, _) in enumerate(R.MARKERS)))
    return docs.select(*keys, text, kind.alias("f")).select(*keys, name.alias("family"), count.cast("long").alias("n"))


def spans(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, pos, label, body, start): pieces from marker to marker, or paragraphs where a text has less than two markers."""
    # The character that marks cuts is put aside, where a text has it, and put back in the pieces.
    docs = docs.select(*keys, F.when(F.col(text).contains("\x01"), F.translate(text, "\x01", "\uffff")).otherwise(F.col(text)).alias("_t")).withColumn("_f", family(F.col("_t")))
    marked, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (name, p) in enumerate(R.MARKERS):
        flags, _, rest = T.java(p).partition(")")
        marked = F.when((F.col("_f") == n) & (F.regexp_count("_t", F.lit(T.java(p))) >= 2), F.regexp_replace("_t", T.java(p), "\x01$0")).otherwise(marked)
        head = F.regexp_extract("body", f"{flags})^{rest.removeprefix('^')}".replace('(?=[A-Z"(“])', ""), 0 if name == "word-headed" else 1)
        label = F.when(F.col("_f") == n, head).otherwise(label)
    docs = docs.withColumn("_m", marked)
    parts = F.when(F.col("_m").isNotNull(), F.split("_m", "\x01", -1)).otherwise(F.split(F.regexp_replace("_t", "\n\n+", "\x01$0"), "\x01", -1))
    rows = docs.select(*keys, "_f", F.col("_m").isNotNull().alias("numbered"), F.posexplode_outer(parts).alias("pos", "raw")).where("pos is not null").withColumn("raw", F.when(F.col("raw").contains("\uffff"), F.translate("raw", "\uffff", "\x01")).otherwise(F.col("raw")))
    order = Window.partitionBy(*keys).orderBy("pos")
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("raw")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # A paragraph starts after the line ends before it; a preamble must be longer than the shortest clause.
    lead = F.when(~F.col("numbered"), F.length(F.regexp_extract("raw", "^(\n*)", 1))).otherwise(0)
    rows = rows.withColumn("start", (F.col("at") + lead).cast("int")).withColumn("body", T.trim(F.col("raw")))
    rows = rows.where(~(F.col("numbered") & (F.col("pos") == 0) & (F.length("raw") <= R.MIN_CLAUSE))).where("body <> ''")
    bare = F.regexp_replace(T.trim(label), "[.):—-]+$", "")
    named = F.when(F.col("numbered") & (F.col("pos") > 0) & (bare != ""), bare)
    return rows.select(*keys, "pos", named.alias("label"), "body", "start")


def merged(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Appends pieces under the shortest clause length to the one before them, the first excepted."""
    order = Window.partitionBy(*keys).orderBy("pos")
    own = (F.length("body") >= R.MIN_CLAUSE) | (F.row_number().over(order) == 1)
    grouped = pieces.withColumn("own", own.cast("int")).withColumn("part", F.sum("own").over(order))
    rows = F.array_sort(F.collect_list(F.struct("pos", "body", "label", "start")))
    out = grouped.groupBy(*keys, "part").agg(rows.alias("rows"))
    return out.select(*keys, "part", F.col("rows")[0]["label"].alias("label"), F.array_join(F.transform("rows", lambda r: r["body"]), "\n").alias("body"), F.col("rows")[0]["start"].alias("start"))


def packed(body: Column, start: Column, limit: int = R.MAX_CLAUSE) -> Column:
    """(text, start) pieces of a clause beyond the limit: whole paragraphs, as many as fit; a single longer one stays whole."""
    zero = F.struct(F.array().cast("array<struct<text:string,start:int>>").alias("done"), F.lit("").alias("buf"), start.alias("at"), start.alias("cursor"))

    def step(a: Column, p: Column) -> Column:
        chunk = F.concat(p, F.lit("\n\n"))
        full = (a["buf"] != "") & (F.length(a["buf"]) + F.length(chunk) > limit)
        done = F.when(full, F.concat(a["done"], F.array(F.struct(T.trim(a["buf"]).alias("text"), a["at"].alias("start"))))).otherwise(a["done"])
        return F.struct(done.alias("done"), F.when(full, chunk).otherwise(F.concat(a["buf"], chunk)).alias("buf"), F.when(full, a["cursor"]).otherwise(a["at"]).alias("at"), (a["cursor"] + F.length(chunk)).alias("cursor"))

    rest = lambda a: F.when(T.trim(a["buf"]) != "", F.concat(a["done"], F.array(F.struct(T.trim(a["buf"]).alias("text"), a["at"].alias("start"))))).otherwise(a["done"])
    whole = F.array(F.struct(body.alias("text"), start.alias("start")))
    return F.when(F.length(body) <= limit, whole).otherwise(F.aggregate(F.split(body, "\n\n", -1), zero, step, rest))


def clauses(docs: DataFrame, keys: list[str], text: str = "text", limit: int = R.MAX_CLAUSES) -> DataFrame:
    """(keys, idx, label, text, start, end): the first ``limit`` clauses of each normalised text."""
    rows = merged(spans(docs, keys, text), keys).withColumn("start", F.col("start").cast("int"))
    rows = rows.select(*keys, "part", "label", F.posexplode_outer(packed(F.col("body"), F.col("start"))).alias("piece", "p")).where("piece is not null")
    order = Window.partitionBy(*keys).orderBy("part", "piece")
    rows = rows.withColumn("idx", F.row_number().over(order) - 1).where(F.col("idx") < limit)
    return rows.select(*keys, "idx", F.when(F.col("piece") == 0, F.col("label")).alias("label"), F.col("p.text").alias("text"), F.col("p.start").alias("start"), (F.col("p.start") + F.length("p.text")).alias("end"))
