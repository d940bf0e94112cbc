"""Mixing of sources to target word counts by entropy balancing.

Each source has one constraint: the words taken from it equal its target.  Of all document
rates that meet it and stay within 0 and ``CAP``, those closest to 1 in relative entropy are
exponentially tilted, rate = min(CAP, exp(lambda * size / mean size)).  The dual in lambda is
convex; Newton steps, kept within a bracket, solve it for all sources at once over the
histogram of sizes, a table that does not grow with copies.  Rates are then rounded into whole
copies: within a source, documents are dealt into parts by hash and each part diffuses its
rounding error from its longest document to its shortest.

Targets: the sources, in code point order with null last, have the weights in turn; ``TOTAL`` times
all words is shared by weight, no target is above ``CAP`` times its source's words, and what is
cut off goes to the others by weight.

Defined results: null and empty texts have size 0 and take 0; null is a source of its own;
repeated rows are rounded one by one; an empty table gives an empty result; a source without
words has target 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm import core

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL = 1.5
CAP = 2.0
#: Documents of one source rounded together.
PART = 8192
STEPS = 80
LIMIT = 700.0
CLOSE = 1e-10


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """(source, source_size, n_docs, target) of rows (source, size)."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # The table of sources is small against the documents; its running sums need one order.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    held = by.withColumn("w", weight).withColumn("most", cap * F.col("source_size"))
    # Sources reach their caps in the order of cap to weight; those before the water line are full.
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    held = held.withColumn("all", F.sum("source_size").over(whole) * F.lit(total)).withColumn("level", (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    held = held.withColumn("open", F.col("w") * F.col("level") < F.col("most"))
    first_open = F.min(F.when(F.col("open"), F.col("most") / F.col("w"))).over(whole)
    level = F.max(F.when(F.col("open") & (F.col("most") / F.col("w") == first_open), F.col("level"))).over(whole)
    full = F.col("line").isNull() | (F.col("w") * F.col("line") >= F.col("most"))
    held = held.withColumn("line", level)
    return held.select("source", "source_size", "n_docs", F.when(full, F.col("most")).otherwise(F.col("w") * F.col("line")).alias("target"))


def rate(size: Column, mean: Column, tilt: Column, cap: float = CAP) -> Column:
    return F.when(F.col("full"), F.lit(cap)).otherwise(F.least(F.lit(cap), F.exp(F.least(F.lit(LIMIT), tilt * size / mean))))


def balance(sizes: DataFrame, wanted: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, source_size, n_docs, target, mean, full, tilt): Newton on the dual of each source."""
    histogram = core.stored(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    mean = F.when(F.col("n_docs") > 0, F.col("source_size") / F.col("n_docs"))
    state = wanted.withColumn("mean", F.greatest(mean, F.lit(1e-9))).withColumn("full", F.col("target") >= cap * F.col("source_size") * (1 - 1e-12))
    state = core.stored(state.withColumn("tilt", F.lit(0.0)).withColumn("low", F.lit(-LIMIT)).withColumn("high", F.lit(LIMIT)).withColumn("done", F.col("full") | (F.col("target") <= 0)))
    for _ in range(STEPS):
        if not state.where(~F.col("done")).limit(1).count():
            break
        s = state.alias("s")
        at = rate(F.col("h.size"), F.col("s.mean"), F.col("s.tilt"), cap)
        joined = histogram.alias("h").join(s.where("not done"), F.col("h.source").eqNullSafe(F.col("s.source")))
        taken = (at * F.col("h.size") * F.col("h.n")).alias("taken")
        slope = F.when(at < cap, at * F.col("h.size") * F.col("h.size") / F.col("s.mean") * F.col("h.n")).otherwise(F.lit(0.0)).alias("slope")
        sums = joined.select(F.col("s.source").alias("key"), taken, slope).groupBy("key").agg(F.sum("taken").alias("taken"), F.sum("slope").alias("slope"))
        step = state.join(sums, F.col("source").eqNullSafe(F.col("key")), "left").drop("key")
        gap = F.col("taken") - F.col("target")
        step = step.withColumn("low", F.when(~F.col("done") & (gap < 0), F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(~F.col("done") & (gap >= 0), F.col("tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") - gap / F.col("slope")
        inside = F.col("slope").isNotNull() & (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        close = F.abs(gap) <= F.lit(CLOSE) * F.col("target")
        narrow = F.col("high") - F.col("low") < F.lit(1e-13) * F.greatest(F.lit(1.0), F.abs("tilt"))
        done = F.col("done") | close | narrow
        # Sums over rows may differ in their last bits from run to run; a rounded tilt does not.
        tilt = F.when(done, F.col("tilt")).otherwise(F.round(F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2), 12))
        state = core.stored(step.withColumn("next", tilt).withColumn("done", F.coalesce(done, F.lit(True))).drop("tilt", "taken", "slope").withColumnRenamed("next", "tilt"))
    return state.drop("low", "high", "done")


def diffuse(size: np.ndarray, rates: np.ndarray, cap: float = CAP) -> np.ndarray:
    """Whole copies of documents given longest first; each is rounded up or down to bring the words taken so far nearest to those wanted."""
    copies = np.zeros(len(size), np.int64)
    owed = 0.0
    for i, (s, r) in enumerate(zip(size.tolist(), rates.tolist(), strict=True)):
        if not s:
            continue
        low = int(r)
        want = owed + r * s
        n = low + (1 if low < r and want - low * s > 0.5 * s else 0)
        copies[i] = min(n, int(cap))
        owed = want - copies[i] * s
    return copies


def _round(cap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        ids, size, rates = (table.column(c).to_numpy() for c in ("key", "size", "rate"))
        order = np.lexsort([ids, -size])
        copies = np.zeros(len(size), np.int64)
        copies[order] = diffuse(size[order], rates[order], cap)
        out = table.select(["doc_id", "size", "source_size", "target"]).append_column("taken", pa.array(copies * size)).append_column("rate", table.column("rate"))
        yield from out.to_batches()

    return run


def mix(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken and the rate that was rounded."""
    # Rows that share an id or have none are told apart, and dealt, by their texts.
    sizes = core.stored(docs.select(core.key(id_col).alias("doc_id"), F.xxhash64(core.key(id_col), F.col(text_col)).alias("key"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")))
    state = balance(sizes, targets(sizes, weights, total, cap), cap)
    joined = sizes.alias("d").join(state.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    rows = joined.select("d.doc_id", "d.key", F.col("d.source").alias("source"), "d.size", "source_size", "target", rate(F.col("d.size"), F.col("mean"), F.col("tilt"), cap).alias("rate"), F.ceil(F.col("n_docs") / F.lit(PART)).alias("parts"))
    # Large sources are rounded in parts of bounded size.
    rows = rows.withColumn("dealt", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.pmod(F.xxhash64("key"), F.col("parts"))))
    core.ship(docs.sparkSession)
    out = rows.groupBy("dealt").applyInArrow(_by_table(cap), "doc_id long, size long, source_size long, target double, taken long, rate double")
    return out.withColumn("doc_id", *core.shown("doc_id"))


def _by_table(cap: float):
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_round(cap)(iter(table.to_batches()))))

    return run


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(core.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
