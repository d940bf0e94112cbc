"""Document fingerprints: one-permutation MinHash with optimal densification, in SQL functions.

Every five-word shingle (all words of a shorter text) is hashed once; the leading bits of the
hash name its bin, and each bin keeps its smallest hash.  An empty bin takes the value of the
first non-empty bin in its own random sequence of bins, the same for all documents; after
``PROBES`` probes the smallest of a seeded hash over the non-empty bins stands in, which is that
sequence's limit.  The low ``BITS`` bits of each bin are packed.  Likeness is the share of
equal bins, corrected for the ``2**-BITS`` chance that different values agree.

Defined results: null texts are empty; texts without words have the fingerprint of no shingle
(all zero bits), likeness 1 to each other and 0 to others; rows that share an id or have none (these come first) follow each other in the order
of hashes of their texts, and a single row is its own next document; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm import core

WORDS = 5
BINS = 128
BITS = 8
PROBES = 24
#: Bytes of text in a range of ids that is ordered on its own, and the most ranges that are cut.
RANGE = 1 << 22
RANGES = 1 << 16


def _sequences(bins: int, probes: int) -> list[list[int]]:
    """probes lists of one random bin for each bin, from a fixed seed."""
    draw = random.Random(20)
    return [[draw.randrange(bins) for _ in range(bins)] for _ in range(probes)]


def _literal(values: Iterable) -> Column:
    """An array of constants, in one expression."""
    return F.expr(f"array({', '.join(map(str, values))})")


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """63-bit hashes of the text's shingles."""
    found = F.filter(F.split(text, "[ \\x09-\\x0D]+"), lambda w: w != "")
    codes = F.transform(found, lambda w: F.xxhash64(w))

    def shingles(c: Column) -> Column:
        full = F.transform(F.sequence(F.lit(0), F.size(c) - words), lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(c, i + j) for j in range(words))), 1))
        short = F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(c.cast("array<string>"), " ")), 1))
        return F.when(F.size(c) >= words, full).when(F.size(c) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return codes, shingles


def with_fingerprint(rows: DataFrame, text: str, out: str, words: int = WORDS, bins: int = BINS, bits: int = BITS, probes: int = PROBES) -> DataFrame:
    """Adds ``out``: the low bits of each bin as an array, or null for a text without words."""
    codes, shingles = shingle_hashes(F.col(text), words)
    shift = 63 - (bins - 1).bit_length()
    marks = _literal(((b + 1) << shift) - 1 for b in range(bins))
    rows = rows.withColumn("_codes", codes).withColumn("_hashes", shingles(F.col("_codes"))).drop("_codes")
    # With each bin's largest hash mixed in, the first of every bin in order is its smallest; the mark itself says empty.
    rows = rows.withColumn("_sorted", F.sort_array(F.concat("_hashes", marks)))
    first = F.filter("_sorted", lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(F.col("_sorted"), i - 1), shift)))
    rows = rows.withColumn("_full", F.size("_hashes") > 0).drop("_hashes").withColumn("_least", first).drop("_sorted")
    mark = F.lit((1 << shift) - 1)
    rows = rows.withColumn("_bins", F.transform("_least", lambda x: F.when(x.bitwiseAND(mark) == mark, F.lit(None).cast("bigint")).otherwise(x))).drop("_least")
    own = F.col("_bins")
    tables = [_literal(t) for t in _sequences(bins, probes)]

    def fill(i: Column) -> Column:
        rest = F.filter(own, lambda x: x.isNotNull())
        last = F.array_min(F.transform(rest, lambda x: F.struct(F.xxhash64(i, F.shiftright(x, shift)).alias("o"), x.alias("x"))))["x"]
        return F.coalesce(F.get(own, i), *(F.get(own, F.get(t, i)) for t in tables), last)

    dense = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: fill(i).bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))
    return rows.withColumn(out, F.when(F.col("_full"), dense)).drop("_bins", "_full")


def packed(fingerprint: Column, bins: int = BINS, bits: int = BITS) -> Column:
    digits = _literal(f"'{x:0{bits // 4}x}'" for x in range(1 << bits))
    return F.coalesce(F.array_join(F.transform(fingerprint, lambda x: F.get(digits, x)), ""), F.lit("0" * (bins * bits // 4)))


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity, corrected for chance agreement of the kept bits and clipped to 0..1."""
    chance = 2.0**-bits
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(bins))
    both = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same - chance) / (1 - chance)))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(both)


def _cuts(rows: DataFrame, id_col: str, text_col: str, size: int) -> list[int]:
    """Quantiles of the ids, repeated where one id fills several ranges of about ``size`` bytes."""
    total = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = min(RANGES, -(-total // size))
    if ranges < 2:
        return []
    return rows.agg(F.percentile_approx(id_col, [i / ranges for i in range(1, ranges)], max(10000, 4 * ranges))).first()[0] or []


def _range_of(cuts: list[int], key: Column, hashed: Column) -> Column:
    """Number of a row's range, in the order of ids and, within an id that fills several, of hashes."""
    limits = sorted(set(cuts))
    step = max(1, math.isqrt(len(limits)))
    parts = [limits[i : i + step] for i in range(0, len(limits), step)]
    if not limits:
        return F.lit(0).cast("long")
    below = lambda values: F.size(F.filter(values, lambda c: c < key))
    # The last limit of each part, then the limits of one part.
    part = below(_literal(x[-1] for x in parts).cast("array<bigint>"))
    inner = F.get(_literal(f"array({', '.join(map(str, x))})" for x in parts).cast("array<array<bigint>>"), part)
    place = part * step + F.when(part < len(parts), below(inner)).otherwise(0)
    often = {v: n for v, n in Counter(cuts).items() if n > 1}
    if not often:
        return F.shiftleft(place.cast("long"), 32)
    at = F.array_position(_literal(often).cast("array<bigint>"), key)
    share = (F.shiftright(hashed, 32) + F.lit(1 << 31)) / F.lit(float(1 << 32))
    inside = F.when(at > 0, 1 + F.floor(share * F.get(_literal(often.values()), (at - 1).cast("int")))).otherwise(0)
    return F.shiftleft(place.cast("long"), 32) + inside


def with_next(rows: DataFrame, id_col: str, columns: list[str], enrich: Callable[[DataFrame], DataFrame], size: int = RANGE) -> DataFrame:
    """``enrich(rows)`` with next_<c> of the following row by id, the first row's for the last.

    Ids are cut at quantiles into ranges, as many as the volume of the first column's text asks for; each is ordered
    on its own, ended by a copy of the row that opens the next one.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("_hash", F.xxhash64(columns[0]))
    placed = rows.withColumn("_range", _range_of(_cuts(rows, id_col, columns[0], size), F.col(id_col), F.col("_hash")))
    heads = placed.groupBy("_range").agg(F.min(F.struct(id_col, "_hash")).alias("head")).collect()  # one row for each range
    heads = sorted((r["_range"], *r["head"]) for r in heads)
    follow = [(r, *heads[(k + 1) % len(heads)][1:]) for k, (r, *_) in enumerate(heads)]
    opening = F.broadcast(spark.createDataFrame(follow, "_range bigint, _id bigint, _h bigint"))  # no more rows than ranges
    ends = rows.join(opening, (F.col(id_col) == F.col("_id")) & (F.col("_hash") == F.col("_h"))).select(*rows.columns, "_range", F.lit(1).alias("_end"))
    both = enrich(placed.select(*rows.columns, "_range", F.lit(0).alias("_end")).unionByName(ends))
    window = Window.partitionBy("_range").orderBy("_end", id_col, "_hash", columns[0])
    lead = F.lead(F.struct(*columns)).over(window)
    return both.withColumn("_next", lead).where("_end = 0").drop("_range", "_end", "_hash").select("*", *(F.col(f"_next.{c}").alias(f"next_{c}") for c in columns)).drop("_next")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = RANGE) -> DataFrame:
    """doc_id, text, edited and the fingerprints (arrays of bins) of the text, the edited text and the next document's text."""
    rows = docs.select(core.key(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", ["text", "bins"], lambda r: with_fingerprint(r, "text", "bins"), size)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).drop("next_text")
    return with_fingerprint(rows, "edited", "edited_bins")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints(core.documents(spark, sf_dir))
    return rows.select(
        *core.shown("doc_id"), F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
