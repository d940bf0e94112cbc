"""Pairing of the clauses of two drafts."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from lexloom.functions import rules as R
from lexloom.functions import text as T


def _pairs(texts: list[str], labels: list[str | None], first: int) -> list[tuple]:
    """(a, b, base, score, identical, matched) of the pairs that share a term; the ``first`` texts, in lower case, are draft a's.

    A pair is matched if each is the other's best and the similarity is not too small; ties go to the lower place.
    """
    counts = [Counter(T.stems(low)) for low in texts]
    squares = [sum(n * n for n in c.values()) for c in counts]
    holders: dict[str, list[tuple[int, int]]] = {}
    for b, c in enumerate(counts[first:], first):
        for term, n in c.items():
            holders.setdefault(term, []).append((b, n))
    rows, best_a, best_b = {}, {}, {}
    for a in range(first):
        dots: dict[int, int] = {}
        for term, n in counts[a].items():
            for b, m in holders.get(term, ()):
                dots[b] = dots.get(b, 0) + n * m
        for b, dot in dots.items():
            base = T.rounded(dot / math.sqrt(float(squares[a] * squares[b])))
            same = labels[a] is not None and labels[a] == labels[b]
            score = T.rounded(min(1.0, base + (R.LABEL_BONUS if same else 0.0)))
            rows[a, b] = (base, score)
            if a not in best_a or (-score, b) < best_a[a]:
                best_a[a] = (-score, b)
            if b not in best_b or (-score, a) < best_b[b]:
                best_b[b] = (-score, a)
    out = []
    for (a, b), (base, score) in rows.items():
        matched = best_a[a][1] == b and best_b[b][1] == a and score >= R.MIN_SIMILARITY
        identical = matched and _WORD.findall(texts[a]) == _WORD.findall(texts[b])
        out.append((a, b - first, base, score, identical, matched))
    return out


_WORD = re.compile("[a-z0-9]+")
_NAMES = ("a", "b", "base", "score", "identical", "matched")


_PAIR = StructType([StructField(n, t) for n, t in zip(_NAMES, (IntegerType(), IntegerType(), DoubleType(), DoubleType(), BooleanType(), BooleanType()), strict=True)])


@F.arrow_udf(ArrayType(_PAIR))
def _compared(lows: pa.Array, labels: pa.Array, first: pa.Array) -> pa.Array:
    kind = pa.struct(list(zip(_NAMES, (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()), strict=True)))
    ends, rows = [0], []
    for texts, names, n in zip(lows.to_pylist(), labels.to_pylist(), first.to_pylist(), strict=True):
        rows += _pairs(texts, names, n)
        ends.append(len(rows))
    columns = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
    flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, _a, _b): both drafts' clauses in one row for each document."""
    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "label", "text"))).alias(name))

    none = F.array().cast("array<struct<idx:int,label:string,text:string>>")
    return side(a, "_a").join(side(b, "_b"), key, "full").withColumns({c: F.coalesce(c, none) for c in ("_a", "_b")})


def _compare(a: DataFrame, b: DataFrame | None, key: str) -> DataFrame:
    """(key, _a, _b, _p): the pairs by place beside both drafts' clauses.

    A document's words are compared where they are; rows for each word would be some two hundred times the documents.  With b
    None, ``a`` is as ``sides`` makes it, here and below: drafts that come in one row are neither taken apart nor joined.
    """
    rows = a if b is None else sides(a, b, key)
    both = F.concat("_a", "_b")
    compared = _compared(F.transform(both, lambda c: F.lower(F.coalesce(c["text"], F.lit("")))), F.transform(both, lambda c: c["label"]), F.size("_a"))
    return rows.withColumn("_p", compared)


def similarities(a: DataFrame, b: DataFrame | None, key: str) -> DataFrame:
    """(key, idx_a, idx_b, base, score) of the clause pairs that share a term."""
    rows = _compare(a, b, key).select(key, "_a", "_b", F.explode_outer("_p").alias("p")).where("p is not null")
    return rows.select(key, F.get("_a", F.col("p.a"))["idx"].alias("idx_a"), F.get("_b", F.col("p.b"))["idx"].alias("idx_b"), "p.base", "p.score")


def _matches(compared: DataFrame, key: str) -> DataFrame:
    rows = compared.select(key, "_a", "_b", F.explode_outer(F.filter("_p", lambda p: p["matched"])).alias("p")).where("p is not null")
    rows = rows.select(key, F.get("_a", F.col("p.a")).alias("a"), F.get("_b", F.col("p.b")).alias("b"), "p")
    return rows.select(key, F.col("a.idx").alias("idx_a"), F.col("b.idx").alias("idx_b"), F.col("p.score").alias("similarity"), "p.identical", F.col("a.text").alias("text_a"), F.col("b.text").alias("text_b"))


def pairs(a: DataFrame, b: DataFrame | None, key: str) -> DataFrame:
    """(key, idx_a, idx_b, similarity, identical): clauses that are each other's best, from the least similarity on."""
    return _matches(_compare(a, b, key), key)


def alone(a: DataFrame, b: DataFrame | None, key: str, side: str) -> DataFrame:
    """(key, idx, label, text): the clauses of a side, a or b, that no clause of the other is paired with."""
    left = _left(F.col(f"_{side}"), side)
    return _compare(a, b, key).select(key, F.explode_outer(left).alias("c")).where("c is not null").select(key, "c.*")


def _left(clauses: Column, side: str) -> Column:
    taken = F.transform(F.filter("_p", lambda p: p["matched"]), lambda p: p[side])
    return F.filter(clauses, lambda c, i: ~F.array_contains(taken, i))


def differences(a: DataFrame, b: DataFrame | None, key: str, limit: int = R.MAX_DIFFERENCES) -> DataFrame:
    """(key, kind, idx_a, idx_b, similarity, text_a, text_b, n): changed pairs, then removed, then added clauses; the first ``limit``."""
    def entry(kind: str, x: Column | None, y: Column | None, similarity: Column) -> Column:
        idx = lambda c: F.lit(None).cast("int") if c is None else c["idx"]
        text = lambda c: F.lit("") if c is None else c["text"]
        return F.struct(F.lit(kind).alias("kind"), idx(x).alias("idx_a"), idx(y).alias("idx_b"), similarity.alias("similarity"), text(x).alias("text_a"), text(y).alias("text_b"))

    rows = _compare(a, b, key)
    # Pairs by place are pairs by index; each clause of a is in one pair at most.
    changed = F.array_sort(F.transform(F.filter("_p", lambda p: p["matched"] & ~p["identical"]), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), p["score"].alias("score"))))
    changed = F.transform(changed, lambda p: entry("changed", F.get("_a", p["a"]), F.get("_b", p["b"]), p["score"]))
    gone = F.transform(_left(F.col("_a"), "a"), lambda c: entry("only-in-a", c, None, F.lit(0.0)))
    new = F.transform(_left(F.col("_b"), "b"), lambda c: entry("only-in-b", None, c, F.lit(0.0)))
    listed = rows.select(key, F.posexplode_outer(F.slice(F.concat(changed, gone, new), 1, limit)).alias("n", "d")).where("d is not null")
    return listed.select(key, "d.*", (F.col("n") + 1).alias("n"))
