"""Vectorised text kernels and shared-storage helpers used by the corpus operators.

A *word* is a maximal run of bytes outside space and TAB..CR of the UTF-8 text, compared
byte for byte.  Kernels work on whole texts, a bounded number of bytes at a time, so that
a worker holds a few arrays over about ``CHUNK`` bytes (or over one longer text).
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.cluster import ship

CHUNK = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_WORD = ~_SPACE


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers for a seed."""
    start = np.uint64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & MASK)
    return mix(start + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


BYTE_CODE = seeded(1, 256)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, kind: str = "up") -> np.ndarray:
    """BASE**i (or its inverse) modulo 2**64 for i < n; tables over one chunk are kept."""
    have = _POWERS[kind]
    if len(have) < n:
        step = np.full(max(n, CHUNK + 1024), BASE if kind == "up" else INVERSE, np.uint64)
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        if len(have) <= 4 * CHUNK:
            _POWERS[kind] = have
    return have[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] the position-scaled polynomial hash of buf[i:j]."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODE[buf] * powers(len(buf)), out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of spans, independent of where they stand."""
    return (h[end] - h[start]) * powers(len(h), "down")[start]


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    if col.null_count and np.diff(offs)[col.is_null().to_numpy(zero_copy_only=False)].any():
        # Spark writes nulls without bytes; others need not.
        return buffers(col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b""))
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def chunks(col, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows holding about ``limit`` bytes, never less than one row: (first, past, bytes, offsets)."""
    data, offs = buffers(col)
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, to, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def spans(flag: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of set bytes that do not cross row borders."""
    if not len(flag):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = flag.copy()
    first[1:] &= ~flag[:-1]
    last = flag.copy()
    last[:-1] &= ~flag[1:]
    full = np.diff(offs) > 0
    edge = offs[:-1][full]
    first[edge] = flag[edge]
    edge = offs[1:][full] - 1
    last[edge] = flag[edge]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


#: Longer words are hashed one by one.
LONG = 256
_LEADING = np.array([(1 << 8 * n) - 1 for n in range(8)] + [MASK], np.uint64)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of each word; words are hashed eight bytes at a time, all words together."""
    start, end = spans((buf != 0x20) & (buf - np.uint8(0x09) > 4), offs)
    size = end - start
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded.data, strides=(1,))
    code = size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    code = mix(code + (eight[start] & _LEADING[np.minimum(size, 8)]) * np.uint64(BASE))
    live = np.flatnonzero((size > 8) & (size <= LONG))
    at = 8
    while len(live):
        code[live] = mix(code[live] * _STEP[1] + (eight[start[live] + at] & _LEADING[np.minimum(size[live] - at, 8)]) * np.uint64(BASE))
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        code[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]], digest_size=8).digest(), "little")
    return code, np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(start, offs))), start, end


_STEP = [np.uint64(pow(0x100000001B3 | 1, k, 1 << 64)) for k in range(64)]


def shingles(code: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, bounds): hashes of k-word shingles by row; a row of 1 to k-1 words has one shingle of all its words."""
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    n = len(code)
    if n >= k:
        full = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            full += code[j : n - k + 1 + j] * _STEP[j]
        ok = row[: n - k + 1] == row[k - 1 :]
        full, owner = mix(full[ok]), row[: n - k + 1][ok]
    else:
        full, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.array([sum(int(code[first[r] + j]) * int(_STEP[j]) for j in range(count[r])) + int(count[r]) * 0x51ED27 & MASK for r in short], np.uint64)
        full, owner = np.concatenate([full, mix(extra)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        full, owner = full[order], owner[order]
    return full, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])


def shingle_sets(col, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row), chunk by chunk."""
    for at, to, buf, offs in chunks(col):
        code, row, _, _ = words(buf, offs)
        full, bound = shingles(code, row, to - at, k)
        yield at, [np.unique(full[bound[i] : bound[i + 1]]) for i in range(to - at)]


def set_key(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed numbers."""
    a = mix(values + np.uint64(0x1B873593)).sum(dtype=np.uint64) + np.uint64(len(values))
    b = mix(values ^ np.uint64(0xE6546B64A5A5A5A5)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder name in the cluster's shared spark.checkpoint.dir; a temporary one only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lexloom-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query that has ended are removed: its result is written and needs them no more."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives the loss of executors."""
    path = shared_folder(df.sparkSession)
    with released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Stands for a null id inside the operators, so that joins keep its rows.
NO_ID = -(1 << 63)


def key(column: str) -> Column:
    """The id column as a long that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def shown(*columns: str) -> list[Column]:
    """Id columns with nulls put back."""
    return [F.nullif(F.col(c), F.lit(NO_ID)).alias(c) for c in columns]


def release() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with this package at hand on every executor; workers, which live on, give unused memory back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    ship(df.sparkSession)
    return df.mapInArrow(task, schema)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

