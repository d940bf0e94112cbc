"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a ``WINDOW``-byte string covers it that also starts at some other place, in the
same or another document; matches never cross documents.

Which places can hold equal windows is found by anchors: of the ``GRAM``-byte strings in a
window the one with the smallest hash (leftmost on ties) is the window's anchor, so equal
windows have equal anchors at equal distances, and windows next to each other mostly share one.
An anchor occurrence with all windows that it serves is a *context*, identified by a cryptographic 128-bit digest of its bytes.
Anchors that occur once are dropped.  Contexts of equal bytes that occur more than once are repeated as a
whole.  Contexts that occur once, but whose anchor has others, are resolved: their windows are
sorted as suffixes, by a mergesort that compares two suffixes through prefix polynomial hashes
and a binary search for their common extension, and neighbours that agree over a window are
verified byte by byte.  An anchor with more than ``HOT`` different contexts is split first, by
the bytes that blocks of its windows have in common.

Defined results: null texts are empty; texts under a window lose nothing of their own; repeated
rows are places of their own, so they lose all that windows cover; rows that share an id or have
none are told apart by 64-bit hashes of their texts; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import core
from lexloom.llm.jaccard_join import _grouped

WINDOW = 200
GRAM = 24
HOT = 4096
#: Distances from window start to anchor in a block of a split anchor.
BLOCK = 22
#: Bytes of contexts resolved together, unless one group has more.
HELD = 1 << 19
#: Places in a buffer; longer texts than this Arrow does not hold.
_PLACE = np.uint64((1 << 31) - 1)


def anchors(buf: np.ndarray, offs: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(row, first window, last window, anchor, anchor hash) for the runs of windows that share an anchor."""
    count = np.maximum(0, np.diff(offs) - window + 1)
    if not count.sum():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    h = core.prefix_hash(buf)
    n = len(buf) - gram + 1
    code = core.mix((h[gram:] - h[:n]) * core.powers(n, "down"))
    wide = window - gram + 1
    value = np.full(-(-n // wide) * wide + wide, np.iinfo(np.uint64).max, np.uint64)
    value[:n] = code & ~_PLACE | np.arange(n, dtype=np.uint64)
    tiles = value.reshape(-1, wide)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    row = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(row)) + np.repeat(offs[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    least = (np.minimum(behind[start], ahead[start + wide - 1]) & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])]))
    last = start[np.concatenate([new[1:], [len(start)]]) - 1]
    first, at, row = start[new], least[new], row[new]
    return row, first, last, at, code[at]


def digests(buf: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Two numbers for each context: 128 bits that stand for its bytes."""
    data = memoryview(np.ascontiguousarray(buf))
    out = b"".join(hashlib.blake2b(data[a:z], digest_size=16).digest() for a, z in zip(first.tolist(), (last + window).tolist(), strict=True))
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, _, buf, offs in core.chunks(batch.column(2)):
                row, first, last, anchor, code = anchors(buf, offs, window)
                if len(row):
                    digest = digests(buf, first, last, window)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(code.view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(ids[at + row], pa.int64()), pa.array(parts[at + row], pa.int64()),
                        pa.array((first - offs[row]).astype(np.int32)), pa.array((last - first).astype(np.int32)), pa.array((anchor - first).astype(np.int32)),
                    ], names=["h", "c", "d", "doc_id", "part", "start", "run", "left"])

    return run


def _codes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offs in core.chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(buf, offs, window)[4].view(np.int64))], names=["h"])

    return run


def extension(h: np.ndarray, down: np.ndarray, p: np.ndarray, q: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common extension of the suffixes at p and q, up to ``limit``, by binary search over prefix hashes."""
    low = np.zeros(len(p), np.int64)
    high = np.full(len(p), limit, np.int64)
    same = (h[p + limit] - h[p]) * down[p] == (h[q + limit] - h[q]) * down[q]
    low[same] = limit
    todo = np.flatnonzero(~same)
    high[todo] = limit - 1
    while len(todo):
        mid = (low[todo] + high[todo] + 1) // 2
        a, b = p[todo], q[todo]
        same = (h[a + mid] - h[a]) * down[a] == (h[b + mid] - h[b]) * down[b]
        low[todo] = np.where(same, mid, low[todo])
        high[todo] = np.where(same, high[todo], mid - 1)
        todo = todo[low[todo] < high[todo]]
    return low


def suffix_order(buf: np.ndarray, h: np.ndarray, place: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Order of places, given sorted by group, by their first ``limit`` bytes within each group: a merge sort whose
    merges rank all elements of sibling runs at once, each by a binary search with hash-compared suffixes."""
    n = len(place)
    down = core.powers(len(h), "down")
    order = np.arange(n)
    begin = np.searchsorted(group, group, "left")
    size = np.searchsorted(group, group, "right") - begin
    run = 1
    while True:
        live = np.flatnonzero(size > run)
        if not len(live):
            return order
        inner = live - begin[live]
        pair = inner // run
        left = pair % 2 == 0
        other = begin[live] + np.where(left, pair + 1, pair - 1) * run
        stop = begin[live] + size[live]
        low = np.minimum(other, stop)
        high = np.minimum(other + run, stop)
        base = low.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            mid = (low[todo] + high[todo]) // 2
            p, q = place[order[live[todo]]], place[order[mid]]
            common = extension(h, down, p, q, limit)
            tied = common == limit
            step = np.where(tied, 0, common)
            before = np.where(tied, ~left[todo], buf[q + step] < buf[p + step])  # the sibling's element goes first
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
            todo = todo[low[todo] < high[todo]]
        target = np.where(left, live, live - run) + (low - base)
        merged = order.copy()
        merged[target] = order[live]
        order = merged
        run *= 2


def repeated(buf: np.ndarray, place: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Which windows (places sorted by group) equal another one of their group."""
    h = core.prefix_hash(buf)
    code = core.mix(core.span_hash(h, place, place + window) + group.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    # Windows whose hash nothing shares have no equal and need no sorting.
    _, kind, count = np.unique(code, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[kind] > 1)
    out = np.zeros(len(place), bool)
    if len(some):
        order = some[suffix_order(buf, h, place[some], group[some], window)]
        near = np.flatnonzero((group[order[1:]] == group[order[:-1]]) & (extension(h, core.powers(len(h), "down"), place[order[1:]], place[order[:-1]], window) == window))
        for at in range(0, len(near), 8192):
            part = near[at : at + 8192]
            a, b = order[part], order[part + 1]
            span = np.arange(window)
            same = (buf[place[a][:, None] + span] == buf[place[b][:, None] + span]).all(1)
            out[a[same]] = True
            out[b[same]] = True
    return out


def _contexts(window: int, block: int):
    """doc_id, part, text, asked -> the asked contexts' bytes; those of hot anchors by blocks of distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, part, text = (batch.column(c)[i].as_py() for c in range(3))
                data = (text or "").encode()
                rows: dict[str, list] = {k: [] for k in CONTEXT.names}
                for x in batch.column(3)[i].as_py():
                    low, high = x["left"] - x["run"], x["left"]
                    anchor = x["start"] + x["left"]
                    cuts = [(low, high, -1)] if not x["hot"] else [(max(low, b * block), min(high, b * block + block - 1), b) for b in range(low // block, high // block + 1)]
                    for a, z, b in cuts:
                        core_bytes = b"" if b < 0 else data[anchor - b * block : anchor - (b * block + block - 1) + window]
                        sub = 0 if b < 0 else int.from_bytes(hashlib.blake2b(core_bytes, digest_size=8).digest(), "little", signed=True)
                        for k, v in zip(rows, (x["h"], b, sub, key, part, anchor - z, z - a, z, x["once"], data[anchor - z : anchor - a + window]), strict=True):
                            rows[k].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=CONTEXT)

    return run


CONTEXT = pa.schema([("h", pa.int64()), ("block", pa.int32()), ("sub", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("start", pa.int32()), ("run", pa.int32()), ("left", pa.int32()), ("once", pa.bool_()), ("bytes", pa.binary())])
CONTEXT_DDL = "h long, block int, sub long, doc_id long, part long, start int, run int, left int, once boolean, bytes binary"


def _resolve(window: int):
    def solve(held: list[pa.RecordBatch], number: np.ndarray) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(held).combine_chunks()
        data, offs = core.buffers(table.column("bytes"))
        data, offs = data[offs[0] : offs[-1]], offs - offs[0]
        run, left = table.column("run").to_numpy(), table.column("left").to_numpy()
        start, once = table.column("start").to_numpy(), table.column("once").to_numpy()
        count = run + 1
        row = np.repeat(np.arange(len(run)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        # Equal windows stand at equal distances from the anchor.
        group = number[row].astype(np.int64) * (window + 1) + left[row] - step
        order = np.argsort(group, kind="stable")
        hit = np.zeros(len(row), bool)
        hit[order] = repeated(data, (offs[row] + step)[order], group[order], window)
        hit &= once[row]
        row, at = row[hit], start[row[hit]] + step[hit]
        if not len(row):
            return None
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > at[:-1] + window)]))
        last = np.concatenate([new[1:], [len(row)]]) - 1
        ids, part = table.column("doc_id").to_numpy(), table.column("part").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(ids[row[new]], pa.int64()), pa.array(part[row[new]], pa.int64()), pa.array(at[new].astype(np.int32)), pa.array((at[last] + window).astype(np.int32))], names=["doc_id", "part", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, size, groups = [], [], 0, 0
        for _, rows in _grouped(batches, 3):
            n = sum(r.num_rows for r in rows)
            if n == 1:
                continue
            held += rows
            number.append(np.full(n, groups))
            groups += 1
            size += sum(r.column(9).nbytes for r in rows)
            if size >= HELD:
                if (out := solve(held, np.concatenate(number))) is not None:
                    yield out
                held, number, size, groups = [], [], 0, 0
        if held and (out := solve(held, np.concatenate(number))) is not None:
            yield out

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")}
        size = 0
        for i in range(batch.num_rows):
            data = (batch.column(1)[i].as_py() or "").encode()
            found = sorted((x["from"], x["to"]) for x in batch.column(2)[i].as_py() or ())
            kept, at, gone, runs, end = [], 0, 0, 0, -1
            for s, e in found:
                if s > end:
                    runs += 1
                    kept.append(data[at:s])
                if e > end:
                    gone += e - max(s, end)
                    at = end = e
            kept.append(data[at:])
            for k, v in zip(out, (batch.column(0)[i].as_py(), len(data), gone, runs, b"".join(kept)), strict=True):
                out[k].append(v)
            size += len(data)
            if size >= core.CHUNK:
                yield pa.RecordBatch.from_pydict(out, schema=REMOVED)
                out, size = {k: [] for k in out}, 0
        yield pa.RecordBatch.from_pydict(out, schema=REMOVED)


REMOVED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def intervals(rows: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(doc_id, part, from, to): byte ranges covered by repeated windows, for rows (doc_id, part, text)."""
    places = core.arrow(rows, _anchors(window), "h long, c long, d long, doc_id long, part long, start int, run int, left int")
    # Tables of one row for each anchor are stored before they are joined, so that a hot anchor's places can be split.
    often = core.stored(core.arrow(rows.select("text"), _codes(window), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    places = core.stored(places.join(often.hint("merge"), "h"))
    kind = ["h", "c", "d", "run", "left"]
    kinds = core.stored(places.groupBy(*kind).agg(F.count("*").alias("n"), F.first("doc_id").alias("doc_id"), F.first("part").alias("part"), F.first("start").alias("start")))
    whole = places.join(kinds.where("n > 1").select(*kind).hint("merge"), kind).select("doc_id", "part", F.col("start").alias("from"), (F.col("start") + F.col("run") + window).alias("to"))
    mixed = core.stored(kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single")).where("kinds > 1 and single > 0").select("h", (F.col("kinds") > hot).alias("hot")))
    asked = kinds.join(mixed.hint("merge"), "h").groupBy("doc_id", "part").agg(F.collect_list(F.struct("h", "start", "run", "left", (F.col("n") == 1).alias("once"), "hot")).alias("asked"))
    contexts = core.arrow(rows.dropDuplicates(["doc_id", "part"]).join(asked, ["doc_id", "part"]).select("doc_id", "part", "text", "asked"), _contexts(window, BLOCK), CONTEXT_DDL)
    parted = core.arrow(contexts.repartition("h", "block", "sub").sortWithinPartitions("h", "block", "sub", "doc_id", "part", "start"), _resolve(window), "doc_id long, part long, from int, to int")
    return whole.unionByName(core.stored(parted))


def dedup(docs: DataFrame, window: int = WINDOW, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans and the bytes that stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Rows that share an id are told apart by their texts.
    rows = docs.select(core.key(id_col).alias("doc_id"), F.xxhash64(text).alias("part"), text.alias("text"))
    # Repeated rows have the same intervals, each once.
    found = intervals(rows, window, hot).groupBy("doc_id", "part").agg(F.collect_set(F.struct("from", "to")).alias("found"))
    out = core.arrow(rows.join(found, ["doc_id", "part"], "left").select("doc_id", "text", "found"), _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", *core.shown("doc_id"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(core.documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
