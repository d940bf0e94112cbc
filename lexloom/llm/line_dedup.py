"""Removal of repeated and nearly repeated lines by an exact set-similarity join.

Lines end at LF.  A line's tokens are its distinct words; a line matches an earlier one (by
document id, then, where rows share it, the hash of the text, then line number) if the Jaccard
similarity of their token sets is at least the threshold, and every line that matches an earlier line is removed, judged on the input, not on
what is left.  Lines without words never match.

Documents are numbered in their order, by their ids where these tell them apart and lie within 32 bits.
Equal token sets are collapsed to the first line that has them, and a set's number holds those of the document and of this line.
Tokens of a set are ordered by
rarity (a table of ``RARITY`` counters over all texts, ties by hash), and the sets that share a
token of their prefixes meet under it; the sets of a token that has more than ``BLOCK`` of them meet in pairs of
blocks, where only sets of different blocks are compared.  There, length, positional
and bitmap filters are applied: a bitmap, as wide as the set is long, holds the parity of token hashes, so the bits in
which two bitmaps differ are no more than the tokens in which the sets differ.  One earlier match
is enough, so a task emits for each set and group only the earlier set whose bitmap is nearest, and the
nearest of all groups is verified on the words of the lines.  Sets that stay undecided although they
have more candidates meet the others of their groups again, with ``GROW`` times as
many of the nearest candidates each round and by wider bitmaps, until each is settled or has no candidate left.

Defined results: null and empty texts have one empty line, kept; a document whose lines are all
removed has an empty text; repeated rows (one id, one text) count as one document, judged once;
rows that share an id or have none, but hold different texts, are told apart by 64-bit hashes of
these.  Tokens are told apart by 64-bit hashes in collapsing equal sets and by their bytes in
verification.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.llm import core

THRESHOLD = 0.8
#: Counters of the rarity table, which every worker holds as one byte each.
RARITY = 1 << 20
#: Sets of a token that meet in one group, and group size up to which groups are compared side by side.
BLOCK = 1 << 15
LAGS = 1 << 10
#: Bytes of index entries that are compared by a worker at a time, and that are gathered before they are sent.
BUCKET = 1 << 22
GATHER = 1 << 23
#: Pairs looked at together.
CELLS = 1 << 16
#: By how much the candidates of a round grow, and how much wider bitmaps are from the third round on.
GROW = 128
WIDER = 16
#: Keys that every worker may hold.
FEW = 1 << 20
#: Tokens that each bit of a bitmap stands for at most.
LOAD = 4 / 3
#: Bytes of text worked on together: their arrays fit a core's cache.
CHUNK = 1 << 17
#: Counters of the rarity table that are summed together.
SLOTS = 1 << 10
#: Bits of a document's number, and of a line's number in it, which a text of 2 GB cannot exceed.
DOCS = 32
LINES = 31


def _tokens(buf: np.ndarray, offs: np.ndarray):
    """Lines and their words: (line starts, row of each line, word hashes, line of each word)."""
    code, _, start, _ = core.words(buf, offs)
    breaks = np.flatnonzero(buf == 0x0A)
    # Rows in order, each with its own start before its breaks; an empty row keeps its one empty line.
    rows = np.arange(len(offs) - 1)
    row = np.concatenate([rows, np.searchsorted(offs, breaks, "right") - 1])
    begin = np.concatenate([offs[:-1], breaks + 1])
    order = np.lexsort([begin, row])
    begin, row = begin[order], row[order]
    full = np.flatnonzero(np.concatenate([begin[1:] != begin[:-1], [True]])) if len(begin) else rows
    # Of lines that begin at one place all but the last are empty.
    return begin, row, code, np.repeat(full, np.diff(np.searchsorted(start, np.append(begin[full], len(buf))))) if len(begin) else rows


def _rarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(RARITY, np.int64)
    for batch in batches:
        for _, _, buf, offs in core.chunks(batch.column(0), CHUNK):
            np.add.at(counts, (core.words(buf, offs)[0] & np.uint64(RARITY - 1)).astype(np.int64), 1)
    if counts.any():
        parts = counts.reshape(-1, SLOTS)
        yield pa.RecordBatch.from_pydict({"block": pa.array(np.arange(len(parts)), pa.int32()), "counts": pa.array([x.tobytes() for x in parts], pa.binary())})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters (block, counts) to logarithmic frequency classes."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = np.frombuffer(counts.as_buffer(), np.int64)
            sums[block] = sums[block] + counts if block in sums else counts
    kinds = [np.minimum(255, 8 * np.log2(x + 1.0)).astype(np.uint8).tobytes() for x in sums.values()]
    yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "kinds": pa.array(kinds, pa.binary())})


def rarity(docs: DataFrame) -> bytes:
    """Logarithmic frequency class of each counter; its size does not depend on the input."""
    parts = core.arrow(docs.select("text"), _rarity, "block int, counts binary").repartition("block")
    rows = core.arrow(parts, _summed, "block int, kinds binary").toArrow()
    classes = np.zeros(RARITY, np.uint8)
    for block, kinds in zip(rows.column("block").to_pylist(), rows.column("kinds").to_pylist(), strict=True):
        classes[block * SLOTS : (block + 1) * SLOTS] = np.frombuffer(kinds, np.uint8)
    return classes.tobytes()


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def bitmaps(code: np.ndarray, first: np.ndarray, n: np.ndarray, grow: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): parity bitmaps of sets of hashes that lie one after the other; a wider one folds to a narrower one."""
    wide = grow << np.ceil(np.log2(np.maximum(1, n / (64 * LOAD)))).astype(np.int64)
    offs = np.concatenate([[0], np.cumsum(wide)])
    bit = core.mix(code)
    one = np.uint64(1) << (bit & np.uint64(63))
    flat = np.zeros(offs[-1], np.uint64)
    # Most are one word wide.
    full = n > 0
    flat[offs[:-1][full]] = np.bitwise_xor.reduceat(one, first[full]) if full.any() else 0
    more = np.flatnonzero(wide > 1)
    if len(more):
        flat[np.repeat(offs[more] - np.concatenate([[0], np.cumsum(wide[more])[:-1]]), wide[more]) + np.arange(wide[more].sum())] = 0
        own = np.repeat(more, n[more])
        at = np.repeat(first[more] - np.concatenate([[0], np.cumsum(n[more])[:-1]]), n[more]) + np.arange(n[more].sum())
        place = (bit[at] & (wide[own] * 64 - 1).astype(np.uint64)).astype(np.int64)
        np.bitwise_xor.at(flat, offs[own] + (place >> 6), one[at])
    return flat, offs


def _binary(flat: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((8 * offs).astype(np.int32)), pa.py_buffer(flat)])


def _lines(table, threshold: float, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.frombuffer(table.value, np.uint8)
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for at, _, buf, offs in core.chunks(batch.column(1), CHUNK):
                _, row, code, line = _tokens(buf, offs)
                if not len(code):
                    continue
                kind = classes[(code & np.uint64(RARITY - 1)).astype(np.int64)]
                # Sorted by line, class, leading bits and place, in one number.
                low, high = len(code).bit_length(), max(1, int(line[-1]).bit_length())
                left = 56 - low - high
                if left > 0:
                    packed = (line.astype(np.uint64) << np.uint64(64 - high)) | (kind.astype(np.uint64) << np.uint64(56 - high)) | (code >> np.uint64(64 - left) << np.uint64(low)) | np.arange(len(code), dtype=np.uint64)
                    packed.sort()
                    order = (packed & np.uint64((1 << low) - 1)).astype(np.int64)
                    code, line, kind, packed = code[order], line[order], kind[order], packed >> np.uint64(low)
                # Equal words of a line are neighbours, but for words that agree in class and leading bits; these are sorted fully.
                if left <= 0 or ((packed[1:] == packed[:-1]) & (code[1:] != code[:-1])).any():
                    order = np.lexsort([code, kind, line])
                    code, line = code[order], line[order]
                fresh = np.ones(len(code), bool)
                fresh[1:] = (code[1:] != code[:-1]) | (line[1:] != line[:-1])
                code, line = code[fresh], line[fresh]
                first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
                n = np.diff(np.concatenate([first, [len(code)]]))
                own = line[first]
                k1 = np.add.reduceat(core.mix(code + np.uint64(0x1B873593)), first) + n.astype(np.uint64)
                k2 = np.add.reduceat(core.mix(code ^ np.uint64(0xE6546B64A5A5A5A5)), first)
                take = prefix_length(n, threshold)
                where = np.repeat(first - np.concatenate([[0], np.cumsum(take)[:-1]]), take) + np.arange(take.sum())
                lists = _binary(code[where], np.concatenate([[0], np.cumsum(take)]))
                # Only tokens this frequent can be in the prefixes of more sets than a block holds; they end a prefix.
                often = classes[(code[where] & np.uint64(RARITY - 1)).astype(np.int64)] + 1 >= 8 * np.log2(block + 1.0)
                common = np.add.reduceat(often, np.cumsum(take) - take, dtype=np.int32)
                head = np.searchsorted(row, row[own])
                yield pa.RecordBatch.from_arrays([
                    pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(docs[at + row[own]] << LINES | own - head, pa.int64()),
                    pa.array(n.astype(np.int32)), _binary(*bitmaps(code, first, n)), lists, pa.array(common),
                ], names=["k1", "k2", "seq", "n", "bits", "prefix", "common"])

    return run


ROW = ("key", "seq", "size", "at", "side", "asked", "bits")
ENTRIES = "bucket int, keys binary, seqs binary, shapes binary, wides binary, bits binary"


def _sent(key: np.ndarray, seq: np.ndarray, shape: np.ndarray, flat: np.ndarray, first: np.ndarray, wide: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Entries, with bitmaps flat[first : first + wide], as one row for each bucket of keys."""
    bucket = (core.mix(key.view(np.uint64)) >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, wide = bucket[order], wide[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    past = np.concatenate([[0], np.cumsum(wide)])
    bits = flat[np.repeat(first[order] - past[:-1], wide) + np.arange(past[-1])]
    columns = [pa.array(bucket[cut[:-1]].astype(np.int32)), *(_binary(x, cut) for x in (key[order], seq[order], shape[order], wide)), _binary(bits, past[cut])]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "keys", "seqs", "shapes", "wides", "bits"])


def _bits_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offs = core.buffers(col)
    return np.frombuffer(data[offs[0] : offs[-1]].tobytes(), np.uint64), (offs[:-1] - offs[0]) >> 3, np.diff(offs) >> 3


def _shape(n, at, side, asked):
    return n << 32 | at << 3 | side << 1 | asked


def _parts(batches: Iterator[pa.RecordBatch]):
    """Sets (seq, n, bits, prefix), some at a time: seq, n, token and position of each entry, and of its bitmap the words, first one and width."""
    for batch in batches:
        seq, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
        flat, first, wide = _bits_of(batch.column(2))
        token, start, size = _bits_of(batch.column(3))
        weight = np.cumsum(8 * size * (4 + wide))
        s = 0
        while s < len(seq):
            e = max(s + 1, int(np.searchsorted(weight, (weight[s - 1] if s else 0) + GATHER, "right")))
            row = np.repeat(np.arange(s, e), size[s:e])
            at = np.arange(len(row)) - np.repeat(start[s:e] - start[s], size[s:e])
            yield seq[row], n[row], token[start[s] : start[s] + len(row)].view(np.int64), at, flat, first[row], wide[row]
            s = e


def _send_sets(buckets: int):
    """Sets -> their entries, all asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, n, key, at, flat, first, wide in _parts(batches):
            yield _sent(key, seq, _shape(n, at, 0, 1), flat, first, wide, buckets)

    return run


def _rows_of(keys):
    """Sets -> a row for each entry, of the given keys only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if keys is None else np.frombuffer(keys.value, np.int64)
        for seq, n, key, at, flat, first, wide in _parts(batches):
            if wanted is not None:
                hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key)
                seq, n, key, at, first, wide = (x[hit] for x in (seq, n, key, at, first, wide))
            past = np.concatenate([[0], np.cumsum(wide)])
            bits = _binary(flat[np.repeat(first - past[:-1], wide) + np.arange(past[-1])], past)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(seq), pa.array(n), pa.array(at), bits], names=["key", "seq", "size", "at", "bits"])

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets (prefix, common) -> the frequent tokens, which end the prefixes."""
    for batch in batches:
        token, start, size = _bits_of(batch.column(0))
        past = np.repeat(start + size - batch.column(1).to_numpy(), size)
        yield pa.RecordBatch.from_arrays([pa.array(token[np.arange(len(token)) >= past].view(np.int64))], names=["key"])


def _send_rows(buckets: int):
    """Entries (key, seq, size, at, side, asked, bits), row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, seq, n, at, side, asked = (batch.column(c).to_numpy().astype(np.int64) for c in range(6))
            yield _sent(key, seq, _shape(n, at, side, asked), *_bits_of(batch.column(6)), buckets)

    return run


class _Bitmaps:
    """Bitmaps of different widths; two are compared at the width of the narrower one."""

    def __init__(self, flat: np.ndarray, first: np.ndarray, wide: np.ndarray):
        self.flat, self.first, self.wide, self.wides = flat, first, wide, np.unique(wide).tolist()

    def _rows(self, which: np.ndarray, wide: int) -> np.ndarray:
        first, more = self.first[which], np.flatnonzero(self.wide[which] > wide)
        # Of sets that pass the length filter, one bitmap is at most twice as wide.
        if wide == 1:
            out = self.flat[first]
            out[more] ^= self.flat[first[more] + 1]
            return out[:, None]
        out = self.flat[first[:, None] + np.arange(wide)]
        out[more] ^= self.flat[first[more][:, None] + np.arange(wide, 2 * wide)]
        return out

    def distance(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Differing bits of the pairs (x, y)."""
        out = np.zeros(len(x), np.int64)
        both = np.minimum(self.wide[x], self.wide[y])
        for wide in self.wides:
            which = np.flatnonzero(both == wide)
            step = max(1, CELLS // wide)
            for s in range(0, len(which), step):
                part = which[s : s + step]
                bits = np.bitwise_count(self._rows(x[part], wide) ^ self._rows(y[part], wide))
                out[part] = bits[:, 0] if wide == 1 else bits.sum(1)
        return out


def _may_match(n, m, at, to, threshold: float) -> np.ndarray:
    """Length and positional filters on index entries, side by side."""
    return (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9) & (np.minimum(n - at, m - to) >= threshold / (1 + threshold) * (n + m) - 1e-9)


MET = "key long, seq long, to long, apart long, more boolean"


def _meetings(threshold: float, since: int, until: int):
    """Entries by bucket -> for each asked set of a group the earlier sets that pass the filters, those ranked from
    ``since`` to ``until`` by the distance of their bitmaps, and whether there are more."""

    def solve(held: list[tuple]) -> pa.RecordBatch | None:
        key, seq, shape, wide, flat = (np.frombuffer(b"".join(h[c] for h in held), np.uint64 if c == 4 else np.int64) for c in range(5))
        order = np.argsort(key)
        # Groups by length, so that each set is held against a range.
        group = np.cumsum(np.concatenate([[0], key[order[1:]] != key[order[:-1]]]))
        order = order[np.argsort(group << 32 | shape[order] >> 32)]
        start = np.concatenate([[0], np.cumsum(wide)[:-1]])
        key, seq, shape = key[order], seq[order], shape[order]
        bits = _Bitmaps(flat, start[order], wide[order])
        n, at, side, asked = shape >> 32, shape >> 3 & 0x1FFFFFFF, shape >> 1 & 3, shape & 1 > 0
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        inner = np.arange(len(key)) - np.repeat(first, size)
        length, rest, low, share = n.astype(float), (n - at).astype(float), threshold * n - 1e-9, threshold / (1 + threshold)
        # Mostly every set is asked and no group is part of another.
        all_asked, whole = asked.all(), not side.any()
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = np.zeros(len(key), np.int64)
        rows = pairs = 0

        def nearest() -> tuple[np.ndarray, ...]:
            later, earlier, apart = (np.concatenate([h[c] for h in found]) if found else np.zeros(0, np.int64) for c in range(3))
            order = np.lexsort([seq[earlier], apart, later])
            later, earlier, apart = later[order], earlier[order], apart[order]
            start = np.flatnonzero(np.concatenate([[True], later[1:] != later[:-1]])) if len(later) else np.zeros(0, np.int64)
            rank = np.arange(len(later)) - np.repeat(start, np.diff(np.concatenate([start, [len(later)]])))
            keep = rank < until
            return later[keep], earlier[keep], apart[keep], rank[keep]

        def add(x: np.ndarray, y: np.ndarray) -> None:
            """Pairs that pass the other filters, in any order; some are gathered before they are looked at."""
            nonlocal waiting, pairs
            waiting.append((x, y))
            pairs += len(x)
            if pairs > CELLS:
                look()

        def look() -> None:
            nonlocal waiting, pairs, found, rows
            if not pairs:
                return
            x, y = (np.concatenate([w[c] for w in waiting]) for c in range(2))
            waiting, pairs = [], 0
            if not whole:
                # Blocks are compared with each other only in the group of both.
                ok = (seq[x] != seq[y]) & ((side[x] == 0) | (side[x] != side[y]))
                x, y = x[ok], y[ok]
            after = seq[x] > seq[y]
            later, earlier = np.where(after, x, y), np.where(after, y, x)
            if not all_asked:
                ok = asked[later]
                later, earlier = later[ok], earlier[ok]
            both = n[later] + n[earlier]
            apart = bits.distance(later, earlier)
            ok = apart <= both - 2 * np.ceil(threshold / (1 + threshold) * both - 1e-9)
            later, earlier, apart = later[ok], earlier[ok], apart[ok]
            np.add.at(count, later, 1)
            found.append((later, earlier, apart))
            rows += len(later)
            if rows > CELLS:
                found = [nearest()[:3]]
                rows = len(found[0][0])

        live = np.flatnonzero((np.repeat(size, size) <= LAGS) & (inner > 0))
        lag = 1
        while len(live):
            y = live - lag
            # A set that is too short leaves only shorter ones.
            fits = length[y] >= low[live]
            live, y = live[fits], y[fits]
            need = share * (length[live] + length[y]) - 1e-9
            hit = (rest[live] >= need) & (rest[y] >= need)
            add(live[hit], y[hit])
            lag += 1
            live = live[inner[live] >= lag]
        for f, c in zip(first[size > LAGS].tolist(), size[size > LAGS].tolist(), strict=True):
            step = max(1, CELLS // c)
            for s in range(f, f + c, step):
                e = min(f + c, s + step)
                x, y = np.arange(s, e), np.arange(f + int(np.searchsorted(length[f : f + c], low[s])), e)
                hit = (y[None, :] < x[:, None]) & _may_match(n[x][:, None], n[y][None, :], at[x][:, None], at[y][None, :], threshold)
                a, b = np.nonzero(hit)
                add(x[a], y[b])
        look()
        later, earlier, apart, rank = nearest()
        keep = rank >= since
        later, earlier, apart = later[keep], earlier[keep], apart[keep]
        if not len(later):
            return None
        return pa.RecordBatch.from_arrays([pa.array(key[later]), pa.array(seq[later]), pa.array(seq[earlier]), pa.array(apart, pa.int64()), pa.array(count[later] > until)], names=["key", "seq", "to", "apart", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket != now:
                    if held and (out := solve(held)) is not None:
                        yield out
                    now, held = bucket, []
                held.append([batch.column(c)[i].as_buffer() for c in range(1, 6)])
        if held and (out := solve(held)) is not None:
            yield out

    return run


def _verified(threshold: float):
    """Rows (seq, words of the two lines) to those that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x, y = set(a.split()), set(b.split())
                both = len(x & y)
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], names=["seq"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked lines of documents, as bytes: text, lines -> seq, words."""
    seq: list[int] = []
    words: list[bytes] = []
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"seq": pa.array(seq, pa.int64()), "words": pa.array(words, pa.binary())})

    for batch in batches:
        for text, asked in zip(batch.column(0), batch.column(1), strict=True):
            parts = (text.as_py() or "").encode().split(b"\n")
            for x in asked.as_py():
                seq.append(x)
                words.append(b" ".join(parts[x & (1 << LINES) - 1].split()))
                size += len(words[-1])
            if size >= core.CHUNK:
                yield out()
                seq, words, size = [], [], 0
    if seq:
        yield out()


def _wider(grow: int):
    """seq, words -> seq, bitmaps ``grow`` times as wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, buf, offs in core.chunks(batch.column(1)):
                code, row, _, _ = core.words(buf, offs)
                order = np.lexsort([code, row])
                code, row = code[order], row[order]
                fresh = np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])])
                code, n = code[fresh], np.bincount(row[fresh], minlength=to - at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), _binary(*bitmaps(code, np.cumsum(n) - n, n, grow))], names=["seq", "bits"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, min(256, batch.num_rows - at))
            out: dict[str, list] = {"doc_id": [], "n_lines": [], "n_removed": [], "text": []}
            for key, text, keep in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                keep = set(keep or ())
                left = [x for i, x in enumerate(lines) if i in keep or not x.strip(" \t\n\v\f\r")]
                out["doc_id"].append(key)
                out["n_lines"].append(len(lines))
                out["n_removed"].append(len(lines) - len(left))
                out["text"].append(text if len(left) == len(lines) else "\n".join(left))
            done = pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([*done.columns, part.column(3)], names=[*done.schema.names, "kept"])


def _doc() -> Column:
    """Number of a set's document."""
    return F.shiftright("seq", LINES).alias("doc")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text and others) with ``doc``, below 2 ** DOCS: documents by id, then hash of the text; repeated rows share it."""
    own = F.col("doc_id") != core.NO_ID
    found = rows.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n"), F.min(F.when(own, F.col("doc_id"))), F.max(F.when(own, F.col("doc_id"))))
    most, low, high = found.first()
    if (most or 0) <= 1 and (low is None or high - low + 1 < 1 << DOCS):
        return rows.withColumn("doc", F.when(own, F.col("doc_id") - F.lit(low or 0) + 1).otherwise(F.lit(0).cast("long")))
    # Otherwise they are sorted and counted; texts meet their numbers once.
    order = ("doc_id", "part")
    rows = rows.withColumn("part", F.xxhash64("text"))
    places = core.stored(rows.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", 33)
    before, starts = 0, []
    for k, n in sorted(places.groupBy(task).count().collect()):
        starts.append((k, before))
        before += n
    number = places.withColumn("task", task).join(F.broadcast(rows.sparkSession.createDataFrame(starts, "task long, start long")), "task")
    number = number.select(*order, (F.col("start") + F.col("at") - F.shiftleft("task", 33)).alias("doc"))
    return core.stored(rows.join(number.hint("shuffle_hash"), list(order)).drop("part"))


def first_lines(docs: DataFrame, table, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Distinct token sets of documents (doc, text) at their first lines, numbered in the order of these: seq, n, bits, prefix, common."""
    lines = core.arrow(docs.select("doc", "text"), _lines(table, threshold, block), "k1 long, k2 long, seq long, n int, bits binary, prefix binary, common int")
    first = F.min(F.struct("seq", "n", "bits", "prefix", "common")).alias("first")
    return core.stored(lines.groupBy("k1", "k2").agg(first).select("first.*"))


def _hot(sets: DataFrame, block: int) -> DataFrame:
    """Tokens that more sets than a block holds have in their prefixes: key, blocks."""
    keys = core.arrow(sets.select("prefix", "common"), _common, "key long")
    hot = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    # No more rows than entries by block; read from storage, so that its size is known when the join is planned.
    return core.stored(hot.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))


def _rows(sets: DataFrame, keys=None) -> DataFrame:
    """Each set once for every token of its prefix: key, seq, size, at, bits."""
    return core.arrow(sets.select("seq", "n", "bits", "prefix"), _rows_of(keys), "key long, seq long, size long, at long, bits binary")


def _entries(sets: DataFrame, hot: DataFrame) -> DataFrame:
    """Each set once for every token of its prefix, or for every pair of blocks that its own is part of: key, seq, size, at, bits, side."""
    columns = ("seq", "size", "at", "bits")
    rows = _rows(sets)
    own, other = F.pmod(F.xxhash64("seq"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.join(hot, "key").withColumn("own", own).withColumn("other", other)
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *columns, side.alias("side"))
    return rows.join(hot, "key", "left_anti").select("key", *columns, F.lit(0).alias("side")).unionByName(dealt)


def later_matches(docs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(seq) of the sets that match a set that begins earlier."""

    def words(asked: DataFrame, few: bool) -> DataFrame:
        """(seq, words) of the first lines of sets."""
        by = asked.groupBy(_doc()).agg(F.collect_list("seq").alias("lines"))
        # Lists are much smaller than texts, which need not be sorted for them. A list of few lines is read from storage, so that its size is known and texts may stay where they are.
        by = core.stored(by) if few else by.hint("shuffle_hash")
        # Repeated rows give the same words.
        return core.arrow(docs.select("doc", "text").join(by, "doc").select("text", "lines"), _cut, "seq long, words binary").dropDuplicates(["seq"])

    def check(pairs: DataFrame, held: DataFrame) -> DataFrame:
        """The later sets of those pairs (seq, to) that reach the threshold."""
        both = pairs.join(held, "seq").join(held.select(F.col("seq").alias("to"), F.col("words").alias("other")), "to")
        return core.stored(core.arrow(both.select("seq", "words", "other"), _verified(threshold), "seq long").distinct())

    def meet(sent: DataFrame, since: int, until: int) -> DataFrame:
        return core.stored(core.arrow(sent.repartition("bucket").sortWithinPartitions("bucket"), _meetings(threshold, since, until), MET))

    # Sets of up to three words match equal ones only, which are collapsed already.
    large = sets.where(F.col("n") > F.floor(F.lit(threshold / (1 - threshold)) + F.lit(1e-9)) - 1)
    wide = F.greatest(F.lit(1.0), F.pow(2.0, F.ceil(F.log2(F.col("n") / (64 * LOAD)))))
    volume, blocks = large.agg(F.sum((F.floor((1 - threshold) * F.col("n")) + 1) * 8 * (4 + wide)), F.count_if(F.col("common") > 0)).first()
    # Sets without tokens frequent enough to need blocks are sent as they are, the others as rows.
    n = max(1, int((volume or 0) // BUCKET))
    plain, common = large.where("common = 0"), large.where("common > 0")
    sent = core.arrow(plain.select("seq", "n", "bits", "prefix"), _send_sets(n), ENTRIES)
    if blocks:
        hot = _hot(common, block)
        rows = _entries(common, hot).withColumn("asked", F.lit(1))
        sent = sent.unionByName(core.arrow(rows.select(*ROW), _send_rows(n), ENTRIES))
    near = meet(sent, 0, 1)
    best = core.stored(near.groupBy("seq").agg(F.min(F.struct("apart", "to")).alias("best"), (F.max("more") | (F.min("to") < F.max("to"))).alias("more")).select("seq", "best.to", "more"))
    settled = check(best, words(best.select("seq").union(best.select("to")).distinct(), False))
    open_ = core.stored(best.where("more").select("seq").join(settled, "seq", "left_anti"))
    members, bits, held, since, until = None, None, None, 0, GROW
    while open_.limit(1).count():
        # After the first round, groups without more candidates are done with.
        groups = core.stored((near if members is None else near.where("more")).join(open_, "seq", "left_semi").select("key").distinct())
        if members is None:
            # Few keys are looked up by every worker.
            keys = docs.sparkSession.sparkContext.broadcast(np.sort(groups.toArrow().column(0).to_numpy()).tobytes()) if groups.count() <= FEW else None
            members = _rows(plain, keys).withColumn("side", F.lit(0))
            if blocks:
                members = members.unionByName(_entries(common, hot))
        members = core.stored(members.join(groups, "key", "left_semi"))
        if until > GROW and bits is None:
            # These rank anew. Later rounds meet no other sets, so their words are read once.
            since = 0
            held = core.stored(words(members.select("seq").distinct(), True))
            bits = core.stored(core.arrow(held, _wider(WIDER), "seq long, bits binary"))
        rows = members if bits is None else members.drop("bits").join(bits, "seq")
        rows = core.stored(rows.join(open_.withColumn("asked", F.lit(1)), "seq", "left").withColumn("asked", F.coalesce("asked", F.lit(0))).select(*ROW))
        volume = rows.agg(F.sum(32 + F.octet_length("bits"))).first()[0]
        near = meet(core.arrow(rows, _send_rows(max(1, volume // BUCKET)), ENTRIES), since, until)
        pairs = near.select("seq", "to").distinct()
        found = check(pairs, words(pairs.select("seq").union(pairs.select("to")).distinct(), True) if held is None else held)
        settled = settled.unionByName(found)
        open_ = core.stored(near.where("more").select("seq").distinct().join(found, "seq", "left_anti"))
        since, until = until, until * GROW
    return settled


def dedup(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, the text of the lines that stay, and the columns of ``keep``."""
    rows = docs.select(core.key(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(F.lit(0), *keep).alias("kept"))
    table = docs.sparkSession.sparkContext.broadcast(rarity(rows))
    rows = numbered(rows)
    sets = first_lines(rows, table, threshold, block)
    found = sets.select("seq", F.lit(True).alias("stays")).unionByName(later_matches(rows, sets, threshold, block).select("seq", F.lit(False).alias("stays")))
    line, stays = F.col("seq").bitwiseAND(F.lit((1 << LINES) - 1)).cast("int"), F.col("stays")
    lists = found.groupBy(_doc()).agg(F.collect_list(F.when(stays, line)).alias("own"), F.collect_list(F.when(~stays, line)).alias("gone"))
    lists = lists.select("doc", F.array_except("own", "gone").alias("keep")).hint("shuffle_hash")
    kept = rows.schema["kept"].dataType
    schema = StructType.fromDDL("doc_id long, n_lines long, n_removed long, text string").add("kept", kept)
    out = core.arrow(rows.join(lists, "doc", "left").select("doc_id", "text", "keep", "kept"), _kept, schema)
    return out.select(*core.shown("doc_id"), "n_lines", "n_removed", "text", *(F.col("kept")[c].alias(c) for c in keep))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(core.documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
