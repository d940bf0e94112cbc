"""Packing of token sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are dealt at random (by a hash of id and text) into groups of about ``GROUP``
documents; each group is packed on its own.  A document's ids are cut every ``LIMIT`` ids;
full pieces are sequences of their own and only the remainders are shuffled and packed by
first-fit decreasing.  As documents may be cut freely, the emptiest bins of a group are
then poured into the gaps of the fullest, and the one bin left over is cut into lengths
that are powers of two, which need no padding.

Defined results: a null or empty text is the single end id; repeated rows are packed each
for itself; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import core

LIMIT = 1024
GROUP = 2048
END_ID = 0
def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: the printable Latin-1 ones as themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The tokenizer file's vocabulary drives a faster implementation of the same merges; texts
    that hold one of the file's special tokens take the file's own tokenizer.
    """

    def __init__(self, path: str):
        import public_tokenizers
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        alphabet = _byte_alphabet()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        self.encode = Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")

    def __call__(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if self.special.search(text) else self.encode(text)
        return np.array(ids, "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pieces(path: str, limit: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts, group = batch.column(0), batch.column(1), batch.column(2)
            for at in range(0, batch.num_rows, 128):
                rows: dict[str, list] = {k: [] for k in ("group", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                for key, g, text in zip(ids.slice(at, 128).to_pylist(), group.slice(at, 128).to_pylist(), texts.slice(at, 128).to_pylist(), strict=True):
                    data = encode(text or "") + end
                    total = len(data) // 4
                    for s in range(0, total, limit):
                        piece = data[4 * s : 4 * (s + limit)]
                        n = len(piece) // 4
                        for k, v in zip(rows, (g, key, s, n, zlib.crc32(piece), total, None if n == limit else piece), strict=True):
                            rows[k].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=PIECES)

    return run


PIECES = pa.schema([("group", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Leftmost bin with room: a complete tree whose inner nodes hold the larger capacity of their children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> int:
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < need:
                at += 1
        best[at] -= need
        chosen = at - self.leaves
        at //= 2
        while at:
            high = max(best[2 * at], best[2 * at + 1])
            if best[at] == high:
                break
            best[at] = high
            at //= 2
        return chosen


def pack_lengths(lengths: list[int], limit: int = LIMIT) -> list[list[tuple[int, int, int]]]:
    """First-fit decreasing, then closing of gaps: sequences of (item, from, length), cutting items where needed."""
    tree = Tournament(max(1, len(lengths)), limit)
    bins: list[list[tuple[int, int, int]]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        b = tree.place(lengths[i])
        if b == len(bins):
            bins.append([])
        bins[b].append((i, 0, lengths[i]))
    fill = [sum(n for _, _, n in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-fill[b], b))
    low, high = 0, len(order) - 1
    while low < high:
        into, out = order[low], order[high]
        room = limit - fill[into]
        if not room:
            low += 1
        elif not bins[out]:
            high -= 1
        else:
            i, s, n = bins[out].pop()
            took = min(n, room)
            bins[into].append((i, s, took))
            if took < n:
                bins[out].append((i, s + took, n - took))
            fill[into] += took
            fill[out] -= took
    done = [b for b in bins if b and sum(n for _, _, n in b) == limit]
    for rest in (b for b in bins if b and sum(n for _, _, n in b) < limit):
        todo = list(rest)
        while todo:
            size = 1 << (sum(n for _, _, n in todo).bit_length() - 1)
            part = []
            while size:
                i, s, n = todo.pop(0)
                took = min(n, size)
                part.append((i, s, took))
                size -= took
                if took < n:
                    todo.insert(0, (i, s + took, n - took))
            done.append(part)
    return done


def _packed(limit: int):
    def pack(group: int, rows: list[dict]) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}

        def add(*values):
            for k, v in zip(out, values, strict=True):
                out[k].append(v)

        sequence = group << 32
        rest = []
        for r in rows:
            if r["ids"] is None:
                add(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], sequence, 0)
                sequence += 1
            else:
                rest.append(r)
        for items in pack_lengths([r["length"] for r in rest], limit):
            offset = 0
            for i, s, n in items:
                r = rest[i]
                add(r["doc_id"], r["start"] + s, n, zlib.crc32(r["ids"][4 * s : 4 * (s + n)]), r["doc_tokens"], sequence, offset)
                offset += n
            sequence += 1
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in out]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                for r in batch.slice(at, 2048).to_pylist():
                    if r["group"] != group:
                        if held:
                            yield pack(group, held)
                        group, held = r["group"], []
                    held.append(r)
        if held:
            yield pack(group, held)

    return run


def pack(docs: DataFrame, path: str, limit: int = LIMIT, group: int = GROUP, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where each run of a document's ids stands in which sequence."""
    groups = max(1, -(-docs.count() // group))
    dealt = docs.select(core.key(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(core.key(id_col), F.col(text_col)), F.lit(groups)).alias("group"))
    pieces = core.arrow(dealt, _pieces(path, limit, end_id), "group long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    packed = core.arrow(pieces.repartition("group").sortWithinPartitions("group", "doc_id", "start"), _packed(limit), PACKED)
    return packed.withColumn("doc_id", *core.shown("doc_id"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(core.documents(spark, sf_dir), tokenizer_path())
