"""Jaccard similarity join of documents on word n-grams by chosen paths.

Each text becomes its set of five-word shingles (a text of fewer words has one shingle of all
its words); equal sets are one *class*, represented by its smallest id.  A class is embedded
into ``HASHES`` MinHash tokens (position, value).  In each of several independent runs a node
of the path tree picks positions at random, ``BRANCH`` (the threshold's inverse) on average, and a class goes down to the child named
by its value there: classes meet in a bucket if they share all tokens sampled on the way.
Buckets of up to ``SMALL`` classes are compared by brute force over the tokens; larger ones are split again, down to
``DEPTH`` picks, where what is left is compared in blocks.  Runs are repeated until a pair at the
threshold meets with the target recall ``TARGET`` (see ``recall``).  Comparison keeps only edges of a
spanning forest of pairs whose estimated similarity is within ``SLACK`` of the threshold, so no
bucket emits all its pairs; the connected components of these edges hold all candidates, and
inside them every pair of classes is verified on the whole shingle sets, in blocks of ``SETS`` shingles.

Defined results: null texts and texts without words have no shingles and link to nothing, each
a class of its own; repeated rows and equal texts share a class; rows that share an id or have none
are told apart by their texts (64-bit hashes); an empty table gives an empty result.  Ties in
representatives go to the smallest id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import core, linking

WORDS = 5
THRESHOLD = 0.8
HASHES = 64
BRANCH = 1 / THRESHOLD
DEPTH = 3
TARGET = 0.99
SMALL = 64
SLACK = 0.2
#: Rows of a block at the deepest level, and shingles of a block in verification.
BLOCK = 4096
SETS = 1 << 21

_MUL = core.seeded(11, HASHES) | np.uint64(1)
_ADD = core.seeded(12, HASHES)


def signatures(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """MinHash tokens (rows x HASHES, 32 bits) of the rows of a flat list of shingles; rows without any get all ones."""
    full = np.flatnonzero(np.diff(bound) > 0)
    out = np.full((len(bound) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    if len(full):
        first = bound[:-1][full]
        for i in range(HASHES):
            out[full, i] = np.minimum.reduceat((values * _MUL[i] + _ADD[i]) >> np.uint64(32), first).astype(np.uint32)
    return out


def _children(paths: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path): positions are picked by the path alone, with probability BRANCH / HASHES each, so all classes at a node pick alike."""
    rows, out = [], []
    for i in range(HASHES):
        chosen = np.flatnonzero(core.mix(paths + core._STEP[1] * np.uint64(2 * i + 1)) >> np.uint64(32) < np.uint64(BRANCH / HASHES * (1 << 32)))
        rows.append(chosen)
        out.append(core.mix(paths[chosen] * core._STEP[2] + sig[chosen, i].astype(np.uint64) + np.uint64(i << 32)))
    return np.concatenate(rows), np.concatenate(out)


def survival(similarity: float, depth: int) -> float:
    """Chance that a pair still shares a node after ``depth`` picks: a branching process with Poisson(BRANCH * similarity) common children."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - float(np.exp(-BRANCH * similarity * alive))
    return alive


def runs_for(target: float = TARGET, similarity: float = THRESHOLD, depth: int = DEPTH) -> int:
    """Runs until a pair of that similarity meets at the deepest level with the target chance."""
    return math.ceil(math.log(1 - target) / math.log(1 - survival(similarity, depth)))


def recall(similarity: float = THRESHOLD, runs: int | None = None, depth: int = DEPTH) -> float:
    """Chance that some run lets a pair meet at the deepest level; pairs that meet in a small bucket earlier have a better one."""
    return 1 - (1 - survival(similarity, depth)) ** (runs or runs_for())


_ROOTS = core.seeded(13, 4096)


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0), batch.column(2)
            for at, sets in core.shingle_sets(batch.column(1), words):
                size = [len(s) for s in sets]
                bound = np.concatenate([[0], np.cumsum(size)])
                sig = signatures(np.concatenate(sets), bound)
                keys = [core.set_key(s) for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "id": ids.slice(at, len(sets)), "part": parts.slice(at, len(sets)), "k1": pa.array([k[0] for k in keys], pa.int64()), "k2": pa.array([k[1] for k in keys], pa.int64()),
                    "size": pa.array(size, pa.int32()), "sig": pa.array([r.tobytes() for r in sig], pa.binary()),
                })

    return run


def _roots(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
            ids = batch.column(0).to_numpy()
            for r in range(runs):
                row, path = _children(np.full(len(sig), _ROOTS[r], np.uint64), sig)
                yield pa.RecordBatch.from_pydict({"path": pa.array(path.view(np.int64)), "rep": pa.array(ids[row], pa.int64())})

    return run


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, HASHES)
        row, path = _children(batch.column(0).to_numpy().view(np.uint64), sig)
        yield pa.RecordBatch.from_pydict({"path": pa.array(path.view(np.int64)), "rep": pa.array(batch.column(1).to_numpy()[row], pa.int64())})


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with equal leading key columns of a sorted stream."""
    now, held = None, []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(n, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        for s, e in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[s].item() for c in cols)
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(batch.slice(s, e - s))
    if held:
        yield now, held


def forest(sig: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of rows that agree in at least that share of tokens, breadth first."""
    need = int(np.ceil(threshold * sig.shape[1]))
    left = np.arange(len(sig))
    edges = []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        at = queue.pop()
        if len(left):
            near = (sig[left] == sig[at]).sum(1) >= need
            found = left[near]
            edges += [(at, int(x)) for x in found]
            queue += found.tolist()
            left = left[~near]
    return edges


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for _, rows in _grouped(batches, 3):
            ids = np.concatenate([r.column(3).to_numpy() for r in rows])
            if len(ids) > 1:
                sig = np.frombuffer(b"".join(x for r in rows for x in r.column(4).to_pylist()), np.uint32).reshape(-1, HASHES)
                for a, b in forest(sig, threshold):
                    u.append(ids[a])
                    v.append(ids[b])
            if len(u) >= 10000:
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
                u, v = [], []
        if u:
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _blocks(rows: DataFrame, key: str, count: str, size: int, by: str) -> DataFrame:
    """Deal the rows of groups beyond ``size`` into blocks, each row once for every pair of blocks it belongs to (columns i <= j)."""
    blocks = F.ceil(F.col(count) / F.lit(size)).cast("int")
    own = F.pmod(F.xxhash64(by, key), blocks.cast("long")).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", own)
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")


def candidates(classes: DataFrame, threshold: float, runs: int, depth: int = DEPTH, small: int = SMALL) -> DataFrame:
    """Edges (u, v) whose components hold every pair of classes (rep, sig) that met on a path and may reach the threshold."""
    # Sets without shingles are no candidates.
    sigs = classes.where("size > 0").select("rep", "sig")
    paths = core.arrow(sigs, _roots(runs), "path long, rep long")
    edges = None
    for level in range(1, depth + 1):
        met = paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        rows = core.stored(paths.join(met, "path"))
        here = rows.where(F.col("n") <= small) if level < depth else rows
        dealt = _blocks(here, "path", "n", BLOCK, "rep").select("path", "i", "j", "rep").join(sigs, "rep").select("path", "i", "j", "rep", "sig")
        # Of hot buckets, each pair of blocks is a group of its own.
        found = core.arrow(dealt.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j", "rep"), _compare(threshold - SLACK), "u long, v long")
        found = core.stored(found.distinct())
        edges = found if edges is None else edges.unionByName(found)
        if level == depth or not rows.where(F.col("n") > small).limit(1).count():
            break
        paths = core.arrow(rows.where(F.col("n") > small).select("path", "rep").join(sigs, "rep").select("path", "rep", "sig"), _deeper, "path long, rep long")
    return edges


def links(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a, b) of sets with Jaccard similarity of at least the threshold; within one list (right None) each pair once."""
    own = right is None
    right = left if own else right
    order = np.argsort([len(s) for s in right], kind="stable")  # by length, so that each set is held against a range
    left, right = ([left[x] for x in order] if own else left), [right[x] for x in order]
    size_l, size_r = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    flat = np.concatenate([*left, *([] if own else right)])
    _, code = np.unique(flat, return_inverse=True)
    code_r = code if own else code[size_l.sum() :]
    first_l = np.concatenate([[0], np.cumsum(size_l)])
    first_r = np.concatenate([[0], np.cumsum(size_r)])
    mark = np.zeros(int(code.max()) + 1, np.uint8)
    out_a, out_b = [], []
    for a in range(len(left)):
        low = a + 1 if own else int(np.searchsorted(size_r, threshold * size_l[a] - 1e-9))
        high = int(np.searchsorted(size_r, size_l[a] / threshold + 1e-9, "right"))
        if low >= high:
            continue
        mine = code[first_l[a] : first_l[a + 1]]
        mark[mine] = 1
        part = code_r[first_r[low] : first_r[high]]
        both = np.add.reduceat(mark[part], first_r[low:high] - first_r[low], dtype=np.int64)
        mark[mine] = 0
        hit = np.flatnonzero(both >= threshold * (size_l[a] + size_r[low:high] - both) - 1e-9) + low
        out_a.append(np.full(len(hit), order[a] if own else a))
        out_b.append(order[hit])
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, int), np.zeros(0, int))


def _verify(words: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # component, i, j, own, rep, text
        for (_, i, j), rows in _grouped(batches, 3):
            ids = np.concatenate([r.column(4).to_numpy() for r in rows])
            own = np.concatenate([r.column(3).to_numpy() for r in rows])
            sets = [s for r in rows for _, part in core.shingle_sets(r.column(5), words) for s in part]
            fresh = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))  # repeated rows come next to each other
            ids, own, sets = ids[fresh], own[fresh], [sets[x] for x in fresh]
            one, two = (np.flatnonzero(own == i), None) if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
            if not len(one) or two is not None and not len(two):
                continue
            a, b = links([sets[x] for x in one], None if two is None else [sets[x] for x in two], threshold)
            first, second = one[a], (one if two is None else two)[b]
            count = np.bincount(np.concatenate([first, second]), minlength=len(ids))
            # A spanning forest of the links: each set with links is tied to the root of its tree.
            root = list(range(len(ids)))

            def find(x, root=root):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in zip(first.tolist(), second.tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
            tied = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"rep": pa.array(ids[tied], pa.int64()), "near": pa.array([ids[find(x)] for x in tied.tolist()], pa.int64()), "n_links": pa.array(count[tied], pa.int64())})

    return run


def part(text_col: str = "text") -> Column:
    """Tells rows that share an id apart by their texts."""
    return F.xxhash64(F.col(text_col))


def joined(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, runs: int | None = None, small: int = SMALL, block: int = SETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and part of the row, rep and n_copies of its class, lead (the smallest id and part
    that is reached over links) and n_links."""
    rows = docs.select(core.key(id_col).alias("id"), F.col(text_col).alias("text"), part(text_col).alias("part"))
    # Texts without words are told apart by id and part: their set key is taken from them.
    sketch = core.arrow(rows, _sketch(words), "id long, part long, k1 long, k2 long, size int, sig binary")
    sketch = core.stored(sketch.withColumn("k1", F.when(F.col("size") > 0, F.col("k1")).otherwise(F.xxhash64("id", "part"))))
    # Inside, a class goes by a hash of its key, as several may share an id.
    named = sketch.groupBy("k1", "k2").agg(F.min(F.struct("id", "part")).alias("first"), F.count("*").alias("n_copies"))
    named = named.select("k1", "k2", F.xxhash64("k1", "k2").alias("node"), "first", "n_copies")
    classes = core.stored(sketch.join(named, ["k1", "k2"]).drop("k1", "k2"))
    reps = classes.where("id = first.id and part = first.part").dropDuplicates(["node"])
    parts = linking.components(candidates(reps.select(F.col("node").alias("rep"), "size", "sig"), threshold, runs or runs_for(), small=small))
    sized = parts.withColumnRenamed("id", "rep").join(reps.select(F.col("node").alias("rep"), "id", "part", "size"), "rep")
    # Blocks are as large as a worker holds, so that a text is sent to few pairs of them.
    dealt = _blocks(sized.join(sized.groupBy("component").agg(F.sum("size").alias("n")), "component"), "component", "n", block, "rep")
    # Texts are dealt by id and part at every size; the plan does not turn on how many candidates there are.
    held = dealt.join(rows.hint("merge"), ["id", "part"]).select("component", "i", "j", "own", "rep", "text")
    found = core.arrow(held.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "own", "rep"), _verify(words, threshold), "rep long, near long, n_links long")
    found = core.stored(found)
    final = linking.components(found.select(F.col("rep").alias("u"), F.col("near").alias("v")))
    count = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    linked = count.withColumnRenamed("rep", "node").join(final.withColumnRenamed("id", "node"), "node").join(reps.select("node", "first"), "node")
    lead = linked.groupBy("component").agg(F.min("first").alias("lead"))
    per_class = linked.join(lead, "component").select("node", "n_links", "lead")
    out = classes.select("id", "part", "node", "first", "n_copies").join(per_class, "node", "left")
    return out.select("id", "part", F.col("first.id").alias("rep"), "n_copies", F.coalesce("lead", "first").alias("lead"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, runs: int | None = None, small: int = SMALL, block: int = SETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_class (smallest id with the same shingles), n_copies, class_id (smallest id
    that is reached over links) and n_links (other classes at or above the threshold)."""
    out = joined(docs, threshold, words, runs, small, block, id_col, text_col)
    out = out.select(F.col("id").alias("doc_id"), F.col("rep").alias("text_class"), "n_copies", F.col("lead.id").alias("class_id"), "n_links")
    return out.select(*core.shown("doc_id", "text_class"), "n_copies", *core.shown("class_id"), "n_links")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(core.documents(spark, sf_dir))
