"""Language identification of whole, possibly mixed-language texts.

A bounded sample of labelled rows (``TRAIN_DOCS`` whole documents, those with the smallest
hashes of their ids) gives, for each language, smoothed log-probabilities of hashed byte
trigrams and the share of its words in each script.  For prediction, the script ranges of a
word's characters narrow the candidate languages, each word gets a score for each candidate,
and a Viterbi pass with a switching penalty labels spans; the document's language is the one
that covers most bytes of words with letters.

Defined results: null, empty or letterless texts are ``und`` with score 0 and no spans, as is
every text where there is no labelled row to learn from.  Ties go to the language first by
code point.  Repeated rows get equal results.  Only id and text are read for prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.llm import core

TRAIN_DOCS = 4000
BUCKETS = 1 << 16
SMOOTH = 0.3
SWITCH = 12.0
MIN_SCRIPT_SHARE = 0.002
OUT_OF_SCRIPT = -25.0
#: Words times languages held by a worker at a time.
CELLS = 1 << 20
#: First code point of each script range and the script it starts (0: no letters of a script).
SCRIPT_FROM = [0x0, 0x41, 0x5B, 0x61, 0x7B, 0xAA, 0xAB, 0xB5, 0xB6, 0xBA, 0xBB, 0xC0, 0xD7, 0xD8, 0xF7, 0xF8, 0x2B0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xE00, 0xE80, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0x4DC0, 0x4E00, 0xA000, 0xAC00, 0xD7B0]
SCRIPT_OF = [0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 2, 3, 0, 4, 5, 0, 6, 0, 7, 0, 8, 0, 1, 2, 0, 9, 0, 10, 0, 10, 0, 8, 0]
SCRIPTS = 11

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[~core.IS_WORD] = 0x20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Hashed trigram around each byte; row borders count as white space."""
    low = _FOLD[buf].astype(np.uint32)
    left, right = np.full(len(buf), 0x20, np.uint32), np.full(len(buf), 0x20, np.uint32)
    left[1:], right[:-1] = low[:-1], low[1:]
    full = np.diff(offs) > 0
    left[offs[:-1][full]] = 0x20
    right[offs[1:][full] - 1] = 0x20
    return ((left << np.uint32(16) | low << np.uint32(8) | right) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _scripts(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Highest script among a word's characters; 0 if it has no letter of any script."""
    script = np.zeros(len(buf), np.uint8)
    script[_LETTER[buf] & (buf < 0x80)] = 1
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        wide = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int64)
        b = wide[lead]
        two = (b & 0x1F) << 6 | wide[lead + 1] & 0x3F
        three = (b & 0x0F) << 12 | (wide[lead + 1] & 0x3F) << 6 | wide[lead + 2] & 0x3F
        point = np.where(b < 0xE0, two, np.where(b < 0xF0, three, 0x1F000))
        script[lead] = np.asarray(SCRIPT_OF, np.uint8)[np.searchsorted(SCRIPT_FROM, point, "right") - 1]
    return np.maximum.reduceat(script, start) if len(start) else script[:0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for at, to, buf, offs in core.chunks(batch.column(0)):
            feature = _features(buf, offs)
            start, end = core.spans(core.IS_WORD[buf], offs)
            kind = _scripts(buf, start, end)
            row = np.searchsorted(offs, start, "right") - 1
            for i in range(to - at):
                lang = langs[at + i]
                if lang not in grams:
                    grams[lang], scripts[lang] = np.zeros(BUCKETS, np.int64), np.zeros(SCRIPTS, np.int64)
                part = slice(offs[i], offs[i + 1])
                grams[lang] += np.bincount(feature[part][core.IS_WORD[buf[part]]], minlength=BUCKETS)
                scripts[lang] += np.bincount(kind[np.searchsorted(row, i) : np.searchsorted(row, i, "right")], minlength=SCRIPTS)
    for lang, counts in grams.items():
        both = np.concatenate([counts, scripts[lang]])
        full = np.flatnonzero(both)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(full), pa.string()), "slot": pa.array(full, pa.int32()), "n": pa.array(both[full], pa.int64())})


class Model:
    """languages in code point order, trigram scores by bucket, which script each language uses."""

    def __init__(self, languages: list[str], scores: np.ndarray, uses: np.ndarray):
        self.languages, self.scores, self.uses = languages, scores, uses


def train(labelled: DataFrame, limit: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the ``limit`` labelled rows with the smallest hashes of their ids; at most that many languages."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # Only hashes are ordered; texts are read again up to the last hash taken.
    order = F.xxhash64(id_col, text_col)
    last = rows.select(order.alias("h")).orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    sample = rows.where(order <= F.lit(last)).limit(limit).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = core.arrow(sample.repartition(16, F.xxhash64("text")), _count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = counts.column("lang").to_pylist()
    languages = sorted(set(names))
    table = np.zeros((BUCKETS + SCRIPTS, len(languages)))
    if languages:
        place = {lang: i for i, lang in enumerate(languages)}
        table[counts.column("slot").to_numpy(), [place[x] for x in names]] = counts.column("n").to_numpy()
    grams, scripts = table[:BUCKETS] + SMOOTH, table[BUCKETS:]
    scores = np.log(grams / grams.sum(0)).astype(np.float32)
    uses = scripts >= np.maximum(1, MIN_SCRIPT_SHARE * scripts.sum(0))
    return Model(languages, scores, uses)


def viterbi(emit: np.ndarray, bound: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best language of each word; rows are bound[i]:bound[i + 1], all advanced together."""
    n = np.diff(bound)
    order = np.argsort(-n, kind="stable")
    size, base = n[order], bound[:-1][order]
    stay = np.ones(emit.shape, bool)
    best = np.zeros(len(emit), np.int32)
    active = int(np.searchsorted(-size, 0))
    if not active:
        return best
    state = emit[base[:active]].astype(np.float64)
    final = np.zeros(len(order), np.int32)
    steps = int(size[0])
    alive = np.searchsorted(-size, -np.arange(1, steps + 2), "right")  # alive[t]: rows longer than t
    for t in range(1, steps):
        k = int(alive[t])
        if k < len(state):
            final[k : len(state)] = state[k:].argmax(1)
            state = state[:k]
        at = base[:k] + t
        top = state.argmax(1)
        switch = state[np.arange(k), top] - penalty
        keep = state >= switch[:, None]
        stay[at], best[at] = keep, top
        state = np.where(keep, state, switch[:, None]) + emit[at]
    final[: len(state)] = state.argmax(1)
    path = np.zeros(len(emit), np.int32)
    now = final.copy()
    for t in range(steps - 1, 0, -1):
        k = int(alive[t])
        at = base[:k] + t
        path[at] = now[:k]
        now[:k] = np.where(stay[at, now[:k]], now[:k], best[at])
    path[base[:active]] = now[:active]
    return path


def _label(model: Model, penalty: float):
    count = len(model.languages)
    out_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def score_words(buf, offs):
        start, end = core.spans(core.IS_WORD[buf], offs)
        row = np.searchsorted(offs, start, "right") - 1
        kind = _scripts(buf, start, end)
        feature = _features(buf, offs)
        emit = np.zeros((len(start), count), np.float32)
        if len(start):
            inside = core.IS_WORD[buf]
            first = np.concatenate([[0], np.cumsum(end - start)[:-1]])
            feature = feature[inside]
            for j in range(count):
                emit[:, j] = np.add.reduceat(model.scores[:, j][feature], first)
            emit -= emit.max(1, keepdims=True)
            uses = model.uses[kind]
            known = uses.any(1)
            emit[(kind == 0) | ~known] = 0
            emit[known[:, None] & ~uses & (kind > 0)[:, None]] += OUT_OF_SCRIPT
        return emit, row, start - offs[row], end - offs[row], kind

    def finish(keys, texts, parts, rows):
        emit = np.concatenate([p[0] for p in parts])
        row = np.concatenate([p[1] for p in parts])
        start, end, kind = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
        bound = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
        path = viterbi(emit, bound, penalty) if count else np.zeros(0, np.int32)
        weight = np.where(kind > 0, end - start, 0)
        share = np.bincount(row * count + path, weights=weight, minlength=rows * count).reshape(rows, count) if count else np.zeros((rows, 1))
        total = share.sum(1)
        top = share.argmax(1)
        # Letters outside the known script ranges are found one text at a time.
        letters = total > 0
        for i in np.flatnonzero(~letters):
            letters[i] = any(c.isalpha() for c in texts[i].as_py() or "")
        pred, score = [], []
        for i in range(rows):
            if not letters[i] or not count:
                pred.append("und")
                score.append(0.0)
            else:
                pred.append(model.languages[top[i]])
                score.append(float(share[i, top[i]] / total[i]) if total[i] else 1.0 / count)
        if len(path) and count:
            new = np.ones(len(path), bool)
            new[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
            head = np.flatnonzero(new)
            tail = np.concatenate([head[1:], [len(path)]]) - 1
            keep = letters[row[head]]
            head, tail = head[keep], tail[keep]
            runs = pa.StructArray.from_arrays([pa.array(start[head].astype(np.int32)), pa.array(end[tail].astype(np.int32)), pa.array(np.asarray(model.languages, object)[path[head]], pa.string())], names=["start", "end", "lang"])
            runs_of = np.bincount(row[head], minlength=rows)
        else:
            runs = pa.array([], out_type.value_type)
            runs_of = np.zeros(rows, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(runs_of)]).astype(np.int32)), runs)
        return pa.RecordBatch.from_arrays([keys, pa.array(pred, pa.string()), pa.array(score, pa.float64()), lists], names=["kept", "lang_pred", "score", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            parts, held, first = [], 0, 0
            for at, to, buf, offs in core.chunks(texts):
                part = score_words(buf, offs)
                parts.append((part[0], part[1] + (at - first), *part[2:]))
                held += part[0].size + len(part[0])
                if held >= CELLS or to == batch.num_rows:
                    yield finish(keys.slice(first, to - first), texts.slice(first, to - first), parts, to - first)
                    parts, held, first = [], 0, to
    return run


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, lang_pred, score and the labelled spans (byte offsets) of each text."""
    rows = docs.select(F.struct(F.lit(0), *keep).alias("kept"), F.col(text_col).alias("text"))
    schema = StructType().add("kept", rows.schema["kept"].dataType)
    for field in StructType.fromDDL("lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"):
        schema.add(field)
    out = core.arrow(rows, _label(model, penalty), schema)
    return out.select(*(F.col("kept")[c].alias(c) for c in keep), "lang_pred", "score", "spans")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = core.documents(spark, sf_dir)
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
