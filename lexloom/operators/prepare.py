"""Normalisation, redaction and segmentation of a document in one go, on one row for each document.

The same rules as ``normalize``, ``redact`` and ``segment``, whose columns the tests hold this against.  Rows for each piece, and
a window over them, took some ten times as long as the rules themselves; here a document's pieces never leave its row.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lexloom.functions import rules as R
from lexloom.operators import redact

_NAMES = ("idx", "label", "text", "start", "end")
CLAUSE = StructType([StructField(n, StringType() if n in ("label", "text") else IntegerType()) for n in _NAMES])
_KIND = pa.struct([(n, pa.string() if n in ("label", "text") else pa.int32()) for n in _NAMES])


def _rule(pattern: str) -> re.Pattern[str]:
    """A rule's pattern: ASCII classes, word edges and cases, the rules' white space."""
    return re.compile(pattern.replace(r"[\s-]", f"[{R.WS}-]").replace(r"\s", f"[{R.WS}]"), re.ASCII)


_BROKEN = re.compile("([a-z])-\n([a-z])")
_BLANKS = re.compile(f"[{R.WS_NO_LF}]+")
_ENDS = re.compile(" *\n *")
_EMPTY = re.compile("\n{3,}")
_ID, _NEEDS_ID, _NO_DIGIT = _rule(R.CHECKED_ID), re.compile(redact._NEEDS_ID), re.compile("[^0-9]")
_REDACTIONS = [(kind, re.compile(re.escape(look) if len(look) == 1 else look), _rule(p)) for (kind, p), look in zip(R.REDACTIONS, (redact.NEEDS[k] for k, _ in R.REDACTIONS), strict=True)]
_MARKERS = [_rule(p) for _, p in R.MARKERS]
_LABELS = [(_rule(p.replace('(?=[A-Z"(“])', "")), 0 if name == "word-headed" else 1) for name, p in R.MARKERS]
_PARAGRAPH = re.compile("(?=(?<!\n)\n\n)")
_TAIL = re.compile(r"[.):—-]+\Z")


def _normalized(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "-\n" in text:
        text = _BROKEN.sub(r"\1\2", text)
    if not text.isascii() or any(c in text for c in ("  ", "\t", "\x0b", "\f")):
        text = _BLANKS.sub(" ", text)
    if " \n" in text or "\n " in text:
        text = _ENDS.sub("\n", text)
    if "\n\n\n" in text:
        text = _EMPTY.sub("\n\n", text)
    return text.strip(R.WS_CHARS)


def _checked(digits: str) -> bool:
    c = 0
    for i, d in enumerate(reversed(digits)):
        c = int(R.VERHOEFF_D[c][int(R.VERHOEFF_P[i % 8][int(d)])])
    return len(digits) == 12 and c == 0


def _redacted(text: str) -> str:
    if _NEEDS_ID.search(text):
        for found in dict.fromkeys(m[0] for m in _ID.finditer(text) if _checked(_NO_DIGIT.sub("", m[0]))):
            text = re.sub(f"(?<![A-Za-z0-9_]){re.escape(found)}(?![A-Za-z0-9_])", "[REDACTED:AADHAAR]", text)
    for kind, look, pattern in _REDACTIONS:
        if look.search(text):
            text = pattern.sub(f"[REDACTED:{kind}]", text)
    return text


def _pieces(text: str) -> list[tuple[str | None, str, int]]:
    """(label, body, start): from marker to marker, or paragraphs, short ones joined to those before them."""
    found: list[list[re.Match[str]]] = []
    for marker in _MARKERS:
        found.append(list(marker.finditer(text)))
        if len(found[-1]) >= 2:
            break
    numbered = len(found[-1]) >= 2
    cuts = [m.start() for m in (found[-1] if numbered else _PARAGRAPH.finditer(text))]
    out: list[list] = []
    for pos, (at, end) in enumerate(zip([0, *cuts], [*cuts, len(text)], strict=True)):
        raw = text[at:end]
        body = raw.strip(R.WS_CHARS)
        # A preamble must be longer than the shortest clause.
        if not body or numbered and pos == 0 and len(raw) <= R.MIN_CLAUSE:
            continue
        if out and len(body) < R.MIN_CLAUSE:
            out[-1][1].append(body)
            continue
        label = None
        if numbered and pos > 0:
            pattern, group = _LABELS[len(found) - 1]
            head = pattern.search(body)
            label = _TAIL.sub("", head[group].strip(R.WS_CHARS)) if head else None
        out.append([label or None, [body], at if numbered else at + len(raw) - len(raw.lstrip("\n"))])
    return [(label, "\n".join(bodies), start) for label, bodies, start in out]


def _packed(body: str, start: int) -> list[tuple[str, int]]:
    if len(body) <= R.MAX_CLAUSE:
        return [(body, start)]
    done, held, at, cursor = [], "", start, start
    for paragraph in body.split("\n\n"):
        chunk = paragraph + "\n\n"
        if held and len(held) + len(chunk) > R.MAX_CLAUSE:
            done.append((held.strip(R.WS_CHARS), at))
            held, at = "", cursor
        held += chunk
        cursor += len(chunk)
    last = held.strip(R.WS_CHARS)
    return [*done, (last, at)] if last else done


def clauses_of(raw: str | None) -> list[tuple]:
    """(idx, label, text, start, end) of a raw text's first clauses, identifiers replaced."""
    if raw is None:
        return []
    rows = []
    for label, body, start in _pieces(_redacted(_normalized(raw))):
        for n, (text, at) in enumerate(_packed(body, start)):
            if len(rows) == R.MAX_CLAUSES:
                return rows
            rows.append((len(rows), None if n else label, text, at, at + len(text)))
    return rows


def as_lists(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """Lists of tuples as one array, built by column."""
    ends, flat = [0], []
    for own in rows:
        flat += own
        ends.append(len(flat))
    columns = zip(*flat, strict=True) if flat else [()] * len(kind)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind)))


@F.arrow_udf(ArrayType(CLAUSE))
def _listed(texts: pa.Array) -> pa.Array:
    return as_lists([clauses_of(t) for t in texts.to_pylist()], _KIND)


def listed(text: Column) -> Column:
    """A raw text's clauses as an array (idx, label, text, start, end) in their order."""
    return _listed(text)


def clauses(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, idx, label, text, start, end): ``segment.clauses`` of raw texts after ``normalize.normalized`` and ``redact.redacted``."""
    return docs.select(*keys, F.explode_outer(listed(F.col(text))).alias("_c")).where("_c is not null").select(*keys, "_c.*")
