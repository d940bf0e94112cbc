"""Signature sniffing of media columns.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a value.  At
each hit the format's validator reads the structure (chunk chains, checksums, lengths, end
marks) and returns where the medium ends, or nothing.  The medium that starts at the
value's first byte gives its type, which corrects the declared one; media that start later, and
are not inside a chunk-checked one of the same value, are carved out as embedded.

Defined results: null and empty values have type null and no media; a value that no validator
accepts has type null and keeps no declared type; hits inside an accepted medium are reported
as embedded, so nothing that validates is lost; ties go to the format first by name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import core

#: Bytes that a payload is padded to a multiple of, the byte it is padded with, and samples a second.
UNIT = 576
PAD = b"\xff"
RATE = 8000

#: Magic bytes and their place in the file, by type; fixed values of the formats.
SIGNATURES: dict[str, tuple[tuple[bytes, int], ...]] = {
    "application/gzip": ((b"\x1f\x8b\x08", 0),),
    "application/pdf": ((b"%PDF-", 0),),
    "application/zip": ((b"PK\x03\x04", 0),),
    "audio/flac": ((b"fLaC", 0),),
    "audio/wav": ((b"WAVEfmt ", 8),),
    "image/bmp": ((b"BM", 0),),
    "image/gif": ((b"GIF87a", 0), (b"GIF89a", 0)),
    "image/jpeg": ((b"\xff\xd8\xff", 0),),
    "image/png": ((b"\x89PNG\r\n\x1a\n", 0),),
    "image/webp": ((b"WEBPVP8", 8),),
    "video/mp4": ((b"ftyp", 4),),
}


def _riff(data: bytes, at: int, kind: bytes) -> int | None:
    if data[at : at + 4] != b"RIFF" or len(data) < at + 12 or data[at + 8 : at + 12] != kind:
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    pos, seen = at + 12, set()
    if end > len(data):
        return None
    while pos + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, pos)
        seen.add(name)
        pos += 8 + size + (size & 1)
    return end if pos in (end, end + 1) and seen else None


def _wav(data: bytes, at: int) -> int | None:
    end = _riff(data, at, b"WAVE")
    if end is None or struct.unpack_from("<I", data, at + 16)[0] < 16:
        return None
    kind, channels, rate, byte_rate, align, bits = struct.unpack_from("<HHIIHH", data, at + 20)
    return end if channels and align == channels * ((bits + 7) // 8) and byte_rate == rate * align or kind != 1 else None


def _png(data: bytes, at: int) -> int | None:
    pos = at + 8
    if data[pos + 4 : pos + 8] != b"IHDR":
        return None
    while pos + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, pos)
        if pos + 12 + size > len(data) or zlib.crc32(data[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", data, pos + 8 + size)[0]:
            return None
        pos += 12 + size
        if name == b"IEND":
            return pos
    return None


def _gif(data: bytes, at: int) -> int | None:
    if len(data) < at + 13:
        return None

    def blocks(p: int) -> int | None:
        while p < len(data):
            if not data[p]:
                return p + 1
            p += data[p] + 1
        return None

    flags = data[at + 10]
    pos: int | None = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while pos is not None and pos < len(data):
        mark = data[pos]
        if mark == 0x3B:
            return pos + 1
        if mark == 0x21:
            pos = blocks(pos + 2)
        elif mark == 0x2C and pos + 10 <= len(data):
            local = data[pos + 9]
            pos = blocks(pos + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(data: bytes, at: int) -> int | None:
    pos, scan = at + 2, False
    while pos + 4 <= len(data):
        if data[pos] != 0xFF:
            return None
        mark = data[pos + 1]
        if mark == 0xFF:
            pos += 1
            continue
        if not 0xC0 <= mark <= 0xFE or mark == 0xD8:
            return None
        size = struct.unpack_from(">H", data, pos + 2)[0]
        if size < 2:
            return None
        pos += 2 + size
        if mark == 0xDA:
            scan = True
            while True:
                pos = data.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(data):
                    return None
                if data[pos + 1] == 0xD9:
                    return pos + 2
                if data[pos + 1] == 0 or 0xD0 <= data[pos + 1] <= 0xD7:
                    pos += 2
                else:
                    break
    return pos if scan and pos == len(data) else None


def _bmp(data: bytes, at: int) -> int | None:
    if len(data) < at + 26:
        return None
    size, reserved, offset, header = struct.unpack_from("<IIII", data, at + 2)
    ok = header in (12, 40, 52, 56, 64, 108, 124) and not reserved and 14 + header <= offset <= size and at + size <= len(data)
    return at + size if ok else None


def _gzip(data: bytes, at: int) -> int | None:
    reader = zlib.decompressobj(31)
    pos = at
    try:
        while not reader.eof:
            part = reader.unconsumed_tail or data[pos : pos + 65536]
            if not part:
                return None
            pos += 0 if reader.unconsumed_tail else len(part)
            reader.decompress(part, 1 << 20)
    except zlib.error:
        return None
    return pos - len(reader.unused_data)


def _zip(data: bytes, at: int) -> int | None:
    end = data.find(b"PK\x05\x06", at)
    while end >= 0 and end + 22 <= len(data):
        entries, size, offset, note = struct.unpack_from("<HIIH", data, end + 10)
        if at + offset + size == end and end + 22 + note <= len(data) and (not entries or data[at + offset : at + offset + 4] == b"PK\x01\x02"):
            return end + 22 + note
        end = data.find(b"PK\x05\x06", end + 1)
    return None


def _pdf(data: bytes, at: int) -> int | None:
    end = data.find(b"%%EOF", at)
    return end + 5 if end >= 0 and data.find(b"startxref", at, end) >= 0 else None


def _flac(data: bytes, at: int) -> int | None:
    pos, first = at + 4, True
    while pos + 4 <= len(data):
        kind, size = data[pos], int.from_bytes(data[pos + 1 : pos + 4], "big")
        if first and (kind & 0x7F or size != 34):
            return None
        pos, first = pos + 4 + size, False
        if kind & 0x80:
            return len(data) if data[pos : pos + 2] in (b"\xff\xf8", b"\xff\xf9") else None
    return None


def _mp4(data: bytes, at: int) -> int | None:
    pos, seen = at, set()
    while pos + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, pos)
        if not name.isalnum() or size < 8 or pos + size > len(data):
            break
        seen.add(name)
        pos += size
    return pos if {b"ftyp", b"moov"} <= seen else None


VALIDATORS: dict[str, Callable[[bytes, int], int | None]] = {
    "application/gzip": _gzip, "application/pdf": _pdf, "application/zip": _zip, "audio/flac": _flac, "audio/wav": _wav, "image/bmp": _bmp,
    "image/gif": _gif, "image/jpeg": _jpeg, "image/png": _png, "image/webp": lambda data, at: _riff(data, at, b"WEBP"), "video/mp4": _mp4,
}


def automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for kind, magics in SIGNATURES.items():
        for magic, place in magics:
            machine.add_word(magic.decode("latin-1"), (kind, place, len(magic)))
    machine.make_automaton()
    return machine


def find_media(data: bytes, machine) -> list[tuple[int, int, str]]:
    """(start, end, type) of everything that validates, by start and type."""
    found = set()
    for last, (kind, place, length) in machine.iter(data.decode("latin-1")):
        start = last - length + 1 - place
        if start >= 0 and (end := VALIDATORS[kind](data, start)) is not None:
            found.add((start, end, kind))
    return sorted(found)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Mono 8-bit PCM whose samples are the payload's bytes."""
    size = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size + (size & 1), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", size)
    return head + payload + b"\0" * (size & 1)


def from_wav(data: bytes) -> bytes:
    """The samples of a validated file's data chunk."""
    pos = 12
    while pos + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, pos)
        if name == b"data":
            return data[pos + 8 : pos + 8 + size]
        pos += 8 + size + (size & 1)
    return b""


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, buf, offs in core.chunks(batch.column(1)):
            data = buf.tobytes()
            out = []
            for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                out.append(to_wav(data[s:e] + PAD * (UNIT - (e - s) if e == s else -(e - s) % UNIT)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array((offs[1:] - offs[:-1])), pa.array(["application/octet-stream"] * (to - at)), pa.array(out, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, declared type and media: whole texts, padded, as 8-bit sound."""
    return core.arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), _encode, "doc_id long, n_bytes long, declared string, media binary")


SNIFFED = pa.schema([
    ("id", pa.int64()), ("declared", pa.string()), ("type", pa.string()), ("corrected", pa.bool_()), ("end", pa.int64()),
    ("embedded", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string()), ("sha256", pa.string())]))), ("media", pa.binary()),
])


def _sniff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = automaton()
    for batch in batches:
        out: dict[str, list] = {k: [] for k in SNIFFED.names}
        size = 0
        for i in range(batch.num_rows):
            data = batch.column(2)[i].as_py()
            found = find_media(data or b"", machine)
            whole = next(((e, k) for s, e, k in found if not s), (None, None))
            rest = [{"start": s, "end": e, "type": k, "sha256": hashlib.sha256(data[s:e]).hexdigest()} for s, e, k in found if s]
            declared = batch.column(1)[i].as_py()
            for k, v in zip(out, (batch.column(0)[i].as_py(), declared, whole[1], whole[1] != declared, whole[0], rest, data), strict=True):
                out[k].append(v)
            size += len(data or b"")
            if size >= core.CHUNK:
                yield pa.RecordBatch.from_pydict(out, schema=SNIFFED)
                out, size = {k: [] for k in out}, 0
        yield pa.RecordBatch.from_pydict(out, schema=SNIFFED)


def sniff(rows: DataFrame, id_col: str, declared_col: str, media_col: str) -> DataFrame:
    """id, declared, type, corrected, end, embedded (start, end, type, sha256) and media of each value."""
    return core.arrow(rows.select(F.col(id_col).alias("id"), F.col(declared_col).alias("declared"), F.col(media_col).alias("media")), _sniff, "id long, declared string, type string, corrected boolean, end long, embedded array<struct<start:long,end:long,type:string,sha256:string>>, media binary")


#: The padding byte occurs in no UTF-8 text, so it tells where a text ends.
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")}
        for x in batch.column(2):
            media = x.as_py()
            payload = from_wav(media)
            for k, v in zip(out, (len(payload.rstrip(PAD)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **{k: pa.array(v, pa.string() if k.endswith("sha256") else pa.int64()) for k, v in out.items()}, "feature": batch.column(1)})


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = core.stored(encode(core.documents(spark, sf_dir)))
    sniffed = sniff(rows, "doc_id", "declared", "media")
    feature = F.concat_ws(";", "type", F.col("corrected").cast("string"), F.col("end").cast("string"), F.concat_ws(",", F.transform("embedded", lambda x: F.concat_ws("@", x["type"], x["start"].cast("string"), x["end"].cast("string")))))
    digest = core.arrow(sniffed.select("id", feature.alias("feature"), "media"), _digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return digest
