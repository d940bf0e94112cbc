"""WARC archives: writing with segmentation and chunked framing, reading with reassembly.

Writer: a response record's block is an HTTP response whose body has chunked transfer framing;
a block longer than ``SEGMENT`` bytes is cut into a first record and continuation records, which
name the first one's id (WARC-Segment-Origin-ID), count from 1 (WARC-Segment-Number), and the
last of which states the whole length (WARC-Segment-Total-Length).  Of records with equal
payloads of at least ``DEDUP`` bytes the one with the smallest id is stored, the others revisit
it; which these are is settled on ids and digests alone, payloads are not moved by digest.
A record's name is made of the row's id and its payload's digest; rows repeated as a whole get a
random ending besides, and a revisit of such a row names what they have in common.  A revisit states its
payload's digest and, in an extension field, its length.
Records are gathered into blocks of about ``GATHER`` bytes and files of at most ``FILE`` blocks, plain
WARC 1.1 files that any reader takes.

Reader: files are parsed by their headers and content lengths.  Segments are grouped by origin
id, ordered by number, checked against the stated total and the count from 1 on, joined, and the
chunked framing is decoded; records that are not segmented are decoded where they are parsed.  Payloads are held against
their stated digests.

Defined results: null payloads are empty; a group with a missing, repeated or surplus segment, or
a wrong total, a body whose framing is broken and a payload that differs from its digest give a record with a null payload and the
reason in ``problem``; an empty table gives an empty result.  Rows without an id are responses; rows that share an id are
records of their own.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import core

SEGMENT = 1 << 13
FRAME = 1 << 12
DEDUP = 100
GATHER = 1 << 21
FILE = 8
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
#: Extension field of revisits.
LENGTH = "X-Payload-Length"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, frame: int = FRAME) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(payload[s : s + frame]), payload[s : s + frame]) for s in range(0, len(payload), frame)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; extensions and trailers are allowed, anything else raises ValueError."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = re.match(rb"[0-9A-Fa-f]+", body[at:line]) if line >= 0 else None
        if not size:
            raise ValueError("chunk size expected")
        n = int(size[0], 16)
        at = line + 2
        if not n:
            end = body.find(b"\r\n\r\n", line)
            if end != len(body) - 4:
                raise ValueError("bytes after the last chunk" if end >= 0 else "no end of the trailer")
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk is shorter than its size")
        parts.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    """Body of an HTTP response, without its transfer framing."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        raise ValueError("not an HTTP response")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


def record(kind: str, name: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block


def records_of(name: str, uri: str, payload: bytes, digest: str, refers_to: str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, each without its closing line ends."""
    # A URI's line breaks would end the header.
    common = [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record("revisit", name, [*common, (LENGTH, str(len(payload))), ("WARC-Profile", profile), ("WARC-Refers-To", f"<{refers_to}>"), ("Content-Type", "application/http; msgtype=response")], HTTP)
        return
    block = HTTP + chunked(payload)
    whole = len(block) <= segment
    first = [*common, ("Content-Type", "application/http; msgtype=response")]
    yield record("response", name, first if whole else [*first, ("WARC-Segment-Number", "1")], block[:segment])
    cuts = range(segment, len(block), segment)
    for number, at in enumerate(cuts, 2):
        fields = [("WARC-Target-URI", common[0][1]), ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", str(number))]
        if at + segment >= len(block):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record("continuation", f"{name}.{number}", fields, block[at : at + segment])


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed file."""
    at = 0
    while at < len(data):
        end = data.find(END, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            if not data[at:].strip():
                return
            raise ValueError(f"no record at byte {at}")
        fields = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        start = end + 4
        stop = start + int(fields["content-length"])
        if stop > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        yield fields, data[start:stop]
        at = stop
        while data.startswith(b"\r\n", at):
            at += 2


def _write(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            # The text sink puts the line ends that close a record after each row.
            return pa.RecordBatch.from_pydict({"block": pa.array([END.join(held)], pa.binary())})

        for batch in batches:
            for i in range(batch.num_rows):
                key, uri, payload, digest, refers, again = (batch.column(c)[i].as_py() for c in range(6))
                name = f"urn:page:{'none' if key is None else key}:{digest}" + f":{uuid.uuid4().hex}" * again
                for x in records_of(name, uri or "", payload, digest, None if refers is None else f"urn:page:{refers}:{digest}", segment):
                    held.append(x)
                    size += len(x)
                    if size >= GATHER:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return run


def write(pages: DataFrame, path: str, dedup: int = DEDUP, segment: int = SEGMENT, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> None:
    """Write one or more records for each row to WARC files under ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).alias("uri"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    light = rows.groupBy("id", "digest", F.octet_length("payload").alias("size")).agg(F.count("*").alias("n"))
    first = light.where(F.col("size") >= dedup).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("ids")).where("ids > 1").drop("ids")
    refers = F.when(F.col("first") < F.col("id"), F.col("first"))
    marked = light.join(first, "digest", "left").select(core.key("id").alias("key"), "digest", refers.alias("refers"), (F.col("n") > 1).alias("again"))
    # Read from storage, so that its size is known: payloads stay where they are while few rows are marked.
    marked = core.stored(marked.where("again or refers is not null"))
    told = rows.withColumn("key", core.key("id")).join(marked, ["key", "digest"], "left").select("id", "uri", "payload", "digest", "refers", F.coalesce("again", F.lit(False)).alias("again"))
    blocks = core.arrow(told, _write(segment), "block binary")
    with core.released(pages.sparkSession):
        blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", FILE).text(path)


SEGMENTS = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("type", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("block", pa.binary())])
SEGMENTS_DDL = "origin string, number int, total long, type string, uri string, digest string, block binary"
DECODED = "origin string, type string, uri string, digest string, length long, refers_to string, payload binary, problem string"
_DECODED = pa.schema([("origin", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("length", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows, about ``core.CHUNK`` bytes of their binary values in each."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= core.CHUNK or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _bare(x: str | None) -> str | None:
    return None if x is None else x.strip("<>")


def _stated(fields: dict[str, str]) -> str | None:
    digest = fields.get("warc-payload-digest")
    return digest and digest.partition(":")[2]


def decoded(block: bytes, digest: str | None) -> tuple[bytes | None, str | None]:
    """(payload, problem) of a response's block."""
    try:
        payload = payload_of(block)
    except ValueError as error:
        return None, str(error)
    if digest and hashlib.sha256(payload).hexdigest() != digest:
        return None, "payload differs from its digest"
    return payload, None


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield from parse(batch.column(0)[i].as_py())


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files to the records that are not segmented."""

    def rows() -> Iterator[tuple]:
        for f, block in _records(batches):
            kind = f.get("warc-type")
            if kind in ("response", "revisit") and "warc-segment-number" not in f:
                payload, problem = decoded(block, _stated(f)) if kind == "response" else (None, None)
                length = len(payload) if payload is not None else int(f[LENGTH.lower()]) if LENGTH.lower() in f else None
                yield _bare(f["warc-record-id"]), kind, f.get("warc-target-uri"), _stated(f), length, _bare(f.get("warc-refers-to")), payload, problem

    return _batched(rows(), _DECODED)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files to the segments of segmented records."""

    def rows() -> Iterator[tuple]:
        for f, block in _records(batches):
            kind = f.get("warc-type")
            if kind == "continuation" or kind == "response" and "warc-segment-number" in f:
                total = f.get("warc-segment-total-length")
                origin = _bare(f["warc-segment-origin-id"] if kind == "continuation" else f["warc-record-id"])
                yield origin, int(f.get("warc-segment-number", 1)), int(total) if total else None, kind, f.get("warc-target-uri"), _stated(f), block

    return _batched(rows(), SEGMENTS)


def reassemble(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """Block of a segmented record from its (number, stated total, bytes), in any order."""
    segments = sorted(segments, key=lambda x: x[0])
    if [n for n, _, _ in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("segments are missing or repeated")
    block = b"".join(b for _, _, b in segments)
    if segments[-1][1] != len(block):
        raise ValueError("segments do not have the stated total length")
    return block


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """origin, type, uri, digest, parts (number, total, block) -> records."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, kind, uri, digest, parts = (batch.column(c)[i].as_py() for c in range(5))
                payload, problem = None, None
                try:
                    block = reassemble([(p["number"], p["total"], p["block"]) for p in parts])
                    payload, problem = decoded(block, digest) if kind else (None, "segments without a first record")
                except ValueError as error:
                    problem = str(error)
                yield name, kind, uri, digest, None if payload is None else len(payload), None, payload, problem

    return _batched(rows(), _DECODED)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record: origin (record id), type, uri, digest, length, refers_to, payload, problem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    whole = core.arrow(files, _whole, DECODED)
    # One record's segments are grouped: no more than a page's payload.
    head = {c: F.max(F.when(F.col("type") != "continuation", F.col(c))).alias(c) for c in ("type", "uri", "digest")}
    groups = core.arrow(files, _segments, SEGMENTS_DDL).groupBy("origin").agg(*head.values(), F.collect_list(F.struct("number", "total", "block")).alias("parts"))
    return whole.unionByName(core.arrow(groups.select("origin", "type", "uri", "digest", "parts"), _joined, DECODED))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = core.shared_folder(spark)
    write(core.documents(spark, sf_dir, "pages"), path)
    rows = read(spark, path)
    page = lambda name: F.nullif(F.regexp_extract(name, "^urn:page:(-?[0-9]+):", 1), F.lit("")).cast("long")
    # Of a response both are taken from the payload that was read.
    digest = F.when(F.col("type") == "response", F.sha2("payload", 256)).otherwise(F.col("digest"))
    return rows.select(page("origin").alias("page_id"), F.col("length").alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and first_id < page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and first_id < page_id then first_id end as refers_to
from f
"""
