"""WARC archives: writing records in segments, and reassembling them.

`write` makes one WARC record for each page. A block longer than a segment goes on in continuation
records, and the body of each response is framed in chunks. Of pages with equal payloads of a certain
size, the one with the largest id is a response and the others are revisit records without a body.
`read` parses the archives, groups continuation records by their origin's identifier, orders them by
segment number, verifies the total length, decodes the chunked framing and checks the digest.

The writer rolls its files after a number of records of bounded size, so that the reader, which takes a
file at a time, needs bounded memory. Archives are written and read by Spark's own sources (text,
binaryFile) and can be in any store it reaches. The reader also takes archives of other writers: gzip
members, payload digests in base 32 or not given, and records of kinds that hold no page (warcinfo,
request, metadata), which it leaves out.

Defined results: a null payload counts as empty; rows with the same id each make a record; a null id is
written as such and read back as null; a segment that is missing or a length or digest that differs
raises a ValueError that names the record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm.common import lookup, materialize, new_path

SEGMENT_BYTES = 16 * 1024
RECORDS_PER_FILE = 1000
CHUNK_BYTES = 4096
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"

#: Kinds of records that hold a page's payload, as an HTTP message or alone.
PAGES, ALONE = ("response", "revisit"), ("resource", "conversion")

_PARSED = "origin string, number int, total long, block binary, page_id string, refers_to string, digest string, kind string"
_READ = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def with_revisits(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """pages with __digest, __bytes and __refers: the id of the response that stands for the page, or null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = pages.withColumn("__digest", F.sha1(text.cast("binary"))).withColumn("__bytes", F.octet_length(text).cast("long"))
    large = known.where(F.col("__bytes") >= REVISIT_BYTES)
    groups = large.groupBy("__digest").agg(F.max(id_col).alias("__keeper"), F.count("*").alias("__n")).where("__n > 1")
    groups = materialize(groups, "payloads")
    out = lookup(known, groups, "__digest", "__n")
    other = F.col("__keeper").isNotNull() & (F.col("__bytes") >= REVISIT_BYTES) & ~F.col(id_col).eqNullSafe(F.col("__keeper"))
    return out.withColumn("__refers", F.when(other, F.col("__keeper"))).drop("__keeper")


def _head(kind: str, record: str, fields: list[tuple[str, object]], length: int) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record}>", f"WARC-Date: {DATE}"]
    lines += [f"{name}: {value}" for name, value in fields]
    return "\r\n".join([*lines, f"Content-Length: {length}", "", ""])


def _cuts(block: bytes, most: int) -> list[bytes]:
    """Parts of at most `most` bytes, none of which begins within a character."""
    parts, at = [], 0
    while at < len(block) or not parts:
        end = min(len(block), at + most)
        while end < len(block) and block[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(block[at:end])
        at = end
    return parts


def _records(record: str, page, url, digest: str, size: int, text: str | None, refers) -> Iterator[str]:
    """The records of one page, each without its last line break, which the text writer adds."""
    named = [("WARC-Target-URI", quote(url or "urn:none", safe="/:?#[]@!$&'()*+,;=%~"))]
    if page is not None:
        named.append(("X-Page-ID", quote(str(page))))
    named += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
    if refers is not None:
        block = f"{head}Content-Length: {size}\r\n\r\n"
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", quote(str(refers)))]
        yield _head("revisit", record, named + more, len(block)) + block + "\r\n"
        return
    body = [f"{len(c):x}\r\n".encode() + c + b"\r\n" for c in _cuts((text or "").encode(), CHUNK_BYTES) if c]
    block = f"{head}Transfer-Encoding: chunked\r\n\r\n".encode() + b"".join(body) + b"0\r\n\r\n"
    parts = _cuts(block, SEGMENT_BYTES)
    if len(parts) > 1:
        named.append(("WARC-Segment-Number", 1))
    yield _head("response", record, named, len(parts[0])) + parts[0].decode() + "\r\n"
    for k, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        yield _head("continuation", f"{record}:{k}", [("WARC-Segment-Origin-ID", f"<{record}>"), ("WARC-Segment-Number", k), *last], len(part)) + part.decode() + "\r\n"


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> None:
    """Archives of all pages under path, as plain WARC/1.1 files."""
    rows = with_revisits(pages.select(id_col, url_col, text_col), id_col, text_col)
    rows = rows.select(id_col, url_col, F.when(F.col("__refers").isNull(), F.col(text_col)).alias(text_col), "__digest", "__bytes", "__refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, chars = [], 0
            for page, url, text, digest, size, refers in zip(*(c.to_pylist() for c in batch.columns)):
                n += 1
                for record in _records(f"urn:record:{task}-{n}", page, url, digest, size, text, refers):
                    out.append(record)
                    chars += len(record)
                if chars > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out, chars = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    rows.mapInArrow(run, "value string").write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode().partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields (names in lower case) and the block of each record of a WARC file."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        first, *lines = archive[at:end].split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = _fields(lines)
        size = int(head["content-length"])
        block = archive[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"record {head.get('warc-record-id')} is cut short")
        yield head, block
        at = end + 4 + size
        while archive[at : at + 2] == b"\r\n":
            at += 2


def unchunk(body: bytes) -> bytes:
    """What a body in chunked transfer framing holds."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        if len(parts[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def payload(block: bytes) -> bytes | int:
    """The decoded body of an HTTP response; without a body, the length that it names."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = _fields(head.split(b"\r\n")[1:])
    if fields.get("transfer-encoding", "").lower() == "chunked":
        return unchunk(body)
    return body if body else int(fields.get("content-length", 0))


def plain_digest(named: str | None) -> str | None:
    """A SHA-1 digest field in lower-case hexadecimal; None if it isn't given or is of another kind."""
    kind, _, value = (named or "").strip().rpartition(":")
    if not value or kind.lower() not in ("", "sha1"):
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def _decoded(name: str, block: bytes, digest: str | None, kind: str) -> tuple[int, str | None]:
    """Bytes and digest of a record's payload; a revisit without a body has what its header fields say."""
    body = block if kind in ALONE else payload(block)
    if kind == "revisit":
        return body if isinstance(body, int) else len(body), digest
    body = b"" if isinstance(body, int) else body
    found = hashlib.sha1(body).hexdigest()
    if digest is not None and found != digest:
        raise ValueError(f"record {name}: the payload's digest differs")
    return len(body), found


def join_segments(name: str, parts: list[dict]) -> bytes:
    """The block of a record from its segments (number, total, block), by number, verified against the total length."""
    parts = sorted(parts, key=lambda p: p["number"])
    if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError(f"record {name}: a segment is missing or double")
    block = b"".join(p["block"] for p in parts)
    if parts[-1]["total"] != len(block):
        raise ValueError(f"record {name}: {len(block)} bytes, not {parts[-1]['total']}")
    return block


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per record that is no continuation: page_id (as text), payload_bytes, payload_digest, record_type, refers_to."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("page_id", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("kind", pa.string()), ("bytes", pa.int64())])
        for batch in batches:
            for content in batch.column(0):
                archive, rows = content.as_py(), []
                for head, block in parse(gzip.decompress(archive) if archive[:2] == b"\x1f\x8b" else archive):
                    own, kind, number = head["warc-record-id"], head["warc-type"], int(head.get("warc-segment-number", 0))
                    row = {"origin": head.get("warc-segment-origin-id", own), "number": number, "total": int(head.get("warc-segment-total-length", -1))}
                    if kind != "continuation":
                        page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
                        row |= {"kind": kind if kind in PAGES + ALONE else "other", "page_id": page and unquote(page), "refers_to": refers and unquote(refers), "digest": plain_digest(head.get("warc-payload-digest"))}
                    if number:
                        row["block"] = block
                    elif row["kind"] != "other":
                        row["bytes"], row["digest"] = _decoded(own, block, row["digest"], row["kind"])
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    records = files.mapInArrow(scan, _PARSED + ", bytes long")
    segment = F.when(F.col("number") > 0, F.struct("number", "total", "block"))
    whole = records.groupBy("origin").agg(
        F.collect_list(segment).alias("parts"),
        *[F.max(c).alias(c) for c in ("page_id", "refers_to", "digest", "kind", "bytes")],
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["kind"] == "other":
                    continue
                if r["parts"]:
                    r["bytes"], r["digest"] = _decoded(r["origin"], join_segments(r["origin"], r["parts"]), r["digest"], r["kind"])
                rows.append((r["page_id"], r["bytes"], r["digest"], r["kind"], r["refers_to"]))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return whole.mapInArrow(decode, _READ)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", path: str | None = None) -> DataFrame:
    """Write all pages and read the archives back."""
    path = path or new_path(pages.sparkSession, "archives")
    write(pages, path, id_col, url_col, text_col)
    kind = pages.schema[id_col].dataType
    found = read(pages.sparkSession, path)
    return found.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
