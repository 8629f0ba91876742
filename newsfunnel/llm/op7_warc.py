"""WARC archives as chunked record tables.

Writing: a payload larger than a chunk becomes a first record and `continuation` records (the
format's own segments), so no record and no row is larger than a chunk. Each chunk row carries
the running digest of its payload. Rows are written as WARC files, gzipped, by Spark's text writer:
one row is one record, the record separator is the line separator.

Reading: files are bounded in size; each is parsed by record lengths as a stream of chunk rows
(record, chunk number, running digest, bytes so far). The last row of a record has the digest and
length of the whole payload, checked against the header; the payload itself is never joined up.

Equal payloads of at least `min_bytes` are stored once: the largest page id is the response, the
others are revisit records that refer to it.

Defined results: null html is the empty payload, equal to other empty ones; a null URL has no
target header; null page ids are stored under the id "null" and read back as null; rows that
repeat a page id are stored each, and refer by their own payload; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsfunnel.llm.textkit import map_arrow, stage, table
from newsfunnel.session import run_dir

CHUNK = 1 << 20
FILE_BYTES = 16 << 20  # of payload in one archive file
MIN_BYTES = 0
DATE = "2020-01-01T00:00:00Z"  # records are the same whenever they are written

_URN = re.compile(rb"<urn:page:([^:>]*)(?::(\d+))?>")


def digest_text(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def cut_points(payload: bytes, size: int) -> list[int]:
    """Chunk borders at most `size` apart, never inside a UTF-8 character."""
    cuts, at = [0], 0
    while len(payload) - at > size:
        end = at + size
        while end > at + 1 and payload[end] & 0xC0 == 0x80:
            end -= 1
        cuts.append(end)
        at = end
    return [*cuts, len(payload)]


def _head(kind: str, fields: list[tuple[str, str]], length: int) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in fields),
             f"Content-Length: {length}"]
    return "\r\n".join(lines) + "\r\n\r\n"


def _safe(url: str) -> str:
    """No line ends inside a header field."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


_ROWS = pa.schema([("page", pa.string()), ("chunk", pa.int32()), ("digest", pa.string()), ("value", pa.string())])


def _write_rows(batches, chunk: int):
    """One row per record: (page, chunk number, running digest, the record's text)."""
    for batch in batches:
        pages, numbers, digests, values = [], [], [], []
        held = 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip((pages, numbers, digests, values), _ROWS)], schema=_ROWS)

        for page, url, html, refers in zip(*(batch.column(i) for i in range(4))):
            name, url, refers = str(page.as_py() if page.is_valid else "null"), url.as_py(), refers.as_py()
            payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
            target = [("WARC-Target-URI", _safe(url))] if url is not None else []
            whole = digest_text(hashlib.sha1(payload).digest())
            common = [("WARC-Record-ID", f"<urn:page:{name}>"), *target, ("WARC-Payload-Digest", f"sha1:{whole}")]
            if refers is not None:
                fields = [*common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                          ("WARC-Refers-To", f"<urn:page:{refers}>"), ("X-Payload-Length", str(len(payload)))]
                records = [(0, whole, _head("revisit", fields, 0))]
            else:
                records = []
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                cuts = cut_points(payload, chunk)
                running = hashlib.sha1()
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    part = payload[a:b]
                    running.update(part)
                    last = i == len(cuts) - 2
                    segment = [("WARC-Segment-Number", str(i + 1))] if len(cuts) > 2 else []
                    if i == 0:
                        fields = [*common, ("Content-Type", "application/http; msgtype=response"), *segment]
                        text, kind = http + part.decode("utf-8", "surrogatepass"), "response"
                    else:
                        fields = [("WARC-Record-ID", f"<urn:page:{name}:{i}>"), ("WARC-Segment-Origin-ID", f"<urn:page:{name}>"), *segment]
                        if last:
                            fields.append(("WARC-Segment-Total-Length", str(len(http) + len(payload))))
                        text, kind = part.decode("utf-8", "surrogatepass"), "continuation"
                    size = len(part) + (len(http) if i == 0 else 0)
                    records.append((i, digest_text(running.digest()), _head(kind, fields, size) + text))
            for i, digest, value in records:
                pages.append(name)
                numbers.append(i)
                digests.append(digest)
                values.append(value)
                held += len(value)
            if held > 4 * chunk:
                yield out()
                pages, numbers, digests, values, held = [], [], [], [], 0
        yield out()


def with_references(pages: DataFrame, min_bytes: int, files: int) -> DataFrame:
    """`pages` (page_id, url, html) with `refers_to`: the page id of the equal payload's response."""
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    digests = stage(
        pages.select("page_id", sha.alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size")), "digests")
    # Groups of two or more only: most pages are alone and need no reference.
    groups = digests.filter(F.col("size") >= min_bytes).groupBy("sha", "size").agg(
        F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1 and response is not null")
    revisits = stage(
        digests.join(groups, ["sha", "size"]).filter("page_id != response")
        .select("page_id", "sha", F.col("response").alias("refers_to")).distinct(), "revisits")
    # One shuffle places the pages in their files and meets the references, by id and payload: rows
    # may repeat an id with another payload. Pages without an id have no reference.
    return pages.withColumn("sha", sha).repartition(files, "page_id", "sha").join(
        revisits.repartition(files, "page_id", "sha"), ["page_id", "sha"], "left").drop("sha")


def write_archives(pages: DataFrame, path: str, chunk: int = CHUNK, file_bytes: int = FILE_BYTES,
                   min_bytes: int = MIN_BYTES) -> None:
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.col("html").cast("string").alias("html"))
    size = narrow.agg(F.sum(F.octet_length("html") + 600)).first()[0] or 0
    files = max(1, -(-size // file_bytes))
    placed = with_references(narrow, min_bytes, files)
    records = map_arrow(placed.select("page_id", "url", "html", "refers_to"), lambda it: _write_rows(it, chunk),
                        "page string, chunk int, digest string, value string")
    records.select("value").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse_records(buffer: memoryview):
    """(header dict, block start, block end) of every record of an archive file."""
    at, size = 0, len(buffer)
    raw = buffer.obj
    while at < size:
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("a record header is cut off")
        lines = bytes(buffer[at:end]).split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"not a record at byte {at}")
        fields = dict(line.split(b": ", 1) for line in lines[1:])
        length = int(fields[b"Content-Length"])
        start = end + 4
        if start + length > size:
            raise ValueError("a record is cut off")
        yield fields, start, start + length
        at = start + length + 4


_CHUNK_DDL = ("page_id long, chunk int, bytes_so_far long, running_digest string, last boolean, "
              "record_type string, refers_to long")
_CHUNK = pa.schema([
    ("page_id", pa.int64()), ("chunk", pa.int32()), ("bytes_so_far", pa.int64()), ("running_digest", pa.string()),
    ("last", pa.bool_()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])


def _number(urn: bytes) -> int | None:
    name = _URN.fullmatch(urn)[1]
    return None if name == b"null" else int(name)


def _chunk_rows(raw: bytes):
    view = memoryview(raw)
    state = None  # of a segmented payload: (page, wanted digest, total payload, sha1, bytes, chunks)
    for fields, start, end in parse_records(view):
        kind = fields[b"WARC-Type"]
        if kind == b"revisit":
            yield (_number(fields[b"WARC-Record-ID"]), 0, int(fields[b"X-Payload-Length"]),
                   fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), True, "revisit",
                   _number(fields[b"WARC-Refers-To"]))
            continue
        if kind == b"response":
            body = raw.find(b"\r\n\r\n", start, end) + 4
            http = dict(x.split(b": ", 1) for x in bytes(view[start:body - 4]).split(b"\r\n")[1:])
            state = [_number(fields[b"WARC-Record-ID"]), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"),
                     int(http[b"Content-Length"]), hashlib.sha1(), 0, 0]
        elif kind == b"continuation":
            body = start
        else:
            continue
        # The digest is fed from the file's buffer: no payload is copied or joined.
        state[3].update(view[body:end])
        state[4] += end - body
        last = state[4] >= state[2]
        digest = digest_text(state[3].digest())
        if last and digest != state[1]:
            raise ValueError(f"page {state[0]}: payload digest differs from the header")
        yield state[0], state[5], state[4], digest, last, "response", None
        state[5] += 1


def _read_rows(batches):
    for batch in batches:
        for content in batch.column(0):
            raw = content.as_py()
            rows = list(_chunk_rows(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CHUNK)], schema=_CHUNK)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of all archives below `path`: one row per record chunk."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return map_arrow(files, _read_rows, _CHUNK_DDL)


def records_of(chunk_table: DataFrame) -> DataFrame:
    """One row per record: what its last chunk knows of the whole payload."""
    return chunk_table.filter("last").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("running_digest").alias("payload_digest"),
        "record_type", "refers_to")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return records_of(read_archives(spark, path))
