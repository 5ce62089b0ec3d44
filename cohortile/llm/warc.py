"""WARC archives: writing, reading back and revisit resolution.

Pages are written as WARC 1.1 response records, one archive per task, gzip-compressed. To resolve
revisits only the headers are shuffled, by payload digest: of records with one digest and length the
first stays a response, the others become revisit records that refer to it. The deduplicated archives
get fresh headers (record id, lengths, block and payload digests), and the archives that were written
are read again and every revisit is joined to the response it names.

Defined results: a null payload is an empty one. Payloads below ``least`` bytes are always
responses. Of rows with one page id and payload one is the response, the others revisit it; a null
page id comes after every other. Control characters and spaces of a URL are percent-encoded, a null
URL has no Target-URI. An empty table gives an empty archive and result. Other columns are not
looked at. A payload may hold anything, record headers included: records are read by their length.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortile.llm.common import keyed, scanned, stored, table
from cohortile.session import run_dir

LEAST_BYTES = 100
#: Archives are sized so that one file, which one task reads, holds about this much payload.
ARCHIVE_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # pages carry no time of capture
ROW = ["_f", "_r"]
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _urn(f: int, r: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=(f % 2**64).to_bytes(8, 'big') + (r % 2**64).to_bytes(8, 'big'))}>"


def _clean(url: bytes) -> bytes:
    return b"".join(b"%%%02X" % c if c <= 32 or c == 127 else bytes((c,)) for c in url)


def record(f: int, r: int, page_id: int | None, url: bytes | None, payload: bytes, sha: bytes, original=None) -> bytes:
    """One record without its closing line ends. ``original``: (_f, _r, page id) that a revisit refers to."""
    http = HTTP % len(payload)
    block = http if original else http + payload
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if original else b"response"), b"WARC-Record-ID: " + _urn(f, r).encode(),
             b"WARC-Date: " + DATE.encode()]
    if page_id is not None:
        lines.append(b"WARC-Page-ID: %d" % page_id)
    if url is not None:
        lines.append(b"WARC-Target-URI: " + _clean(url))
    if original:
        lines += [b"WARC-Profile: " + PROFILE.encode(), b"WARC-Refers-To: " + _urn(*original[:2]).encode()]
    lines += [b"WARC-Payload-Digest: sha256:" + sha.hex().encode(),
              b"WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()),
              b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def _records(batches):
    for batch in batches:
        c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        out = []
        for i in range(batch.num_rows):
            payload = c["payload"][i] or b""
            original = None if c["of_f"][i] is None else (c["of_f"][i], c["of_r"][i])
            out.append(record(c["_f"][i], c["_r"][i], c["page_id"][i], c["url"][i], payload, hashlib.sha256(payload).digest(), original))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def write_archives(records: DataFrame, path: str) -> None:
    """Write (record binary) rows as gzip-compressed archives, a file for each task.

    Records end with two line ends, which is what the text writer puts after every row.
    """
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


class _Reader:
    """Bytes of a gzip file, a piece at a time."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.buffer = raw, 0, bytearray()
        self.unzip = zlib.decompressobj(31)

    def more(self) -> bool:
        while self.at < len(self.raw) or self.unzip.unconsumed_tail:
            piece = self.unzip.unconsumed_tail
            if not piece:
                piece = self.raw[self.at:self.at + 65536]
                self.at += len(piece)
            got = self.unzip.decompress(piece, 1 << 20)
            if self.unzip.eof:  # an archive may be many gzip members
                self.at -= len(self.unzip.unused_data)
                self.unzip = zlib.decompressobj(31)
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self.more():
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[:i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def parse(raw: bytes):
    """(headers, HTTP head, payload) of every record of a gzip-compressed archive."""
    reader = _Reader(raw)
    while (head := reader.until(b"\r\n\r\n")) is not None:
        lines = head.split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower().decode(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        block = reader.take(int(headers["content-length"]))
        reader.take(4)
        http, _, payload = block.partition(b"\r\n\r\n")
        yield headers, http, payload


def _number(urn: bytes) -> tuple[int, int]:
    raw = uuid.UUID(urn[1:-1].decode().removeprefix("urn:uuid:")).bytes
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


HEADERS = "_f long, _r long, page_id long, url binary, record_type string, of_f long, of_r long, payload_bytes long, payload_digest string"


def _headers(batches):
    for batch in batches:
        for raw in batch.column(0):  # one archive at a time
            rows = []
            for h, _, payload in parse(raw.as_py()):
                kind, sha = h["warc-type"].decode(), h["warc-payload-digest"].decode().removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != sha:
                    raise ValueError(f"record {h['warc-record-id']!r} is damaged")
                of = _number(h["warc-refers-to"]) if kind == "revisit" else (None, None)
                page = h.get("warc-page-id")
                rows.append((*_number(h["warc-record-id"]), None if page is None else int(page), h.get("warc-target-uri"), kind, *of,
                             len(payload) if kind == "response" else None, sha))
            cols = list(zip(*rows)) if rows else [()] * 9
            kinds = [pa.int64()] * 3 + [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=[x.split()[0] for x in HEADERS.split(", ")])


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Headers of all records under ``path``, each response checked against its payload digest."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(_headers, HEADERS)


def resolve(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(_f, _r, of_f, of_r): the rows that revisit another row's payload, from headers alone."""
    large = headers.filter(F.col("payload_bytes") >= least)
    # nulls last: a struct that begins with a null flag
    first = large.groupBy("payload_digest", "payload_bytes").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", *ROW)).alias("first")).filter("n > 1")
    first = stored(first, "first-payloads")
    return (large.join(first, ["payload_digest", "payload_bytes"])
            .select(*ROW, F.col("first._f").alias("of_f"), F.col("first._r").alias("of_r"))
            .filter(~((F.col("_f") == F.col("of_f")) & (F.col("_r") == F.col("of_r")))))


def deduplicated(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 least: int = LEAST_BYTES) -> None:
    """Write ``pages`` to archives under ``path`` in which equal payloads of at least ``least`` bytes are kept once."""
    pages = scanned(pages)
    rows = keyed(pages, F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("binary").alias("url"),
                 F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    headers = stored(rows.select(*ROW, "page_id", F.length("payload").cast("long").alias("payload_bytes"),
                                 F.sha2("payload", 256).alias("payload_digest")), "warc-headers")
    revisits = stored(resolve(headers, least), "warc-revisits")
    total = headers.agg(F.sum("payload_bytes")).first()[0] or 0
    files = max(1, -(-total // ARCHIVE_BYTES), pages.sparkSession.sparkContext.defaultParallelism)
    # payloads move once, to the archive that will hold them; revisits leave theirs behind
    dealt = rows.repartition(files, *ROW).join(revisits, ROW, "left")
    write_archives(dealt.mapInArrow(_records, "record binary"), path)


def read_resolved(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): records read from the archives, revisits
    joined to the responses they name."""
    found = stored(read_headers(spark, path), "warc-read")
    responses = found.filter("record_type = 'response'")
    asked = found.filter("record_type = 'revisit'")
    named = responses.select(F.col("_f").alias("of_f"), F.col("_r").alias("of_r"), F.col("page_id").alias("refers_to"),
                             F.col("payload_bytes").alias("original_bytes"), F.col("payload_digest").alias("original_digest"))
    joined = asked.join(named, ["of_f", "of_r"], "left")
    whole = F.when(F.col("original_digest") == F.col("payload_digest"), F.col("original_bytes"))
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        joined.select("page_id", whole.alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "warc")
    deduplicated(table(spark, sf_dir, "pages"), path)
    return read_resolved(spark, path)


OP3_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""
