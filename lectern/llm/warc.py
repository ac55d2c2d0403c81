"""WARC archives: writing with deduplicated, segmented records and reading with segment reassembly.

write() turns a row of pages into a response record whose block is an HTTP response with chunked transfer framing, or
into a revisit record if a page with a smaller page_id has the same payload. Blocks over `segment` bytes continue in
continuation records, which name their origin, their number and, in the last, the total length. A task begins a new
file after `per_file` records, so that the size of a file is bounded and a huge page's segments go to several.

read() parses the files, one task for some files, groups the segments of a record by the origin's identifier, orders
them by number, verifies that none is missing and that the total length is right, and decodes the chunked framing.
Records of one segment skip the shuffle. A record that doesn't verify has ok = false and a null payload.

Cases: a null html is an empty payload. Payloads of less than `least` bytes are always responses, as are pages with a
null page_id. Rows that repeat a page_id are records of their own. Line breaks in a url are percent-encoded; a null
url is left out. Empty tables give an archive without records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.base import materialize, shared_dir

LEAST = 100
SEGMENT = 16_384
CHUNK = 4_096
PER_FILE = 500
END = "\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_RECORD = "type string, record_id string, page_id string, url string, digest string, refers_to string, origin string, number int, total long, block binary"


def cuts(data: bytes, size: int) -> list[bytes]:
    """Pieces of at most size bytes, cut between UTF-8 characters."""
    out, at = [], 0
    while at < len(data):
        to = min(len(data), at + size)
        while to < len(data) and data[to] & 0xC0 == 0x80:
            to -= 1
        out.append(data[at:to])
        at = to
    return out


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in cuts(payload, size)) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """The payload of chunked framing; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    """A record without the two line breaks that end it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def records_of(page: dict, segment: int) -> Iterator[bytes]:
    name = lambda n: f"<urn:x-record:{page['_row']}:{n}>"
    url = page["url"] if page["url"] is None else page["url"].replace("\r", "%0D").replace("\n", "%0A")
    common = {"WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": url, "X-Page-ID": page["page_id"], "WARC-Payload-Digest": f"sha256:{page['digest']}"}
    if page["refers_to"] is not None:
        yield record({"WARC-Type": "revisit", "WARC-Record-ID": name(1), **common, "WARC-Refers-To": f"<urn:x-page:{page['refers_to']}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}, b"")
        return
    block = _HTTP + chunked((page["html"] or "").encode())
    parts = cuts(block, segment)
    for n, part in enumerate(parts, 1):
        fields = {"WARC-Type": "continuation" if n > 1 else "response", "WARC-Record-ID": name(n), **(common if n == 1 else {"WARC-Date": common["WARC-Date"]})}
        if len(parts) > 1:
            fields["WARC-Segment-Number"] = n
        if n > 1:
            fields["WARC-Segment-Origin-ID"] = name(1)
            if n == len(parts):
                fields["WARC-Segment-Total-Length"] = len(block)
        yield record(fields, part)


def write(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT, per_file: int = PER_FILE) -> None:
    """Archives of pages (page_id, url, html) as gzip files in path."""
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"))
    first = base.where(F.col("page_id").isNotNull() & (F.col("n") >= least)).groupBy("digest").agg(F.min("page_id").alias("first"))
    marked = base.withColumn("_row", F.monotonically_increasing_id()).join(first, "digest", "left")
    marked = marked.withColumn("refers_to", F.when((F.col("n") >= least) & (F.col("page_id") != F.col("first")), F.col("first")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                out = [r for page in batch.slice(at, 100).to_pylist() for r in records_of(page, segment)]
                yield pa.RecordBatch.from_arrays([pa.array([r.decode() for r in out], pa.string())], ["value"])

    made = marked.select("_row", "page_id", "url", "digest", "refers_to", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html")).mapInArrow(rows, "value string")
    made.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(data: bytes) -> Iterator[dict]:
    """The records of a file, found by their lengths."""
    file = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should start")
        fields = {}
        while (line := file.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = file.read(int(fields["content-length"]))
        file.read(4)
        number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
        yield {
            "type": fields["warc-type"], "record_id": fields["warc-record-id"], "page_id": fields.get("x-page-id"), "url": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None,
            "refers_to": fields.get("warc-refers-to"), "origin": fields.get("warc-segment-origin-id"), "number": int(number) if number else None, "total": int(total) if total else None, "block": block,
        }


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files below path. A file is in memory whole; write() bounds its size."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                yield pa.RecordBatch.from_pylist(list(parse(content.as_py())), schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(rows, _RECORD)


def _payload(segments: list[dict], total: int | None) -> bytes | None:
    parts = sorted(segments, key=lambda s: s["number"])
    block = b"".join(s["block"] for s in parts)
    if [s["number"] for s in parts] != list(range(1, len(parts) + 1)) or (len(parts) > 1 and total is None) or (total is not None and total != len(block)):
        return None
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        return None
    try:
        return dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError:
        return None


def read(spark: SparkSession, path: str) -> DataFrame:
    """(type, record_id, page_id, url, digest, refers_to, ok, payload): a row for each response and revisit record."""
    found = records(spark, path)
    key = F.coalesce("origin", "record_id")
    segment = F.struct(F.coalesce("number", F.lit(1)).alias("number"), "block").alias("segment")
    one = found.where("number is null and type in ('response', 'revisit')").select("type", "record_id", "page_id", "url", "digest", "refers_to", F.array(segment).alias("segments"), "total")
    several = found.where("number is not null").withColumn("key", key).groupBy("key").agg(
        *(F.max(F.when(F.col("type") != "continuation", F.col(c))).alias(c) for c in ("type", "record_id", "page_id", "url", "digest", "refers_to")), F.collect_list(segment).alias("segments"), F.max("total").alias("total"))
    names = ["type", "record_id", "page_id", "url", "digest", "refers_to"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                payloads = []
                for kind, digest, segments, total in zip(part.column(0).to_pylist(), part.column(4).to_pylist(), part.column(6).to_pylist(), part.column(7).to_pylist(), strict=True):
                    payload = _payload(segments, total) if kind == "response" else None
                    payloads.append(payload if payload is not None and hashlib.sha256(payload).hexdigest() == digest else None)
                ok = [p is not None or k == "revisit" for p, k in zip(payloads, part.column(0).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(6)), pa.array(ok), pa.array(payloads, pa.binary())], [*names, "ok", "payload"])

    return one.unionByName(several.select(*one.columns)).mapInArrow(rows, "type string, record_id string, page_id string, url string, digest string, refers_to string, ok boolean, payload binary")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from archives written and read again."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least)
    back = read(spark, path).select(F.col("page_id").cast("long"), "type", "digest", F.expr(r"try_cast(regexp_extract(refers_to, '<urn:x-page:(-?[0-9]+)>', 1) as long)").alias("refers_to"), F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("sha"), "ok")
    back = materialize(back, "warc-records")
    origin = back.where("type = 'response' and page_id is not null").where(F.col("n") >= least).groupBy(F.col("page_id").alias("_page"), F.col("sha").alias("_sha")).agg(F.max("n").alias("_n"))
    joined = back.join(origin, (back["refers_to"] == origin["_page"]) & (back["digest"] == origin["_sha"]), "left")
    return joined.select("page_id", F.coalesce("n", "_n").alias("payload_bytes"), F.coalesce("sha", "_sha").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
