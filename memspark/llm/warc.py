"""WARC archives: write captures, read them back, and assemble each transaction.

A capture is written as three records: the request, the response (or a revisit of an equal payload)
and a metadata record. Request and metadata name the middle record in ``WARC-Concurrent-To``; reading
back, records that share such an anchor become one nested row.

Archives go through Spark's text writer with the record terminator as line separator, so task commits
keep them whole when an executor is lost and any file system Spark can write will do. They come back
as binary files and are parsed by ``Content-Length``, so payloads may hold any bytes.

Edge cases: a null payload is empty, a null url leaves the header out and control characters in a url
become ``%20``; a null page_id leaves the metadata field out and never owns a payload unless all its
copies are null. Rows equal in (page_id, url, payload) share one record id; they come back as one
capture with ``copies`` > 1. An empty table gives no captures. Other columns are ignored. A broken archive
raises ``ValueError``.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.tables import table
from memspark.session import materialize, scratch_path

#: Payloads of fewer bytes are never written as revisits.
REVISIT_BYTES = 1000
CRLF = "\r\n"
RECORD_END = CRLF * 2
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = (
    "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, "
    "fields string, payload_bytes long, payload_digest string, declared_digest string, payload binary"
)
_ARROW = pa.schema([
    ("warc_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
    ("fields", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("declared_digest", pa.string()), ("payload", pa.binary()),
])
_BATCH_BYTES = 4 << 20


def record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """A stable ``urn:uuid`` of a capture."""
    name = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest, F.coalesce(url, F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def plan_captures(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Captures with their role: page_id, url, payload, digest, record_id, refers_to (null: a response).

    Owners of repeated payloads come from one combined aggregate; payloads below the limit never shuffle.
    A payload shared by many rows is one skewed key of a join, which adaptive execution splits.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    big = F.octet_length("payload") >= min_bytes
    owners = (
        rows.filter(big).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("owner"))
        .filter("n > 1").select("digest", "owner")
    )
    shared = rows.filter(big).join(owners, "digest", "left").select(*rows.columns, "owner")
    alone = rows.filter(~big).withColumn("owner", F.lit(None).cast(shared.schema["owner"].dataType))
    captures = shared.unionByName(alone)
    revisit = F.col("owner").isNotNull() & ~F.struct("page_id", "url").eqNullSafe(F.col("owner"))
    return captures.select(
        "page_id", "url", "payload", "digest", record_id(F.col("page_id"), F.col("url"), F.col("digest")).alias("record_id"),
        F.when(revisit, record_id(F.col("owner.page_id"), F.col("owner.url"), F.col("digest"))).alias("refers_to"),
    )


def _record(warc_type: Column, ident: Column, uri: Column, headers: list[Column], block: Column, content: str) -> Column:
    """One record as text without its terminator; null headers are left out."""
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), warc_type), F.concat(F.lit("WARC-Record-ID: "), ident),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"), F.concat(F.lit("WARC-Target-URI: "), uri), *headers, F.lit(f"Content-Type: {content}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit(CRLF * 2), block)


def capture_records(captures: DataFrame) -> DataFrame:
    """The three records of every capture as ``value``, side by side."""
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    anchor, revisit = F.col("record_id"), F.col("refers_to").isNotNull()
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), anchor)

    def beside(kind: str) -> Column:
        return F.concat(F.regexp_replace(anchor, ">$", ""), F.lit(f":{kind}>"))

    main = _record(
        F.when(revisit, "revisit").otherwise("response"), anchor, uri,
        [
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"), F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
            F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        ],
        F.when(revisit, F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), "payload")), "application/http; msgtype=response",
    )
    request = _record(F.lit("request"), beside("request"), uri, [concurrent], F.lit(f"GET / HTTP/1.1{CRLF}{CRLF}"), "application/http; msgtype=request")
    fields = F.concat_ws("", F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit(f"via: table{CRLF}"))
    metadata = _record(F.lit("metadata"), beside("metadata"), uri, [concurrent], fields, "application/warc-fields")
    return captures.select(F.explode(F.array(request, main, metadata)).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write ``value`` records as gzipped archives, one per task."""
    records.select("value").write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-cased names) and block of every record of one archive."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError("archive ends inside a header")
            name, _, value = line.decode("utf-8").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != RECORD_END.encode():
            raise ValueError(f"record {head.get('warc-record-id')} is cut short")
        yield head, block


def _row(head: dict[str, str], block: bytes, with_payload: bool) -> dict:
    kind = head.get("warc-type")
    http = head.get("content-type", "").startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    digest = head.get("warc-payload-digest", "")
    return {
        "warc_type": kind, "record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"),
        "target_uri": head.get("warc-target-uri"), "fields": block.decode("utf-8", "replace") if kind == "metadata" else None,
        "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "declared_digest": digest.rpartition(":")[2] or None,
        "payload": payload if with_payload else None,
    }


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives below ``path``; digest and length are computed from the block."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for content in batch.column(0):
                with gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())) as archive:
                    for head, block in parse_records(io.BufferedReader(archive, 1 << 18)):
                        rows.append(_row(head, block, with_payload))
                        held += 300 + len(block) * with_payload
                        if held > _BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, copies, request, response, metadata (an array).

    The anchor of a record is what it is concurrent to, else itself. ``response`` is the response or
    revisit record. A capture without one keeps a null there; equal records count once.
    """
    body = F.struct("record_id", "warc_type", "refers_to", "target_uri", "payload_bytes", "payload_digest", "declared_digest", "payload")
    main = F.col("warc_type").isin("response", "revisit")
    return records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        F.count(F.when(main, 1)).alias("copies"),
        F.first(F.when(F.col("warc_type") == "request", body), ignorenulls=True).alias("request"),
        F.first(F.when(main, body), ignorenulls=True).alias("response"),
        F.collect_set(F.when(F.col("warc_type") == "metadata", F.struct("record_id", "target_uri", "fields"))).alias("metadata"),
    )


def metadata_field(name: str) -> Column:
    """A field of the first metadata record that has it."""
    found = F.transform("metadata", lambda m: F.regexp_extract(m["fields"], rf"(?m)^{name}: (.*?)\r?$", 1))
    return F.get(F.filter(found, lambda v: v != ""), F.lit(0))


def resolve_revisits(captures: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``target``, the ``columns`` of the capture a revisit refers to (null for responses)."""
    target = captures.filter("response.warc_type = 'response'").select(F.col("capture_id").alias("_to"), F.struct(*columns).alias("target"))
    is_revisit = F.coalesce(F.col("response.warc_type") == "revisit", F.lit(False))
    revisits = captures.filter(is_revisit).join(target, F.col("response.refers_to") == F.col("_to"), "left").drop("_to")
    return captures.filter(~is_revisit).withColumn("target", F.lit(None).cast(revisits.schema["target"].dataType)).unionByName(revisits)


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archives back and give each capture's full payload figures."""
    path = scratch_path(spark, "warc")
    write_warc(capture_records(plan_captures(table(spark, sf_dir, "pages"))), path)
    captures = assemble(read_warc(spark, path, with_payload=False)).select(
        "capture_id", "copies", metadata_field("page-id").cast("long").alias("page_id"),
        F.struct("response.warc_type", "response.refers_to", "response.payload_bytes", "response.payload_digest", "response.declared_digest").alias("response"),
    )
    captures = resolve_revisits(materialize(captures, "captures"), ["page_id", "response.payload_bytes", "response.payload_digest"])
    return captures.select(
        "page_id", F.coalesce("target.payload_bytes", "response.payload_bytes").alias("payload_bytes"),
        F.coalesce("target.payload_digest", "response.payload_digest").alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"), F.col("target.page_id").alias("refers_to"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )


OP1_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
             max(page_id) OVER (PARTITION BY html) AS owner FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN owner END AS refers_to, 1::INTEGER AS copy
FROM s
"""
