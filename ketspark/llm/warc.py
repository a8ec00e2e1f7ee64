"""WARC archives with revisit records for equal payloads.

Headers are shuffled by payload digest, payloads are not: of the records with one digest the
smallest id is kept as response, the others become revisits that refer to it. Archives are plain
WARC/1.1 files of bounded size with fresh headers, written and read by Spark, so that any store it
reaches will do. Reading follows Content-Length and joins revisits to their responses again.

Nulls: a null payload is empty, a null URI is left out; records with a null id are responses.
Records with equal id and payload (ties, repeated rows) are responses both. An empty table makes an archive without
records. Very long payloads are one record each, in files of their own. Other columns of ``records`` aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ketspark.llm.common import join_spread, new_path, stored

CRLF = "\r\n"
#: repeated digests that may be broadcast; more are joined by shuffle
BROADCAST_DIGESTS = 100_000
#: bytes of the records of the first class of size
SMALL_RECORD = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(records: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``records`` (id, uri, payload) with payload_bytes, payload_digest and refers_to (null: response)."""
    own = records.select("id", "uri", F.coalesce("payload", F.lit("")).alias("payload"))
    own = own.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    headers = own.where((F.col("payload_bytes") >= min_bytes) & F.col("id").isNotNull())
    first = headers.groupBy(F.col("payload_digest").alias("key")).agg(F.min("id").alias("value"), F.count("*").alias("rows")).where("rows > 1")
    key = F.when((F.col("payload_bytes") >= min_bytes) & F.col("id").isNotNull(), F.col("payload_digest"))
    if first.count() <= BROADCAST_DIGESTS:  # payloads stay where they are
        found = own.withColumn("__key", key).join(F.broadcast(first.withColumnRenamed("key", "__key").drop("rows")), "__key", "left").drop("__key")
    else:
        found = join_spread(own, key, first, records.count(), F.xxhash64("id", "uri"))
    return found.withColumn("refers_to", F.when(F.col("value") != F.col("id"), F.col("value"))).drop("value")


def record_text() -> Column:
    """One record, without the two line ends that close it."""
    name = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    uri = F.regexp_replace("uri", r"[\x00-\x20\x7F]", "")  # a header is one line
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name("id")),
        line("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.when(F.col("uri").isNotNull(), line("WARC-Target-URI", uri)).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name("refers_to")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def write_archives(records: DataFrame, path: str, min_bytes: int = 100, file_mb: int = 16) -> None:
    """Deduplicated archives of about ``file_mb`` each. Records are written by classes of size, each at most twice as long as
    the one before (nearly always there is one class), so that no file outgrows the 1 GB that readers take at once,
    however uneven the records are; a record of over 1 GB would be a file of its own."""
    size = F.coalesce(F.octet_length("payload"), F.lit(0)) + 1000
    of_class = F.greatest(F.lit(0), F.ceil(F.log2(size / SMALL_RECORD))).cast("int")
    classes = records.groupBy(of_class.alias("c")).agg(F.avg(size)).collect()  # at most 32 rows
    lines = with_revisits(records, min_bytes).select(of_class.alias("c"), record_text().alias("value"))
    for c, mean in sorted(map(tuple, classes)) or [(0, 1.0)]:
        most = max(1, min(int((file_mb << 20) / mean), (1 << 30) // (SMALL_RECORD << c)))
        lines.where(F.col("c") == c).select("value").write.mode("append").option("lineSep", 2 * CRLF).option("maxRecordsPerFile", most).text(path)


def parse(data: bytes) -> Iterator[tuple]:
    """(id, uri, type, refers_to id, digest in the header, payload or None) of each record."""
    at = 0
    name = lambda v: None if v is None or v == b"<urn:record:none>" else int(v[len("<urn:record:") : -1])
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].split(b"\r\n")
        if not first.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
        block = data[end + 4 : end + 4 + int(head[b"content-length"])]
        at = end + 4 + len(block) + 4
        if data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError(f"a WARC record does not end at byte {at}")
        kind = head[b"warc-type"].decode()
        payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
        digest = head[b"warc-payload-digest"].partition(b":")[2].decode()
        yield name(head[b"warc-record-id"]), head.get(b"warc-target-uri", b"").decode() or None, kind, name(head.get(b"warc-refers-to")), digest, payload


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(id, uri, record_type, refers_to, payload_digest, payload_bytes, payload); revisits have a null
    payload and the length of the response they refer to. A payload that differs from its digest is an error."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "uri", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for id_, uri, kind, refers_to, digest, payload in parse(data.as_py()):
                    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of record {id_} differs from its digest")
                    rows.append((id_, uri, kind, refers_to, digest, None if payload is None else len(payload), payload if payloads else None))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(records, "id long, uri string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """Records of ``read_archives``; a revisit gets payload_bytes from the response with its digest."""
    wanted = records.where("record_type = 'revisit'").groupBy(F.col("payload_digest").alias("key")).agg(F.count("*").alias("rows"))
    given = records.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("__digest")).agg(F.max("payload_bytes").alias("value"))
    right = wanted.join(given, F.col("key") == F.col("__digest")).select("key", "value", "rows")
    key = F.when(F.col("record_type") == "revisit", F.col("payload_digest"))
    return join_spread(records, key, right, records.count(), F.xxhash64("id", "uri")).withColumn("payload_bytes", F.coalesce("payload_bytes", "value")).drop("value")


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.col("html").alias("payload"))
    write_archives(pages, path)
    records = stored(read_archives(spark, path, payloads=False).drop("payload"), "records")
    return resolved(records).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""
