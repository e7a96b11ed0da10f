"""Content-addressed WARC archive.

``write_archive`` stores each distinct payload once under its SHA-256 and keeps
every record's exact header block in a second table; ``read_archive`` joins them
back into the original records and checks length, SHA-1 and SHA-256 of what it
read against the headers, failing loudly on a mismatch. ``export_warc`` writes the
reconstructed records as plain WARC files, which ``read_warc`` reads.

Payloads whose digest occurs once are written where they are scanned; only those
that repeat are shuffled, after map-side removal of all but the first record.

Defined results: a null payload is empty; of records with equal payloads of at
least ``min_revisit`` bytes the smallest id is the response (a null id only when no
other has that payload; of rows repeating the smallest id exactly one) and the
others revisit it; null URLs are written as empty, line ends in URLs as blanks; ids of any text are
percent-encoded in record names; other columns are not read.
"""

from __future__ import annotations

import gzip
import io
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import shared_dir, small, stage

CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(col):
    """SHA-1 of a binary column in upper-case base32: each 5 hex digits are 4 base-32 digits."""
    digits = F.sha1(col)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(record_id: str, row: str):
    named = F.coalesce(F.concat(F.lit("id:"), F.url_encode(F.col(record_id).cast("string"))), F.lit("none:"))
    return F.concat(F.lit("<urn:x-record:"), named, F.lit(":"), F.col(row).cast("string"), F.lit(">"))


def _header(date: str):
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF)
    )
    block = F.octet_length(http) + F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"),
        F.lit(f"{CRLF}WARC-Record-ID: "), _urn("record_id", "row_no"),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " "),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), _urn("first_id", "first_row"))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), block.cast("string"), F.lit(CRLF + CRLF), http,
    )


def write_archive(
    records: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0, date: str = DATE
) -> None:
    """Write ``path``/payloads (digest, payload) and ``path``/headers (record_id, row_no, digest, header)."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = stage(
        records.select(
            F.col(id_col).alias("record_id"), F.col(url_col).alias("url"), F.monotonically_increasing_id().alias("row_no"), payload.alias("p")
        ).select("record_id", "url", "row_no", F.unhex(F.sha2("p", 256)).alias("digest"), base32_sha1("p").alias("sha1"), F.octet_length("p").cast("long").alias("payload_bytes")),
        "records",
    )
    place = F.struct(F.isnull("record_id").alias("no_id"), "record_id", "row_no")
    firsts = rows.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    repeated = stage(firsts.where("n > 1").select("digest", F.col("first.record_id").alias("first_id"), F.col("first.row_no").alias("first_row")), "repeated")
    typed = rows.join(small(repeated), "digest", "left")
    is_first = F.isnull("first_row") | (F.col("first_row") == F.col("row_no")) | (F.col("payload_bytes") < min_revisit)
    typed = typed.withColumn("record_type", F.when(is_first, "response").otherwise("revisit"))
    typed.select("record_id", "row_no", "digest", _header(date).alias("header")).write.parquet(f"{path}/headers", compression="zstd")

    bodies = records.select(F.col(id_col).alias("record_id"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    bodies = bodies.join(small(repeated), "digest", "left")
    once = bodies.where("first_row is null").select("digest", "payload")
    again = bodies.where("first_row is not null and record_id <=> first_id").select("digest", "payload").dropDuplicates(["digest"])
    once.unionByName(again).write.parquet(f"{path}/payloads", compression="zstd")


def _field(name: str):
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The original records: record_id, row_no, record_type, url, refers_to (id), header, payload, payload_bytes, payload_digest."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    joined = headers.join(payloads, "digest", "left").select(
        "record_id", "row_no", "digest", "header", "payload",
        _field("WARC-Type").alias("record_type"), _field("WARC-Target-URI").alias("url"), _field("WARC-Payload-Digest").alias("stated"),
        F.regexp_extract("header", r"\r\nWARC-Refers-To: <urn:x-record:id:([^:]*):", 1).alias("refers"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
    )
    sound = (F.concat(F.lit("sha1:"), F.col("payload_digest")) == F.col("stated")) & (F.unhex(F.sha2("payload", 256)) == F.col("digest"))
    kind = joined.schema["record_id"].dataType
    return joined.select(
        "record_id", "row_no", "url", "header", "payload", "payload_digest", "payload_bytes",
        F.when(F.coalesce(sound, F.lit(False)), F.col("record_type")).otherwise(F.raise_error(F.lit("payload does not match its digest"))).alias("record_type"),
        F.when(F.contains("header", F.lit("\r\nWARC-Refers-To: <urn:x-record:id:")), F.url_decode("refers").cast(kind)).alias("refers_to"),
    )


def export_warc(spark: SparkSession, archive: str, path: str, compression: str = "gzip") -> None:
    """Write the archive as WARC files: each record is its header block, its payload unless a revisit, and two line ends."""
    body = F.when(F.col("record_type") == "response", F.col("payload").cast("string")).otherwise("")
    read_archive(spark, archive).select(F.concat("header", body).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def _records(batches):
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
            raw = io.BytesIO(data.as_py())
            stream = gzip.open(raw) if path.endswith(".gz") else raw
            while True:
                lines = []
                while (line := stream.readline()) not in (b"", b"\r\n"):
                    lines.append(line)
                if not lines:
                    break
                header = b"".join(lines) + b"\r\n"
                size = int(next(x for x in lines if x.lower().startswith(b"content-length:")).split(b":")[1])
                block = stream.read(size)
                if len(block) < size or stream.read(4) != b"\r\n\r\n":
                    raise ValueError(f"record cut short in {path}")
                yield pa.RecordBatch.from_arrays([pa.array([header.decode("utf-8", "replace")]), pa.array([block], pa.binary())], ["header", "block"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of plain or gzipped WARC files: header (with its empty line), block. A file is one row of one task, so files should be of the usual size of about a gigabyte at most."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_records, "header string, block binary")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/archive-{uuid.uuid4().hex}"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages),
h AS (SELECT page_id, first_id, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       translate(array_to_string([upper(to_base(('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT, 32, 4)) FOR i IN range(8)], ''),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM h
"""
