"""A content-addressed WARC archive.

The archive is two tables.  ``payloads`` holds the bytes of each different
payload once, under its SHA-256, which is verified on reading.  ``records``
holds for each record the exact bytes of its header block and of the HTTP
header, and the payload's digest.  Joined they give the records as they were; a
revisit record keeps no payload of its own, but its digest leads to the bytes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads of at least so many bytes are kept once and revisited.
MIN_REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEADER = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def _payloads(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = F.coalesce(F.encode(F.col(html_col).cast("string"), "utf-8"), F.lit(b""))
    return pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages`` into ``path``.

    A null html is an empty payload and a null url an empty one.  Of records with
    equal payloads of ``MIN_REVISIT_BYTES`` or more that with the largest id is
    the response (null ids come last, and if there are only such, all are
    responses), the others revisit it; rows that repeat the largest id are
    responses too.  An empty table makes an empty archive.
    """
    spark = pages.sparkSession
    rows = _payloads(pages, id_col, url_col, html_col)
    told = rows.select("page_id", "url", F.length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256"))
    told.write.parquet(f"{path}/told")
    told = spark.read.schema(told.schema).parquet(f"{path}/told")

    firsts = told.groupBy("sha256").agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
    shared = firsts.where("copies > 1")
    rows = told.join(shared, "sha256", "left")
    is_revisit = (F.col("size") >= MIN_REVISIT_BYTES) & F.coalesce(F.col("page_id") < F.col("first"), F.col("page_id").isNull() & F.col("first").isNotNull())
    refers_to = F.when(is_revisit, F.col("first"))
    http = F.concat(F.lit(HTTP_HEADER), F.lit("Content-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    length = F.length(http) + F.when(refers_to.isNull(), F.col("size")).otherwise(0)
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("first")), F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(refers_to.isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", ""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit("\r\n"), F.when(refers_to.isNull(), "").otherwise(revisit),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), length, F.lit("\r\n\r\n"),
    )
    rows.select("page_id", F.encode(header, "utf-8").alias("header"), F.encode(http, "utf-8").alias("http"), "sha256").write.parquet(f"{path}/records")

    # The only time that payloads move: equal ones meet under their digest, after each task has dropped its own repeats.
    payloads = _payloads(pages, id_col, url_col, html_col).select(F.sha2("payload", 256).alias("sha256"), "payload")
    payloads.groupBy("sha256").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``page_id``, ``header``, ``http``, ``payload`` and ``verified`` of each record.

    ``payload`` is that of the record, or for a revisit that which it refers to;
    ``verified`` tells whether it still has the digest it is stored under.
    """
    records = spark.read.parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads")
    payloads = payloads.withColumn("verified", F.sha2("payload", 256) == F.col("sha256"))
    return records.join(payloads, "sha256", "left").select("page_id", "header", "http", "payload", F.coalesce("verified", F.lit(False)).alias("verified"))


def record_bytes(read: DataFrame) -> DataFrame:
    """``page_id`` and the exact bytes of each record as in a WARC file."""
    body = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return read.select("page_id", F.concat("header", "http", body, F.lit(b"\r\n\r\n")).alias("record"))


def _field(name: str):
    return F.regexp_extract(F.decode("header", "utf-8"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def _page_of(name: str):
    return F.nullif(F.regexp_extract(_field(name), "^<urn:page:(.*)>$", 1), F.lit(""))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """What the records read back say: sizes, digests, types and references.

    Size, digest and verification are taken from each stored payload's bytes
    where it is read; only these go to its records.  A record whose payload is
    missing or not verified has size and digest null.
    """
    records = spark.read.parquet(f"{path}/records")
    kind = records.schema["page_id"].dataType
    stored = spark.read.parquet(f"{path}/payloads").where(F.sha2("payload", 256) == F.col("sha256"))
    stored = stored.select("sha256", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    told = records.select(
        "sha256", _page_of("WARC-Record-ID").try_cast(kind).alias("page_id"), _field("WARC-Type").alias("record_type"), _page_of("WARC-Refers-To").try_cast(kind).alias("refers_to"),
    )
    return told.join(stored, "sha256", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def parse_warc(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in the bytes of an uncompressed WARC file."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        fields = dict(re.findall(r"([^:\r\n]+): ([^\r\n]*)\r\n", data[at:end].decode()))
        stop = end + int(fields["Content-Length"])
        out.append((fields, data[end:stop]))
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"a record does not end at byte {stop}")
        at = stop + 4
    return out
