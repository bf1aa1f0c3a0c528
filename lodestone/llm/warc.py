"""A content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256 digest; record headers are stored apart, byte for byte. Joining
them gives the original records: `headers CRLF CRLF block CRLF CRLF`. A revisit record has no block; its payload is
the one of the response that it names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import shared_path, small

#: Shorter payloads are stored in a response each: a revisit's headers would be no shorter.
LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES, date: str = DATE) -> DataFrame:
    """page_id, record_type, refers_to, payload, payload_digest, payload_bytes, header, alone: a WARC record for each row of pages."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    firsts = base.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    # digests of copied payloads only: unless these are very many, no payload is shuffled here. Empty partitions leave
    # no file, as they would in a checkpoint
    saved = shared_path(pages.sparkSession, "warc-firsts")
    firsts.write.parquet(saved)
    firsts = pages.sparkSession.read.parquet(saved)
    base = base.join(small(firsts, firsts.count(), 120), "payload_digest", "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    base = base.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first")))
    uri = lambda c: F.format_string("<urn:lodestone:page:%s>", F.coalesce(c.cast("string"), F.lit("")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", uri(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        # a line break in a url can't stand in a header
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", uri(F.col("first"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    )
    alone = F.col("copies").isNull() & (F.col("payload_bytes") >= least_bytes)
    return base.select("page_id", "record_type", "refers_to", "payload", "payload_digest", "payload_bytes", F.encode(header, "UTF-8").alias("header"), alone.alias("alone"))


def write_archive(rows: DataFrame, path: str) -> None:
    """Writes `headers` (page_id, header, digest of the block or null) and `payloads` (digest, bytes once, their
    number, whether they are alone) under path."""
    block = F.when(F.col("record_type") == "response", F.col("payload_digest"))
    rows.select("page_id", "header", block.alias("digest")).write.parquet(f"{path}/headers")
    response = rows.where("record_type = 'response'").select(F.col("payload_digest").alias("digest"), "payload", "payload_bytes", "alone")
    # a payload without copies goes straight into the store; the rest are grouped with their bytes, partly beforehand
    alone, rest = response.where("alone"), response.where("not alone").distinct()
    alone.unionByName(rest).write.parquet(f"{path}/payloads")


def _verify(batches):
    """Fails on a payload that doesn't have the digest it is stored under."""
    for batch in batches:
        for digest, payload in zip(batch.column("digest"), batch.column("payload"), strict=True):
            if hashlib.sha256(payload.as_buffer()).hexdigest() != digest.as_py():
                raise ValueError(f"damaged payload {digest.as_py()}")
        yield batch


def _record(payload: Column) -> Column:
    return F.concat("header", F.unhex(F.lit("0D0A")), payload, F.unhex(F.lit("0D0A0D0A"))).alias("record")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record of the responses: headers with the blocks that they name."""
    headers = spark.read.parquet(f"{path}/headers").where("digest is not null")
    payloads = spark.read.parquet(f"{path}/payloads").select("digest", "payload").mapInArrow(_verify, "digest string, payload binary")
    return headers.join(payloads, "digest", "left").select("page_id", _record(F.coalesce("payload", F.unhex(F.lit("")))))


def read_revisits(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record of the revisits. They have no block, so nothing is joined."""
    return spark.read.parquet(f"{path}/headers").where("digest is null").select("page_id", _record(F.unhex(F.lit(""))))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record: the original records, as bytes."""
    return read_responses(spark, path).unionByName(read_revisits(spark, path))


_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*(.*)")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-cased name, and the block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {m[1].decode().lower(): m[2].decode() for x in lines if (m := _FIELD.fullmatch(x))}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the block doesn't have its length")
    return fields, rest[:n]


def _page(uri: str | None) -> int | None:
    number = (uri or "").rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def _parsed(batches):
    for batch in batches:
        out = []
        for r in batch.column("record"):
            f, block = parse(r.as_py())
            digest = f["warc-payload-digest"].removeprefix("sha256:")
            revisit = f["warc-type"] == "revisit"
            if not revisit and hashlib.sha256(block).hexdigest() != digest:
                raise ValueError("the block doesn't have its digest")
            out.append((_page(f["warc-record-id"]), f["warc-target-uri"], None if revisit else len(block), digest, f["warc-type"], _page(f.get("warc-refers-to"))))
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        yield pa.record_batch({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), cols, strict=True)})


def parse_records(rows: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes (null for revisits), payload_digest, record_type, refers_to of records."""
    return rows.select("record").mapInArrow(_parsed, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export_files(rows: DataFrame, path: str) -> None:
    """The records as WARC bytes, in a column of Parquet parts; joined in any order they are a WARC file."""
    rows.select("record").write.parquet(path)


def archive_roundtrip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, read back from an archive of all pages.

    pages: page_id integer, url and html strings; html null is an empty payload, url null an empty url. Of records
    with equal payloads of LEAST_BYTES or more the smallest page_id is a response, others revisit it. Rows that
    repeat both that page_id and payload are responses each. Rows without page_id revisit the response, if any row of
    their payload has a page_id, else they are responses. Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archive(records(pages), path)
    responses, revisits = parse_records(read_responses(spark, path)), parse_records(read_revisits(spark, path)).drop("payload_bytes")
    # a revisit's payload is as long as that of the response it names; the store holds each digest once, and only the
    # narrow columns of copied ones are read here
    sizes = spark.read.parquet(f"{path}/payloads").where("not alone").select(F.col("digest").alias("payload_digest"), "payload_bytes")
    revisits = revisits.join(small(sizes, sizes.count(), 120), "payload_digest", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
    return responses.select(revisits.columns).unionByName(revisits)
