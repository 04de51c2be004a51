"""Content-addressed WARC archive.

Payload bytes are kept once per key in one table, the exact header block of every record in another; joining the
two gives the records back. The key is SHA-256. SHA-1, which the format states, is a field of the header only:
files that share one are public and occur in crawls.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evispan.llm.common import only
from evispan.session import materialize_plain as materialize, new_path

# RFC 4648 base32 digits beside those of base 32 numbers, and the profile of a revisit record.
BASE32, NUMBER32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def strong_key(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: eight groups of 20 bits, four digits each."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), NUMBER32, BASE32)


@dataclass
class Archive:
    """Folders of the two tables: ``records`` (page_id, key, header) and ``payloads`` (key, payload)."""

    records: str
    payloads: str


def header_block(page: Column, url: Column, kind: Column, digest: Column, refers_to: Column, length: Column, date: str) -> Column:
    """Exact bytes before a record's payload: named fields, each ended by CRLF, then an empty line."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record_id = lambda of: F.concat(F.lit("<urn:page:"), of.cast("string"), F.lit(">"))
    revisit = kind == "revisit"
    lines = [
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", kind),
        field("WARC-Record-ID", record_id(F.coalesce(page.cast("string"), F.lit("none")))),
        field("WARC-Date", F.lit(date)),
        # A line break inside a url would end the field.
        F.when(url.isNotNull(), field("WARC-Target-URI", F.regexp_replace(url, "[\r\n]", " "))).otherwise(""),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, field("WARC-Profile", F.lit(REVISIT_PROFILE))).otherwise(""),
        F.when(revisit, field("WARC-Refers-To", record_id(refers_to))).otherwise(""),
        field("Content-Length", F.when(revisit, F.lit("0")).otherwise(length.cast("string"))),
        F.lit("\r\n"),
    ]
    return F.concat(*lines).cast("binary")


def write_archive(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str | None = None
) -> Archive:
    """Write one record per row of ``pages``, dated ``date`` (UTC, as 2026-01-31T23:59:59Z; the time of writing if None).

    Payload: the column in UTF-8, null as empty. Of records with equal payloads of at least ``least`` bytes the one
    with the largest id is the response and the others revisit it; smaller ones are all responses. Rows that repeat
    the largest id with the same payload are responses alike (the payload is still stored once). A row without id is never
    the response while the group has an id; a group without any id has only responses. A null url leaves its field out.
    Different payloads with one SHA-1 are stored apart, as their SHA-256 differ.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    spark = pages.sparkSession
    rows = only(pages, id_col, url_col, payload_col).toDF("page_id", "url", "body")
    rows = rows.withColumn("body", F.coalesce(F.col("body").cast("binary"), F.lit("").cast("binary")))
    facts = rows.select("page_id", "url", base32_sha1(F.col("body")).alias("digest"), F.octet_length("body").cast("long").alias("length"), strong_key(F.col("body")).alias("key"))
    facts = materialize(facts, "warc-facts")
    groups = facts.groupBy("key").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    # Payloads that occur once are their own keepers, so only repeated ones need the join, and few rows travel.
    shared = materialize(groups.where("n > 1").select("key", "keeper"), "warc-shared")
    joined = facts.join(shared, "key", "left")
    revisit = (F.col("length") >= least) & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    archive = Archive(new_path(spark, "warc-records"), new_path(spark, "warc-payloads"))
    joined.select(
        "page_id",
        "key",
        header_block(F.col("page_id"), F.col("url"), kind, F.col("digest"), F.col("keeper"), F.col("length"), date).alias("header"),
    ).write.parquet(archive.records)
    stored = rows.withColumn("key", strong_key(F.col("body"))).join(shared.withColumn("several", F.lit(True)), "key", "left")
    alone = stored.where("several IS NULL").select("key", "body")
    chosen = stored.where("several AND page_id <=> keeper").select("key", "body").dropDuplicates(["key"])
    alone.union(chosen).withColumnRenamed("body", "payload").write.parquet(archive.payloads)
    return archive


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """Records as written: ``page_id, header, payload`` and the fields ``record_type, refers_to, stated_digest,
    stated_length`` parsed from the header block. The payload of a revisit is that of the record it refers to. A stored
    payload whose bytes don't have its key stops the read."""
    payloads = spark.read.parquet(archive.payloads)
    payloads = payloads.withColumn(
        "payload",
        F.when(strong_key(F.col("payload")) == F.col("key"), F.col("payload")).otherwise(
            F.raise_error(F.concat(F.lit("damaged payload "), F.hex("key"))).cast("binary")
        ),
    )
    text = F.decode("header", "UTF-8")
    field = lambda name, value=r"([^\r\n]*)": F.regexp_extract(text, f"\r\n{name}: {value}\r\n", 1)
    refers = field("WARC-Refers-To", "<urn:page:([^>]*)>")
    return (
        spark.read.parquet(archive.records)
        .join(payloads, "key")
        .select(
            "page_id",
            "header",
            "payload",
            field("WARC-Type").alias("record_type"),
            F.when(refers != "", refers).alias("refers_to"),
            field("WARC-Payload-Digest", "sha1:([A-Z2-7]*)").alias("stated_digest"),
            field("Content-Length", "([0-9]+)").cast("long").alias("stated_length"),
        )
    )


def record_bytes(records: DataFrame) -> Column:
    """A record of the archive file format: header block, payload unless it is a revisit, two line ends."""
    empty = F.lit("").cast("binary")
    body = F.when(records["record_type"] == "revisit", empty).otherwise(records["payload"])
    return F.concat(records["header"], body, F.lit("\r\n\r\n").cast("binary"))
