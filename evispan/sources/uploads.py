"""Uploaded files to chunks, profiles and rejects as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from evispan.constants import CHUNK_TOKENS, CSV_TYPE
from evispan.plugins import Factory
from evispan.session import fits, materialize
from evispan.sources.blocks import chunk_blocks, parse_files
from evispan.sources.files import admission_filter, csv_chunks, csv_records, file_name, file_type
from evispan.sources.store import collection_id, document_profile

# What a stream or batch of binary files gives.
FILES = "path string, modificationTime timestamp, length bigint, content binary"


@dataclass(frozen=True)
class Ingested:
    """``chunks`` as the store takes them, a summary row per collection, and ``id, status_code, detail`` per file not taken."""

    chunks: DataFrame
    profiles: DataFrame
    rejects: DataFrame


def ingest_uploads(uploads: DataFrame, parser: Factory, tokenizer: Factory | None = None, budget: int = CHUNK_TOKENS) -> Ingested:
    """Files ``(path, length, content)`` through admission, dispatch by suffix, decoding or parsing, chunking and profile.

    A collection is a file's bytes: files of equal bytes and type are one collection, named by the smallest path, and are
    rejected alike. A file is either in ``profiles`` or in ``rejects``; a CSV file's status comes from its decoding, a PDF file's from
    the parser plug-in. An empty table gives empty tables. Contents are read once to name the collections and once to parse.
    """
    accepted, refused = admission_filter(uploads.select("path", "length", "content"))
    kind = file_type(F.col("path")).alias("kind")
    named = accepted.select("path", "content", kind, collection_id(F.col("content")).alias("collection_id"))
    members = materialize(named.select("path", "kind", "collection_id"), "upload-members")
    firsts = members.groupBy("kind", "collection_id").agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = materialize(members.join(firsts, ["kind", "collection_id"]).where("path <> first").select("path"), "upload-repeats")
    files = named.join(F.broadcast(again) if fits(again) else again, "path", "left_anti")

    is_csv = F.col("kind") == CSV_TYPE
    # The collection goes through the decoder as the folder of the file's name.
    tables = files.where(is_csv).select(F.concat_ws("/", "collection_id", file_name(F.col("path"))).alias("path"), "content")
    owner = F.substring_index("path", "/", 1)
    rows, bad_rows = csv_chunks(csv_records(tables), owner, tokenizer)
    pages = files.where(~is_csv).select("collection_id", file_name(F.col("path")).alias("source"), "content")
    found, bad_pages = parse_files(pages, parser)
    chunks = materialize(rows.unionByName(chunk_blocks(found, budget, tokenizer)), "upload-chunks")

    bad = bad_rows.withColumn("id", F.substring_index("id", "/", 1)).withColumn("kind", F.lit(CSV_TYPE))
    bad = bad.unionByName(bad_pages.withColumn("kind", F.lit("pdf")))
    unusable = members.join(bad.withColumnRenamed("id", "collection_id"), ["kind", "collection_id"])
    rejects = refused.unionByName(unusable.select(F.col("path").alias("id"), "status_code", "detail"))
    return Ingested(chunks, document_profile(chunks, budget), rejects)
