"""Index tables on shared storage."""

from __future__ import annotations

import json
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evispan.constants import CHUNK_TOKENS, PDF_TYPE
from evispan.operators.lexical import (
    LexicalIndex,
    collection_stats,
    forward_table,
    in_order,
    partial_stats,
    posting_blocks,
    posting_bound,
    postings,
)
from evispan.operators.vector import embed
from evispan.plans.quick_answer import Corpus, Models
from evispan.schema import BLOCKS, CHUNKS, FORWARD, POSTINGS, VECTORS
from evispan.session import write_table

COMMITS = "ingest_id STRING, sequence BIGINT, as_of BIGINT, replaces ARRAY<STRING>"
STATS = "collection_id STRING, n_chunks BIGINT, total_dl BIGINT"
CHUNK_ORDER = ("collection_id", "chunk_id")


@dataclass(frozen=True)
class IndexStore:
    """Chunk, term, posting, block, statistics and vector tables below ``root``.

    Tables are partitioned by ingestion (``ingest_id``), not by collection: millions of one-file collections
    would mean millions of folders. Inside an ingestion rows are range-partitioned and sorted by
    (collection_id, chunk_id), so the scan of a few collections skips row groups by their statistics and a
    collection of any size is cut into many files. Writing the same ingestion again replaces it and
    touches nothing else. Of several ingestions of a collection the newest finished one is read.

    Every finished ingestion is one small file in ``commits``, named by its number in the order of commits. The file must
    not exist when it is made, so two writers never get one number, whatever their clocks say. A compaction also names the
    ingestions it replaces and the last commit it has read (``as_of``), and counts as that old: an upload that
    commits while a compaction runs stays newer than it.
    """

    spark: SparkSession
    root: str

    def _path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def _write(self, df: DataFrame, table: str, ingest_id: str) -> None:
        """``df`` is in the order of its table."""
        write_table(df, f"{self._path(table)}/ingest_id={ingest_id}", "overwrite")

    def _raw(self, table: str, ddl: str) -> DataFrame:
        return self.spark.read.schema(f"{ddl}, ingest_id STRING").parquet(self._path(table))

    def commits(self, as_of: int | None = None) -> DataFrame:
        """``ingest_id, sequence, as_of``: the newest commit of every ingestion that is not replaced, at the commit
        ``as_of`` or now."""
        if not self._exists("commits"):
            return self.spark.createDataFrame([], "ingest_id STRING, sequence BIGINT, as_of BIGINT")
        made = self.spark.read.schema(COMMITS).json(self._path("commits"))
        if as_of is not None:
            made = made.where(F.col("sequence") <= as_of)
        newest = made.groupBy("ingest_id").agg(F.max(F.struct("sequence", "as_of")).alias("newest")).select("ingest_id", "newest.*")
        replaced = made.select(F.explode("replaces").alias("ingest_id"), "as_of").groupBy("ingest_id").agg(F.max("as_of").alias("upto"))
        kept = newest.join(replaced, "ingest_id", "left").where("upto IS NULL OR sequence > upto")
        return kept.select("ingest_id", "sequence", "as_of")

    def current(self, as_of: int | None = None) -> DataFrame:
        """``collection_id, ingest_id``: of the finished ingestions that hold a collection the newest one. A file uploaded
        again lands on the same collection, and then counts once."""
        if not self._exists("commits"):
            return self.spark.createDataFrame([], "collection_id STRING, ingest_id STRING")
        held = self._raw("stats", "collection_id STRING").join(self.commits(as_of), "ingest_id")
        newest = F.max(F.struct("as_of", "sequence", "ingest_id")).alias("newest")
        return held.groupBy("collection_id").agg(newest).select("collection_id", "newest.ingest_id")

    def _exists(self, table: str) -> bool:
        try:
            self.spark.read.schema(COMMITS).json(self._path(table))
        except AnalysisException:
            return False
        return True

    def _read(self, table: str, ddl: str, as_of: int | None = None) -> DataFrame:
        if not self._exists("commits"):
            return self.spark.createDataFrame([], ddl)
        return self._raw(table, ddl).join(self.current(as_of), ["collection_id", "ingest_id"], "left_semi").drop("ingest_id")

    def add(self, chunks: DataFrame, ingest_id: str, models: Models = Models(), with_vectors: bool = True) -> None:
        """Write one ingestion: chunks first, then what is derived from the written chunks, then the mark that makes
        it visible, so readers never see half of it. Chunks whose embedding failed keep the status of the failure in
        the vector table. Texts are put in order before they are analysed and embedded: ranges are found by running what they
        deal out a second time."""
        self._write(in_order(chunks, *CHUNK_ORDER), "chunks", ingest_id)
        written = self._raw("chunks", CHUNKS).where(F.col("ingest_id") == ingest_id).select("collection_id", "chunk_id", "text")
        self._write(forward_table(in_order(written, *CHUNK_ORDER), models.stopwords, models.exact, dealt=True), "forward", ingest_id)
        self._derive(ingest_id)
        if with_vectors:
            self._write(embed(in_order(written, *CHUNK_ORDER), factory=models.embed, dealt=True), "vectors", ingest_id)
        self._commit(ingest_id)

    def _derive(self, ingest_id: str) -> None:
        """Tables that follow from the written forward rows of an ingestion."""
        forward = self._raw("forward", FORWARD).where(F.col("ingest_id") == ingest_id).drop("ingest_id")
        self._write(in_order(partial_stats(forward), "collection_id"), "stats", ingest_id)
        rows = posting_bound(self._raw("stats", STATS).where(F.col("ingest_id") == ingest_id))
        self._write(in_order(postings(forward), "collection_id", "term", "chunk_id", rows=rows), "postings", ingest_id)
        stored = self._raw("postings", POSTINGS).where(F.col("ingest_id") == ingest_id)
        self._write(posting_blocks(stored, rows), "blocks", ingest_id)

    def _files(self, table: str):
        """Hadoop file system and path of a table."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def last_commit(self) -> int:
        files, path = self._files("commits")
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json")), default=0)

    def _commit(self, ingest_id: str, as_of: int | None = None, replaces: list[str] | None = None) -> None:
        """Make an ingestion visible under the next free number; another writer's commit in between moves it on."""
        files, folder = self._files("commits")
        while True:
            number = self.last_commit() + 1
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}.json")
            row = {"ingest_id": ingest_id, "sequence": number, "as_of": number if as_of is None else as_of, "replaces": replaces or []}
            try:
                out = files.create(path, False)
            except Py4JJavaError:
                if files.exists(path):
                    continue
                raise
            out.write(bytearray(json.dumps(row).encode()))
            out.close()
            return

    def compact(self, ingest_id: str, with_vectors: bool = True) -> None:
        """Write what is current at the last commit as one new ingestion that replaces those it was read from. An upload
        that commits meanwhile is not in it and stays visible. A name that is in use gets the commit's number."""
        as_of = self.last_commit()
        replaces = [row.ingest_id for row in self.commits(as_of).select("ingest_id").collect()]  # one name per ingestion
        if ingest_id in replaces:
            ingest_id = f"{ingest_id}.{as_of}"
        tables = [("chunks", CHUNKS), ("forward", FORWARD)] + ([("vectors", VECTORS)] if with_vectors else [])
        for table, ddl in tables:
            self._write(in_order(self._read(table, ddl, as_of), *CHUNK_ORDER), table, ingest_id)
        self._derive(ingest_id)
        self._commit(ingest_id, as_of, replaces)

    def vacuum(self) -> list[str]:
        """Delete the tables of replaced ingestions; their names. Readers that began before a compaction need them."""
        if not self._exists("commits"):
            return []
        made = self.spark.read.schema(COMMITS).json(self._path("commits"))
        gone = made.join(self.commits(), "ingest_id", "left_anti").select("ingest_id").distinct()
        names = sorted(row.ingest_id for row in gone.collect())
        for table in ("chunks", "forward", "stats", "postings", "blocks", "vectors"):
            files, folder = self._files(table)
            for name in names:
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"ingest_id={name}"), True)
        return names

    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNKS)

    def stats(self) -> DataFrame:
        return self._read("stats", STATS)

    def collections(self) -> DataFrame:
        return self.current().select("collection_id")

    def corpus(self, with_vectors: bool = True) -> Corpus:
        forward = self._read("forward", FORWARD)
        vectors = self._read("vectors", VECTORS) if with_vectors else None
        stats = collection_stats(self.stats())
        index = LexicalIndex(forward, stats, self._read("postings", POSTINGS), self._read("blocks", BLOCKS))
        return Corpus(self.chunks(), index, vectors)


def collection_id(content: Column) -> Column:
    """Id of an uploaded file: a digest of its bytes, so that a repeated upload lands on the same collection."""
    return F.sha2(content, 256)


def document_profile(chunks: DataFrame, max_tokens: int = CHUNK_TOKENS, page_counts: DataFrame | None = None) -> DataFrame:
    """One summary row per collection. Means are rounded half to even. ``page_counts (collection_id, page_count)`` tells
    the pages of each document; without it the last page with a chunk stands for them."""
    pages = F.max(F.array_max("pages"))
    if page_counts is not None:
        chunks = chunks.join(page_counts.select("collection_id", "page_count"), "collection_id", "left")
        pages = F.coalesce(F.max("page_count").cast("int"), pages)
    return chunks.groupBy("collection_id", "source", "file_type", "chunking").agg(
        F.when(F.first("file_type") == PDF_TYPE, pages).alias("pages"),
        F.when(F.first("file_type") != PDF_TYPE, F.count(F.lit(1))).cast("int").alias("rows"),
        F.count(F.lit(1)).alias("chunks"),
        F.lit(max_tokens).alias("max_tokens_per_chunk"),
        F.min("n_tokens").alias("minimum_chunk_tokens"),
        F.bround(F.avg("n_tokens")).cast("bigint").alias("average_chunk_tokens"),
        F.max("n_tokens").alias("maximum_chunk_tokens"),
        F.bround(F.avg(F.length("text"))).cast("bigint").alias("average_chunk_characters"),
    )
