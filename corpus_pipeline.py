"""Training-data pipeline over ``documents``: quality, boilerplate lines, near-duplicates, contamination, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read again as the next one's
``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evispan.llm import quality
from evispan.llm.common import table
from evispan.llm.decontaminate import contamination, decontaminate
from evispan.llm.line_dedup import line_dedup
from evispan.llm.linear import training_rows
from evispan.llm.minhash import near_duplicates
from evispan.llm.packing import pack
from evispan.llm.queries import tokenizer_path
from evispan.session import materialize_plain as materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ACCEPT = 0.3
# Share of a source's distinct texts over which a line is boilerplate; the README has the counts behind it.
LINE_RATIO = 0.02
# Units a packing task remembers: fewer than on its own, as workers have served four stages before.
PACK_UNITS = 200_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from all labelled rows of the stage's input."""
    weights = quality.train(training_rows(docs, table(spark, sf_dir, "labels"), "quality", F.lit(True)))
    return quality.quality_scores(docs.select(*COLUMNS), weights, name="_quality").where(F.col("_quality") >= ACCEPT).drop("_quality")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source. Copies count as one page: they are still there, and the
    next stage must find the text of the one it keeps."""
    cleaned = line_dedup(docs.select(*COLUMNS), F.col("source"), ratio=LINE_RATIO, dropped="_dropped", copies_once=True)
    changed = F.when(F.col("_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", changed).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, and of wholly repeated rows one. Rows
    that share an id share its fate; rows without id stay."""
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").limit(1).count():
        docs = docs.dropDuplicates()
    gone = materialize(near_duplicates(docs, size=5).where("NOT kept").select("doc_id").distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows don't contaminate."""
    found = contamination(decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")))
    return found.where("NOT contaminated").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids."""
    return pack(docs, tokenizer_path(), cache_units=PACK_UNITS)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# Neither the classifier nor the tokenizer can be written in SQL; tests compare the rows of run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
