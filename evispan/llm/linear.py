"""Shared by the linear text classifiers: bounded training samples and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evispan.llm.common import only
from evispan.session import materialize_plain as materialize

# Labelled rows a classifier is fitted on at most (those whose id hashes lowest); all when there are fewer.
SAMPLE_ROWS = 20_000


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_ROWS
) -> DataFrame:
    """``id, text, label`` of at most ``most`` labelled rows for which ``learn`` (a condition on the id) holds.

    The choice is by a hash of the id, so it is the same for every layout. Only ids go through the sort for the bound. Rows
    with null id or null label are not used; an id with several labels gives a row for each.
    """
    marks = (
        only(labels, id_col, label)
        .toDF("id", "label")
        .where(F.col("label").isNotNull())
        .where(F.col("id").isNotNull())
        .withColumnRenamed("id", id_col)
        .where(learn)
        .withColumnRenamed(id_col, "id")
    )
    # Ids without a document don't count towards the bound.
    there = marks.join(only(docs, id_col).toDF("id"), "id", "left_semi").distinct()
    chosen = there.orderBy(F.xxhash64("id"), "id", "label").limit(most)
    chosen = materialize(chosen, "labelled")
    texts = only(docs, id_col, text_col).toDF("id", "text")
    found = texts.join(F.broadcast(chosen), "id")  # at most ``most`` ids and labels
    return found.select("id", "text", F.col("label").cast("int").alias("label"))
