"""Rows of any table as located chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evispan.constants import CSV_CHUNKING, CSV_TYPE, ROW_LABEL
from evispan.functions.text import strip, token_count
from evispan.schema import CHUNK_COLUMNS
from evispan.session import materialize


def ordinals(df: DataFrame, group: str, key: str, name: str, start: int = 1) -> DataFrame:
    """Number the rows of each ``group`` by ``key``.

    Rows are range-partitioned by (group, key), numbered inside each part, and shifted by the counts of the
    parts before; a group of any size is therefore numbered by many tasks. The parts are written once, so
    both passes see the same ones.
    """
    placed = materialize(
        df.repartitionByRange(group, key).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy(group, "_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(group, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    )
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(key))
    return (
        placed.withColumn("_inside", inside)
        .join(shifts, [group, "_part"])
        .withColumn(name, (F.col("_shift") + F.col("_inside") + F.lit(start - 1)).cast("bigint"))
        .drop("_part", "_inside", "_shift")
    )


def row_text(columns: list[str], number: Column) -> Column:
    """``Linha n`` and one ``column: value`` line per column."""
    lines = [
        F.concat(F.lit(f"{name}: "), strip(F.coalesce(F.col(name).cast("string"), F.lit("")))) for name in columns
    ]
    return F.concat(F.lit(ROW_LABEL), number.cast("string"), F.lit("\n"), F.concat_ws("\n", *lines))


def row_chunks(df: DataFrame, collection: str, key: str, columns: list[str], source: Column) -> DataFrame:
    """One chunk per row, numbered from 2 inside its collection as if under a header line."""
    numbered = ordinals(df, collection, key, "row_no", start=2)
    return numbered.select(
        F.col(collection).cast("string").alias("collection_id"),
        F.col("row_no").cast("bigint").alias("chunk_id"),
        row_text(columns, F.col("row_no")).alias("text"),
        source.alias("source"),
        F.lit(CSV_TYPE).alias("file_type"),
        F.lit(CSV_CHUNKING).alias("chunking"),
        F.lit(None).cast("int").alias("page"),
        F.lit(None).cast("array<int>").alias("pages"),
        F.col("row_no").alias("row_start"),
        F.col("row_no").alias("row_end"),
    ).withColumn("n_tokens", token_count(F.col("text"))).select(*CHUNK_COLUMNS)
