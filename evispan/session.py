"""Session helpers: shared work folder, written intermediates, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 200_000
# Of a relation in the driver's memory, which holds its collected rows and its blocks as well while it is made.
BROADCAST_BYTES = 16_000_000
PRUNE_VALUES = 1_000
# Rows that a task sorts or groups, where their number is known beforehand.
TASK_ROWS = 2_000_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evispan-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def no_shuffle_kept(spark: SparkSession) -> Iterator[None]:
    """What a query shuffles inside is removed when it ends. Else it stays on the executors' disks until the driver happens to collect its
    garbage, and the shuffles of a plan's steps add up."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``df`` as a table that is kept small, and nothing beside it."""
    with no_shuffle_kept(df.sparkSession):
        df.write.mode(mode).option("compression", "zstd").parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: computed once, lineage cut,
    and nothing is lost with an executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_plain(df: DataFrame, name: str) -> DataFrame:
    """The same with Spark's own settings, as the training-data operators were measured with."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows over the cores when the input has fewer files than cores; a no-op on large inputs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df._jdf.inputFiles())  # counted in the JVM: a large input has too many names to fetch
    return df.repartition(cores, *keys) if 0 < files < cores else df


def relation_bytes(df: DataFrame) -> Column:
    """About what a row takes in a broadcast relation: itself, its keys (all columns at most) and their place in the map."""
    long = [name for name, kind in df.dtypes if kind in ("string", "binary") or "<" in kind]
    values = [F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(0)) for name in long]
    return sum(values, F.lit(8 + 8 * len(df.columns))).cast("bigint") * 2 + 64


def fits(df: DataFrame, max_rows: int | None = None) -> bool:
    """True when ``df`` is small enough to broadcast: at most ``BROADCAST_ROWS`` rows that take ``BROADCAST_BYTES`` at most, since rows alone
    don't tell how long their ids and terms are. A caller that knows its rows gives ``max_rows`` instead. Reads no more than needed to tell."""
    if max_rows is not None:
        return df.limit(max_rows + 1).count() <= max_rows
    sizes = df.select(relation_bytes(df).alias("size")).limit(BROADCAST_ROWS + 1)
    rows, size = sizes.agg(F.count(F.lit(1)), F.sum("size")).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def prune(df: DataFrame, keys: DataFrame, column: str, limit: int = PRUNE_VALUES) -> DataFrame:
    """``df`` cut to the values of ``column`` that occur in ``keys``, as a literal filter that reaches the
    scan, where files and row groups are skipped by it. With more than ``limit`` values ``df`` is returned as
    it is; the join that follows does the filtering."""
    values = [row[0] for row in keys.select(column).distinct().limit(limit + 1).collect()]
    return df.where(F.col(column).isin(values)) if len(values) <= limit else df


def parts_of(spark: SparkSession, rows: int) -> tuple[int, ...]:
    """First argument of ``repartition`` and ``repartitionByRange`` for ``rows`` rows: so many partitions that a task's share stays
    the same however many they are. None for few rows, whose partitions Spark may merge; it would also merge many rows that
    compress well."""
    parts = -(-rows // TASK_ROWS)
    return (parts,) if parts > spark.sparkContext.defaultParallelism else ()


def never_broadcast(df: DataFrame) -> DataFrame:
    """``df`` for a join in which Spark must not broadcast it. Of a written table Spark knows the compressed size alone: ten MB of
    Parquet can be some million rows of ids, a relation that the driver would have to hold."""
    return df.hint("merge")


def counted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", small_fits: bool | None = None) -> DataFrame:
    """Join that broadcasts ``small`` when its counted size allows (``small_fits`` saves the count) and shuffles both sides
    otherwise, whatever the size of its files."""
    few = fits(small) if small_fits is None else small_fits
    return big.join(F.broadcast(small) if few else never_broadcast(small), keys, how)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    salt_by: Column,
    how: str = "inner",
    small_fits: bool | None = None,
    salts: int = 64,
) -> DataFrame:
    """Join ``big`` with ``small`` on ``keys``.

    ``small`` is broadcast when its counted size allows (``small_fits`` saves the count when the caller
    knows). Otherwise the rows of every key of ``big`` are dealt over ``salts`` sub-keys (by ``salt_by``)
    and ``small`` is repeated once per sub-key, so a key holding a large share of ``big`` still spreads
    over ``salts`` tasks. The repeated side is never broadcast.
    """
    if fits(small) if small_fits is None else small_fits:
        return big.join(F.broadcast(small), keys, how)
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(never_broadcast(repeated), [*keys, "_salt"], how).drop("_salt")
