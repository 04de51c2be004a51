"""Shared small helpers: tables, text as bytes, Arrow passes, bounded hash caches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ASCII white space that separates words, and the upper-case letters that are folded.
SPACES = r"[\x20\x09-\x0D]"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the decimal text of ``key``, modulo ``folds``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on into other tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim:
        trim(0)


def arrow_pass(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for a task that takes batches and yields ``{column: values}``."""
    names = [part.strip().split()[0] for part in _split_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in task(batches):
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, pa.Array) else pa.array(v, types[n]) for n, v in ((n, columns[n]) for n in names)],
                names=names,
            )
        give_back()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    types = {field.name: field.type for field in arrow}
    return df.mapInArrow(run, schema)


def _split_schema(schema: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(schema[start:i])
            start = i + 1
    return [*parts, schema[start:]]


def parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``rows`` rows, so that what is worked out for a part stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Words of a text after A-Z became lower case; cut at ASCII white space only."""
    return text.translate(FOLD).split()


class HashCache(dict):
    """64-bit hashes of byte strings; forgets everything when ``limit`` entries are held."""

    def __init__(self, limit: int = 300_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, key: bytes) -> int:
        value = self[key] = xxhash.xxh3_64_intdigest(key, self.seed)
        return value

    def of(self, items: Sequence[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, items), np.uint64, len(items))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def only(df: DataFrame, *wanted: str) -> DataFrame:
    """The wanted columns alone, so that extra columns of any name can't clash with what an operator adds."""
    return df.select(*(F.col(f"`{c}`") for c in wanted))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each lengthened until no column of ``df`` has it (case doesn't count)."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A unique number per row; stable only in a table that is written right after."""
    return df.withColumn(name, F.monotonically_increasing_id())


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read any more."""
    for df in tables:
        hadoop = df.sparkSession._jsc.hadoopConfiguration()
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)
