"""Run registered queries and their SQL side by side: ``python -m checks.compare <data folder> [names]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.workload import QUERIES


def local_session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def database(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(os.path.join(sf, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark: SparkSession, connection, sf: str, name: str) -> str:
    """Empty if equal, else what differs."""
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    cursor = connection.execute(ORACLES[name])
    columns = [part[0] for part in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got == want:
        return ""
    extra, missing = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return f"{len(got)} rows, {len(want)} expected; only here {extra}; only in SQL {missing}"


def main() -> None:
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    connection = database(sys.argv[1])
    for name in sys.argv[2:] or list(ORACLES):
        start = time.time()
        try:
            difference = compare(spark, connection, sys.argv[1], name)
        except Exception as problem:
            difference = f"{type(problem).__name__}: {str(problem)[:600]}"
        print(f"{'ok  ' if not difference else 'DIFF'} {name:24s} {time.time() - start:6.1f}s {difference[:1200]}", flush=True)


if __name__ == "__main__":
    main()
