"""Cells of a vector table: exact nearest neighbours that skip cells which can't hold one.

Every vector belongs to the nearest of its collection's pivots, which are vectors taken by a hash of their ids. A cell's radius is the
largest distance to its pivot, so by the triangle inequality all of its vectors are at least (distance of query and pivot)
minus radius away. The nearest cells of a query give a distance that ``k`` vectors reach; other cells are read only
if they can beat it. Pivots decide how much is skipped, never what is found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evispan.constants import FETCH_K
from evispan.operators.lexical import top_k
from evispan.operators.vector import NEAR, QUERY_BLOCK, VECTOR_BLOCK, _matrix, _near_blocks
from evispan.session import materialize

# Vectors per cell aimed at, and cells of a collection at most: beyond that cells hold more vectors.
CELL_ROWS, MOST_CELLS = 1_024, 1_024
# Distances are rounded; a cell must miss by more than this.
SLACK = 1e-5
SLOT = "\x01"


@dataclass(frozen=True)
class CellIndex:
    """``vectors (slot, chunk_id, embedding)`` sorted by slot (a collection's cell), and ``cells (collection_id, slot, pivot, radius, n)``."""

    vectors: DataFrame
    cells: DataFrame


def _block(count: str, size: int, column: str):
    return F.pmod(F.xxhash64(column), F.greatest(F.lit(1), F.ceil(F.col(count) / size))).cast("int")


def _blocks(count: str, size: int):
    return F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col(count) / size)).cast("int") - 1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))


def build_cells(vectors: DataFrame, cell_rows: int = CELL_ROWS) -> CellIndex:
    """Cells of ``vectors (collection_id, chunk_id, embedding)``; rows without embedding are left out. Written.

    Vectors go in blocks of a bounded size to the pivots of their collection, so one large collection spreads over many tasks.
    """
    stored = vectors.where(F.col("embedding").isNotNull()).select("collection_id", "chunk_id", "embedding")
    counts = stored.groupBy("collection_id").agg(F.count(F.lit(1)).alias("rows"), F.min("chunk_id").alias("first"))
    counts = materialize(counts, "cell-counts")
    known = stored.join(counts, "collection_id")
    taken = F.pmod(F.xxhash64("chunk_id"), F.col("rows")) < F.least(F.ceil(F.col("rows") / cell_rows), F.lit(MOST_CELLS))
    pivots = known.where(taken | (F.col("chunk_id") == F.col("first"))).dropDuplicates(["collection_id", "chunk_id"])
    pivots = materialize(pivots.select("collection_id", "rows", F.col("chunk_id").alias("pivot_id"), F.col("embedding").alias("pivot")), "pivots")

    def assign(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        columns = ["slot", "chunk_id", "embedding", "distance"]
        if part.empty:
            return pd.DataFrame(columns=columns)
        own = own.sort_values("pivot_id")  # of equally near pivots the smallest
        distance = _distances(_matrix(part["embedding"]), _matrix(own["pivot"]))
        nearest = distance.argmin(1)
        slots = own["collection_id"].iloc[0] + SLOT + own["pivot_id"].astype(str)
        return part.assign(slot=slots.to_numpy()[nearest], distance=distance[np.arange(len(part)), nearest])[columns]

    keys = ["collection_id", "block"]
    left = known.withColumn("block", _block("rows", VECTOR_BLOCK, "chunk_id")).select(*keys, "chunk_id", "embedding")
    right = pivots.withColumn("block", _blocks("rows", VECTOR_BLOCK)).drop("rows")
    assigned = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        assign, "slot string, chunk_id bigint, embedding array<float>, distance double"
    )
    placed = materialize(assigned.repartitionByRange("slot", "chunk_id").sortWithinPartitions("slot", "chunk_id"), "cell-vectors")
    sizes = placed.groupBy("slot").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n"))
    named = pivots.withColumn("slot", F.concat("collection_id", F.lit(SLOT), F.col("pivot_id").cast("string")))
    return CellIndex(placed.drop("distance"), materialize(named.join(sizes, "slot").select("collection_id", "slot", "pivot", "radius", "n"), "cells"))


LIVE = "query_id string, slot string, query_vector array<float>, nearest double, opening boolean"


def live_cells(index: CellIndex, queries: DataFrame, k: int = FETCH_K) -> DataFrame:
    """``query_id, slot, query_vector, nearest, opening``: the cells of a query's collection that can hold one of its ``k``
    nearest vectors by the cells' sizes and radii alone. ``nearest`` is the least distance of their vectors; the nearest cells
    that hold ``k`` vectors together are ``opening``."""

    def run(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or own.empty:
            return pd.DataFrame(columns=["query_id", "slot", "query_vector", "nearest", "opening"])
        own = own.sort_values("slot", ignore_index=True)
        radius, n = own["radius"].to_numpy(), own["n"].to_numpy()
        distance = _distances(_matrix(asked["query_vector"]), _matrix(own["pivot"]))
        out = []
        for query, vector, far in zip(asked["query_id"], asked["query_vector"], distance):
            within = np.argsort(far + radius, kind="stable")  # k vectors are surely as near as the last of these
            held = np.searchsorted(np.cumsum(n[within]), k)
            reach = (far + radius)[within[held]] if held < len(n) else np.inf
            order = np.argsort(far, kind="stable")
            opening = np.zeros(len(n), bool)
            opening[order[: np.searchsorted(np.cumsum(n[order]), k) + 1]] = True
            near = np.maximum(far - radius, 0.0)
            for i in np.flatnonzero((near <= reach + SLACK) | opening):
                out.append((query, own["slot"][i], vector, near[i], bool(opening[i])))
        return pd.DataFrame(out, columns=["query_id", "slot", "query_vector", "nearest", "opening"])

    counts = queries.groupBy("collection_id").agg(F.count(F.lit(1)).alias("asked"))
    keys = ["collection_id", "block"]
    asked = queries.where(F.col("query_vector").isNotNull()).join(counts, "collection_id")
    left = asked.withColumn("block", _block("asked", QUERY_BLOCK, "query_id")).select(*keys, "query_id", "query_vector")
    right = index.cells.join(counts, "collection_id").withColumn("block", _blocks("asked", QUERY_BLOCK)).drop("asked")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, LIVE)


def _scan(index: CellIndex, pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest vectors of every query in each of its cells; a cell and its queries meet in bounded blocks."""
    stored = index.vectors.withColumnRenamed("slot", "collection_id")
    return _near_blocks(stored, pairs.withColumnRenamed("slot", "collection_id").select("query_id", "collection_id", "query_vector"), k)


def cell_pairs(index: CellIndex, queries: DataFrame, k: int = FETCH_K) -> tuple[DataFrame, DataFrame]:
    """Nearest vectors found in the opening cells, and the further pairs ``(query_id, slot, query_vector)`` that must be read."""
    live = materialize(live_cells(index, queries, k), "live-cells")
    found = materialize(_scan(index, live.where("opening"), k), "opened")
    best = top_k(found, k, F.col("distance"), "chunk_id")
    reached = best.where(F.col("rank") == k).select("query_id", F.sqrt(F.col("distance") + SLACK).alias("reached"))
    rest = live.where("NOT opening").join(reached, "query_id", "left")
    return found, rest.where(F.col("reached").isNull() | (F.col("nearest") <= F.col("reached") + SLACK)).drop("reached")


def vector_topk_cells(index: CellIndex, queries: DataFrame, k: int = FETCH_K) -> DataFrame:
    """``(query_id, collection_id, chunk_id, distance, embedding, rank)`` as of ``vector_topk``, from the cells that matter. Exact:
    ties by chunk id, queries without vector or collection give no rows."""
    found, rest = cell_pairs(index, queries, k)
    near = found.unionByName(_scan(index, rest, k)).withColumn("collection_id", F.substring_index("collection_id", SLOT, 1))
    return top_k(near.select(*(part.split()[0] for part in NEAR.split(", "))), k, F.col("distance"), "chunk_id")
