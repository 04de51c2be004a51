"""Embedding, exact nearest neighbours and diversity selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evispan.constants import (
    CANDIDATES,
    EMBED_BATCH,
    EMBED_REFUSED,
    EMBED_RETRIES,
    EMBED_SHORT_BATCH,
    EMBED_TIMEOUT,
    EMBED_UNREACHABLE,
    FETCH_K,
    MMR_LAMBDA,
)
from evispan.operators.lexical import top_k
from evispan.plugins import Factory, hashed_terms_embedder
from evispan.session import PRUNE_VALUES, never_broadcast, spread

DISTANCE_DECIMALS = 6
BROADCAST_QUERIES = 4_096
QUERY_BLOCK = 2_048
VECTOR_BLOCK = 8_192
# Distances held at a time (a few arrays of so many doubles), and vectors that meet the queries at a time.
DISTANCE_CELLS = 500_000
NEAR_ROWS = 2_048
# Rows whose vectors a task holds before they are handed on.
EMBED_ROWS = 1_024


def embed(
    df: DataFrame,
    text: str = "text",
    factory: Factory | None = None,
    batch_size: int = EMBED_BATCH,
    retries: int = EMBED_RETRIES,
    dealt: bool = False,
) -> DataFrame:
    """Add ``embedding``, ``embed_status`` and ``embed_error``. Texts go to the plug-in in batches; a batch
    that still fails after the retries leaves its rows without a vector and with the status of the failure. Rows that are
    ``dealt`` out stay where they are. Vectors leave a task some batches at a time, so it doesn't hold those of a whole frame."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    make = factory or hashed_terms_embedder()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()

        def one(batch: list[str]) -> tuple[list, int | None, str | None]:
            failure = EMBED_REFUSED
            for _ in range(retries + 1):
                try:
                    got = list(call(batch))
                except Exception as problem:
                    if isinstance(problem, TimeoutError) or getattr(problem, "status_code", None) == 408:
                        failure = EMBED_TIMEOUT
                    elif isinstance(problem, ConnectionError):
                        failure = EMBED_UNREACHABLE
                    else:
                        failure = EMBED_REFUSED
                    continue
                if got and isinstance(got[0], tuple):
                    got = [vector for _, vector in sorted(got, key=lambda pair: pair[0])]
                if len(got) != len(batch):
                    failure = EMBED_SHORT_BATCH
                    break
                return [np.asarray(vector, dtype=np.float32) for vector in got], None, None
            return [None] * len(batch), *failure

        rows = batch_size * max(1, EMBED_ROWS // batch_size)
        for frame in frames:
            for at in range(0, len(frame), rows):
                part = frame.iloc[at : at + rows]
                vectors, statuses, errors = [], [], []
                texts = part[text].tolist()
                for start in range(0, len(texts), batch_size):
                    got, status, error = one(texts[start : start + batch_size])
                    vectors += got
                    statuses += [status] * len(got)
                    errors += [error] * len(got)
                yield part.drop(columns=drop).assign(
                    embedding=pd.Series(vectors, index=part.index, dtype=object),
                    embed_status=pd.array(statuses, dtype="Int32"),
                    embed_error=pd.Series(errors, index=part.index, dtype=object),
                )

    keep = [field for field in df.schema if field.name != text]
    drop = [text]
    columns = [f"`{field.name}` {field.dataType.simpleString()}" for field in keep]
    out = ", ".join([*columns, "embedding array<float>", "embed_status int", "embed_error string"])
    return (df if dealt else spread(df)).mapInPandas(run, out)


def _nearest(ids, vectors, query_ids, queries, k: int) -> pd.DataFrame:
    """The ``k`` nearest of ``vectors`` for every query, by (squared distance, id), as a small frame. Queries
    go in slices, so the distances held at a time do not grow with their number."""
    size = max(1, DISTANCE_CELLS // len(vectors))
    slices = [slice(start, start + size) for start in range(0, len(queries), size)]
    return pd.concat(
        [_nearest_slice(ids, vectors, query_ids[part], queries[part], k) for part in slices], ignore_index=True
    )


def _nearest_slice(ids, vectors, query_ids, queries, k: int) -> pd.DataFrame:
    squared = (queries**2).sum(1)[:, None] + (vectors**2).sum(1)[None, :] - 2.0 * (queries @ vectors.T)
    distance = np.round(np.maximum(squared, 0.0), DISTANCE_DECIMALS)
    if distance.shape[1] > k:
        bound = np.partition(distance, k - 1, axis=1)[:, k - 1 : k]
        at_query, at_vector = np.nonzero(distance <= bound)
    else:
        at_query, at_vector = (part.ravel() for part in np.indices(distance.shape))
    near = pd.DataFrame(
        {
            "query_id": np.asarray(query_ids, dtype=object)[at_query],
            "chunk_id": ids[at_vector],
            "distance": distance[at_query, at_vector],
            "at": at_vector,
        }
    )
    near = near.sort_values(["query_id", "distance", "chunk_id"]).groupby("query_id", sort=False).head(k)
    near["embedding"] = list(vectors[near.pop("at").to_numpy()].astype(np.float32))
    return near


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


NEAR = "query_id string, collection_id string, chunk_id bigint, distance double, embedding array<float>"


def vector_topk(
    vectors: DataFrame, queries: DataFrame, k: int = FETCH_K, broadcast_queries: int = BROADCAST_QUERIES
) -> DataFrame:
    """``(query_id, collection_id, chunk_id, distance, embedding, rank)``: the ``k`` nearest chunks of each
    query ``(query_id, collection_id, query_vector)`` by squared distance, ties by chunk id. Exact.

    Up to ``broadcast_queries`` queries travel to the vectors: each task multiplies blocks and keeps only the
    best ``k`` per query, so the shuffle carries k rows per query and task. With more queries both sides are
    cut into blocks and each pair of blocks is one bounded group.
    """
    stored = vectors.where(F.col("embedding").isNotNull()).select("collection_id", "chunk_id", "embedding")
    asked = queries.where(F.col("query_vector").isNotNull()).select("query_id", "collection_id", "query_vector")
    head = asked.limit(broadcast_queries + 1).toPandas()
    near = (
        _near_broadcast(stored, head, k) if len(head) <= broadcast_queries else _near_blocks(stored, asked, k)
    )
    return top_k(near, k, F.col("distance"), "chunk_id")


def _near_broadcast(vectors: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    spark = vectors.sparkSession
    by_collection = {
        collection: (part["query_id"].to_numpy(), _matrix(part["query_vector"]))
        for collection, part in queries.groupby("collection_id")
    }
    shared = spark.sparkContext.broadcast(by_collection)
    if len(by_collection) <= PRUNE_VALUES:
        vectors = vectors.where(F.col("collection_id").isin(list(by_collection)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, pd.DataFrame] = {}
        for frame in (whole.iloc[at : at + NEAR_ROWS] for whole in frames for at in range(0, len(whole), NEAR_ROWS)):
            for collection, part in frame.groupby("collection_id"):
                if collection not in shared.value:
                    continue
                query_ids, matrix = shared.value[collection]
                near = _nearest(part["chunk_id"].to_numpy(), _matrix(part["embedding"]), query_ids, matrix, k)
                if collection in best:
                    near = pd.concat([best[collection], near], ignore_index=True)
                    near = near.sort_values(["query_id", "distance", "chunk_id"]).groupby("query_id").head(k)
                best[collection] = near
        for collection, near in best.items():
            yield near.assign(collection_id=collection)[
                ["query_id", "collection_id", "chunk_id", "distance", "embedding"]
            ]

    return spread(vectors).mapInPandas(run, NEAR)


def _near_blocks(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Every block of queries meets every block of vectors of its collection in one group; the numbers of
    blocks follow the counted sizes, so groups stay bounded however large a collection is."""

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("collection_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name))

    counts = blocks(queries, QUERY_BLOCK, "query_blocks").join(blocks(vectors, VECTOR_BLOCK, "vector_blocks"), "collection_id")

    def block(column: str, count: str):
        return F.pmod(F.xxhash64(column), F.col(count)).cast("int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = (
        vectors.join(counts, "collection_id")
        .withColumn("vector_block", block("chunk_id", "vector_blocks"))
        .withColumn("query_block", every("query_blocks"))
        .drop("query_blocks", "vector_blocks")
    )
    right = (
        queries.join(counts, "collection_id")
        .withColumn("query_block", block("query_id", "query_blocks"))
        .withColumn("vector_block", every("vector_blocks"))
        .drop("query_blocks", "vector_blocks")
    )
    keys = ["collection_id", "query_block", "vector_block"]

    def run(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "collection_id", "chunk_id", "distance", "embedding"]
        if part.empty or asked.empty:
            return pd.DataFrame(columns=columns)
        near = _nearest(
            part["chunk_id"].to_numpy(), _matrix(part["embedding"]),
            asked["query_id"].to_numpy(), _matrix(asked["query_vector"]), k,
        )
        return near.assign(collection_id=part["collection_id"].iloc[0])[columns]

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, NEAR)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of every row of ``a`` with every row of ``b``; 0 where a vector has no length."""
    lengths = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return np.round(np.divide(a @ b.T, lengths, out=np.zeros(lengths.shape), where=lengths > 0), 6)


def mmr_select(
    near: DataFrame, queries: DataFrame, k: int = CANDIDATES, lambda_mult: float = MMR_LAMBDA
) -> DataFrame:
    """``(query_id, collection_id, chunk_id, mmr_rank)``: ``k`` of the nearest chunks of each query, taken one
    by one for similarity to the query minus similarity to those already taken. A group holds one query's
    nearest chunks (fetch_k rows at most)."""

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk_id", ignore_index=True)
        vectors = _matrix(frame["embedding"])
        relevance = cosine(_matrix(frame["query_vector"].head(1)), vectors)[0]
        among = cosine(vectors, vectors)
        taken = [int(np.argmax(relevance))]
        while len(taken) < min(k, len(frame)):
            value = lambda_mult * relevance - (1 - lambda_mult) * among[:, taken].max(axis=1)
            value[taken] = -np.inf
            taken.append(int(np.argmax(value)))
        return frame.loc[taken, ["query_id", "collection_id", "chunk_id"]].assign(mmr_rank=range(1, len(taken) + 1))

    joined = near.select("query_id", "collection_id", "chunk_id", "embedding").join(
        never_broadcast(queries.select("query_id", "query_vector")), "query_id"
    )
    return joined.groupBy("query_id").applyInPandas(
        pick, "query_id string, collection_id string, chunk_id bigint, mmr_rank int"
    )
