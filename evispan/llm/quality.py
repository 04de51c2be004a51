"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

Training rows are a bounded, documented sample. Each epoch runs the updates in a few shards side by side from the same state
and averages the states. Scoring is one pass without shuffle: a sparse dot product per text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evispan.llm.common import HashCache, arrow_pass, mix64, parts
from evispan.session import materialize_plain as materialize

BITS = 18
EPOCHS, SHARDS = 8, 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.1, 0.05

# Words and runs of punctuation; case is kept, it tells shouting from prose.
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_SAME = np.uint64(0x5BD1E9955BD1E995)


class Features:
    """Hashed counts of words and word pairs of a text; a pair of equal words has one feature of its own besides."""

    def __init__(self, bits: int = BITS):
        self.mask, self.cache = np.uint64((1 << bits) - 1), HashCache()

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and values; the values' squares sum to 1. Null and empty texts have none."""
        one = self.cache.of(TOKEN.findall(text or ""))
        two = mix64(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])
        same = np.full(int((one[:-1] == one[1:]).sum()), _SAME)
        found, counts = np.unique(np.concatenate([one, two, same]) & self.mask, return_counts=True)
        value = np.log1p(counts)
        return found.astype(np.int32), (value / max(1e-12, np.sqrt((value * value).sum()))).astype(np.float32)


class Ftrl:
    """State and updates of FTRL-proximal logistic regression (McMahan et al. 2013)."""

    def __init__(self, size: int, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros(size) if z is None else z.astype(np.float64)
        self.n = np.zeros(size) if n is None else n.astype(np.float64)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        step = (BETA + np.sqrt(self.n[at])) / ALPHA + L2
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / step)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(at)
        g = (sigmoid(float(w @ value)) - label) * weight * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def feature_table(rows: DataFrame, bits: int = BITS) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        features = Features(bits)
        for batch in parts(batches, 1_000):
            ids, texts, labels = (batch.column(i).to_pylist() for i in range(3))
            found = [features.of(text) for text in texts]
            yield {"id": ids, "label": labels, "at": [a for a, _ in found], "value": [v for _, v in found]}

    return arrow_pass(rows.select(F.col("id").cast("long"), "text", "label"), task, "id bigint, label int, at array<int>, value array<float>")


def train(rows: DataFrame, bits: int = BITS, epochs: int = EPOCHS, shards: int = SHARDS) -> np.ndarray:
    """Weights (the last one is the bias) from ``id, text, label`` rows; without rows all weights are 0 (score 0.5).

    The rows must be a bounded sample. A hash of the id deals them to the shards, each written in the order of another, so the
    weights depend on the rows alone, not on how they lie in partitions. A shard goes through its rows in a new order
    each epoch. What returns to the driver is one state per shard and epoch.
    """
    spark, size = rows.sparkSession, (1 << bits) + 1
    found = materialize(feature_table(rows, bits), "quality-rows")
    dealt = [found.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == s) for s in range(shards)]
    order = (F.xxhash64("id", F.lit(1)), "id", "label", F.xxhash64("at", "value"))
    tables = [materialize(d.coalesce(1).sortWithinPartitions(*order), "quality-shard").coalesce(1) for d in dealt]
    table = reduce(DataFrame.union, tables)  # a task per shard, without a shuffle
    state = Ftrl(size)
    for epoch in range(epochs):
        shared = spark.sparkContext.broadcast((state.z, state.n))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            model, turn = Ftrl(size, *shared.value), np.random.default_rng(epoch)
            for batch in batches:
                label, at, value = (batch.column(i) for i in (1, 2, 3))
                starts, at, value = at.offsets.to_numpy(), at.values.to_numpy(), value.values.to_numpy()
                for i in turn.permutation(len(label)).tolist():
                    own = slice(starts[i], starts[i + 1])
                    model.learn(np.append(at[own], size - 1), np.append(value[own], np.float32(1)), label[i].as_py(), 1.0)
            used = np.flatnonzero(model.n)
            if len(used):
                yield {"at": [used.astype(np.int32)], "z": [model.z[used]], "n": [model.n[used]]}

        states = arrow_pass(table, task, "at array<int>, z array<double>, n array<double>").toArrow()
        if not states.num_rows:
            break
        z, n = np.zeros(size), np.zeros(size)
        for i in range(states.num_rows):
            at, own_z, own_n = (states.column(c)[i].values.to_numpy() for c in ("at", "z", "n"))
            z[at] += own_z
            n[at] += own_n
        state = Ftrl(size, z / states.num_rows, n / states.num_rows)
        shared.unpersist()
    return state.weights().astype(np.float32)


def quality_scores(docs: DataFrame, weights: np.ndarray, text_col: str = "text", name: str = "score", bits: int = BITS) -> DataFrame:
    """``docs`` with a column ``name`` (replaced if there): probability of label 1, between 0 and 1. Null and empty
    texts get the score of the bias alone. Every whole text is scored; rows are kept as they are."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    plain = docs.drop(name).withColumn(name, F.lit(0.0))
    columns = plain.columns
    at_text = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(bits), shared.value
        for batch in parts(batches, 1_000):
            scores = []
            for text in batch.column(at_text).to_pylist():
                at, value = features.of(text)
                scores.append(float(sigmoid(w[-1] + w[at] @ value)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], schema=batch.schema)

    return plain.mapInArrow(run, plain.schema)
