"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios (Wang and Manning 2012).

A text's features are the hashed 3- to 5-grams of code points it holds (presence, white space collapsed, A-Z folded). The ratio of how
often a feature occurs in either class scales it; logistic regression on the scaled features is fitted by full-batch
steps, with gradients summed over the partitions of a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evispan.llm.common import FOLD, arrow_pass, mix64, parts
from evispan.session import materialize_plain as materialize

BITS, SHORTEST, LONGEST = 20, 3, 5
# Smoothing of the counts, least training texts per feature, and the settings of the fit.
SMOOTH, LEAST_TEXTS = 1.0, 3
STEPS, RATE, MOMENTUM, PENALTY, SCALE = 30, 1.0, 0.9, 1e-5, 10.0
SAMPLE_ROWS = 8_000
# Tasks whose sums return to the driver; the sample is bounded, so their number is too.
TASKS = 6
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Hashed character n-grams of a text: sorted, distinct feature numbers."""

    def __init__(self, bits: int = BITS, shortest: int = SHORTEST, longest: int = LONGEST):
        self.bits, self.sizes = bits, (shortest, longest)
        self.seen = np.zeros(1 << bits, bool)

    def of(self, text: str) -> np.ndarray:
        plain = b" " + b" ".join((text or "").encode().translate(FOLD).split()) + b" "
        code = np.frombuffer(plain.decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
        mask, found, key = np.uint64((1 << self.bits) - 1), [], code
        for n in range(2, self.sizes[1] + 1):
            if len(code) < n:
                break
            key = key[:-1] * _STEP + code[n - 1 :]
            if n >= self.sizes[0]:
                found.append((mix64(key + np.uint64(n << 56)) & mask).astype(np.int64))
        if not found:
            return np.zeros(0, np.int32)
        every = np.concatenate(found)
        self.seen[every] = True
        if len(every) > len(self.seen) // 16:
            distinct = np.flatnonzero(self.seen)
        else:
            every.sort()
            distinct = every[np.r_[True, every[1:] != every[:-1]]]
        self.seen[distinct] = False
        return distinct.astype(np.int32)


@dataclass
class Model:
    """Weight times ratio of every hashed feature, which features count, and the bias."""

    weights: np.ndarray
    used: np.ndarray
    bias: float

    def score(self, at: np.ndarray) -> float:
        at = at[self.used[at]]
        z = SCALE * float(self.weights[at].sum()) / max(1.0, np.sqrt(len(at))) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def feature_table(rows: DataFrame, bits: int = BITS) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        grams = Grams(bits)
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                yield {"label": labels[at : at + 500], "at": [grams.of(t) for t in texts[at : at + 500]]}

    return arrow_pass(rows.select("text", "label"), task, "label int, at array<int>")


def _entries(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Labels, row number and feature of each entry, for some feature rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            labels, lists = (c.slice(start, rows) for c in batch.columns)
            lengths = np.diff(lists.offsets.to_numpy())
            yield labels.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy()


def train(rows: DataFrame, bits: int = BITS, steps: int = STEPS) -> Model:
    """Fit on ``text, label`` rows, which must be a bounded sample. A sample without rows of both classes tells
    nothing: its ratios are 0 and the score is that of the bias. Sums over features return to the driver, never rows.
    """
    spark, size = rows.sparkSession, 1 << bits
    table = materialize(feature_table(rows, bits).repartition(TASKS), "toxic-rows").coalesce(TASKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, n = np.zeros((2, size)), np.zeros(2)
        for labels, row, at in _entries(batches):
            for label in (0, 1):
                held[label] += np.bincount(at[labels[row] == label], minlength=size)
                n[label] += (labels == label).sum()
        used = np.flatnonzero(held.sum(0))
        yield {"n": [n.tolist()], "at": [used.astype(np.int32)], "none": [held[0][used]], "some": [held[1][used]]}

    held, n = np.zeros((2, size)), np.zeros(2)
    sums = arrow_pass(table, count, "n array<double>, at array<int>, none array<double>, some array<double>").toArrow()
    for i in range(sums.num_rows):
        own, at, none, some = (sums.column(c)[i].values.to_numpy() for c in ("n", "at", "none", "some"))
        n += own
        held[0][at] += none
        held[1][at] += some
    ratio = np.log((held[1] + SMOOTH) / (n[1] + 2 * SMOOTH)) - np.log((held[0] + SMOOTH) / (n[0] + 2 * SMOOTH))
    used = held.sum(0) >= LEAST_TEXTS
    if not n.all():
        return Model(np.zeros(size, np.float32), used, float(np.log((n[1] + SMOOTH) / (n[0] + SMOOTH))))
    number = np.full(size, -1, np.int32)
    number[used] = np.arange(used.sum())
    ratio, total = ratio[used], n.sum()
    fixed = spark.sparkContext.broadcast((number, ratio))
    w = np.zeros(len(ratio) + 1)
    move = np.zeros_like(w)
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(w)

        def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            (number, ratio), w = fixed.value, shared.value
            wide, out = w[:-1] * ratio, np.zeros(len(w))
            for labels, row, at in _entries(batches):
                at = number[at]
                row, at = row[at >= 0], at[at >= 0]
                scale = SCALE / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(labels))))
                z = np.bincount(row, weights=wide[at], minlength=len(labels)) * scale + w[-1]
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
                out[:-1] += np.bincount(at, weights=(error * scale)[row], minlength=len(ratio))
                out[-1] += error.sum()
            yield {"g": [out.astype(np.float32)]}

        g = np.zeros_like(w)
        for part in arrow_pass(table, gradient, "g array<float>").toArrow().column("g"):
            g += part.values.to_numpy()
        g /= total
        g[:-1] = g[:-1] * ratio + PENALTY * w[:-1]
        move = MOMENTUM * move - RATE * g
        w = w + move
        shared.unpersist()
    weights = np.zeros(size, np.float32)
    weights[used] = w[:-1] * ratio
    return Model(weights, used, float(w[-1]))


def toxicity_scores(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score", bits: int = BITS) -> DataFrame:
    """``docs`` with a column ``name`` (replaced if there): probability of label 1. Null and empty texts get the score
    of their single blank, that is of the bias. Every whole text is scored; rows are kept as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop(name).withColumn(name, F.lit(0.0))
    at_text = plain.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, fitted = Grams(bits), shared.value
        for batch in parts(batches, 1_000):
            scores = [fitted.score(grams.of(text)) for text in batch.column(at_text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], schema=batch.schema)

    return plain.mapInArrow(run, plain.schema)
