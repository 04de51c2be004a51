"""Pluggable models.

A plug-in is a factory without arguments. It is called once per task, so a client or a model is set up once
per task, and returns the callable that does the work:

* embed:     ``list[str] -> list[vector]`` or ``list[(index, vector)]``
* score:     ``(query, texts, top_n) -> list[{"index": int, "relevance_score": float}]``
* generate:  ``list[str] -> list[str]``
* classify:  ``list[str] -> list[bool]``, for guardrails also ``list[{"refused": bool, "reason": str, "violations": list[str]}]``
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from evispan.constants import EMBED_DIMS
from evispan.functions.text import fold_accents

Factory = Callable[[], Callable[..., Any]]
# Terms whose buckets a task remembers at most.
HELD_TERMS = 100_000


def hashed_terms_embedder(dims: int = EMBED_DIMS) -> Factory:
    """Deterministic default: counts of terms hashed into ``dims`` buckets, scaled to unit length."""

    def factory() -> Callable[[list[str]], list[np.ndarray]]:
        word = re.compile(r"[^\W_]+")
        buckets: dict[str, int] = {}

        def bucket(term: str) -> int:
            if term not in buckets:
                if len(buckets) >= HELD_TERMS:
                    buckets.clear()
                buckets[term] = int(hashlib.md5(term.encode()).hexdigest()[:4], 16) % dims
            return buckets[term]

        def embed(texts: list[str]) -> list[np.ndarray]:
            vectors = []
            for text in texts:
                hit = [bucket(term) for term in word.findall(fold_accents(text))]
                counts = np.bincount(np.asarray(hit, dtype=np.int64), minlength=dims).astype(np.float64)
                norm = np.sqrt(np.sum(counts * counts))
                vectors.append((counts / norm if norm else counts).astype(np.float32))
            return vectors

        return embed

    return factory


def run_texts(df: DataFrame, text: str, output: str, output_type: str, factory: Factory, batch: int = 16) -> DataFrame:
    """Add ``output`` (what the plug-in returns for ``text``) and ``<output>_error``. The rows of a batch that fails
    are asked again one by one, so a text fails only for itself, whatever it shares a batch with."""
    error = f"{output}_error"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = factory()

        def ask(part: list[str]) -> tuple[list, list]:
            try:
                got = list(call(part))
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} results for {len(part)} texts")
                return got, [None] * len(part)
            except Exception as problem:
                if len(part) == 1:
                    return [None], [f"{type(problem).__name__}: {problem}"]
            alone = [ask([one]) for one in part]
            return [v for values, _ in alone for v in values], [e for _, errors in alone for e in errors]

        for frame in frames:
            values, errors = [], []
            texts = frame[text].tolist()
            for start in range(0, len(texts), batch):
                got, failed = ask(texts[start : start + batch])
                values += got
                errors += failed
            yield frame.assign(**{output: pd.Series(values, index=frame.index, dtype=object), error: pd.Series(errors, index=frame.index, dtype=object)})

    columns = [f"`{field.name}` {field.dataType.simpleString()}" for field in df.schema]
    return df.mapInPandas(run, ", ".join([*columns, f"`{output}` {output_type}", f"`{error}` string"]))
