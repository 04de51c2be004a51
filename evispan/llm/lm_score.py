"""Scoring of documents with the subword lattice model, and the corpus counts it learns from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from evispan.llm.common import arrow_pass, parts
from evispan.llm.lattice import expected_counts, load_pieces, word_scores
from evispan.session import materialize_plain as materialize

# Most words (the frequent ones) whose counts and scores every task holds; all others are met by a join.
HELD_WORDS = 300_000
ROUNDS = 3
# Taken from each training word's count; the sum is what the subword segmentations share.
DISCOUNT = 0.75
# Weight of the vocabulary's own scores beside the expected counts.
PRIOR = 100.0


def _split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts (A-Z folded, cut at ASCII white space) and the row of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    there = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(there), row.filter(there).to_numpy()


def word_table(docs: DataFrame, held_out: Column, text_col: str = "text") -> DataFrame:
    """``word, c``: every word of every text with its count in the texts that aren't held out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in parts(batches, 4_000):
            flat, row = _split(batch.column(1))
            learn = ~batch.column(0).to_numpy(zero_copy_only=False)[row]
            coded = flat.dictionary_encode()
            code = coded.indices.to_numpy()
            n = np.bincount(code[learn], minlength=len(coded.dictionary)) if len(code) else np.zeros(0, np.int64)
            yield {"word": coded.dictionary, "c": pa.array(n.astype(np.int64))}

    counted = arrow_pass(docs.select(F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col)), task, "word string, c bigint")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def fit(words: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities. Each word type of the training texts counts once, for the segmentations stand in where
    words are new. Expected counts are summed in Spark; a row per piece returns to the driver."""
    prior = load_pieces(vocabulary).prior()
    p = prior
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(np.log(p))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            pieces, total = load_pieces(vocabulary), 0
            for batch in batches:
                own = batch.column(0).cast(pa.binary()).to_pylist()
                for at in range(0, len(own), 20_000):
                    part = own[at : at + 20_000]
                    total = total + expected_counts(part, np.ones(len(part)), pieces, shared.value)
            if np.ndim(total):
                used = np.flatnonzero(total)
                yield {"piece": used.astype(np.int32), "n": total[used]}

        sums = arrow_pass(words.where("c > 0").select("word"), task, "piece int, n double")
        found = sums.groupBy("piece").agg(F.sum("n").alias("n")).collect()
        if not found:
            break
        counts = PRIOR * prior
        counts[[r.piece for r in found]] += [r.n for r in found]
        p = counts / counts.sum()
        shared.unpersist()
    return p


def scored_words(words: DataFrame, vocabulary: str, p: np.ndarray) -> DataFrame:
    """``word, c, s``: natural log of the probability over all segmentations beside the count."""
    shared = words.sparkSession.sparkContext.broadcast(np.log(p))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pieces = load_pieces(vocabulary)
        for batch in batches:
            own = batch.column(0).cast(pa.binary()).to_pylist()
            s = [word_scores(own[at : at + 20_000], pieces, shared.value) for at in range(0, len(own), 20_000)]
            yield {"word": batch.column(0), "c": batch.column(1), "s": np.concatenate(s) if s else []}

    return arrow_pass(words.select("word", "c"), task, "word string, c bigint, s double")


def held_words(words: DataFrame, most: int = HELD_WORDS) -> DataFrame:
    """The words with the highest counts, ``most`` at the most: a histogram of counts says from which count on."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 16)
    sizes = {r.level: r.n for r in words.where("c > 0").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, least = 0, None
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > most:
            break
        least = at
    return words.where("c > 0").where(level >= least) if least is not None else words.limit(0)


def lattice_scores(
    docs: DataFrame, held_out: Column, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", held: int = HELD_WORDS
) -> DataFrame:
    """One row per input row: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A word's arcs are the vocabulary's pieces, and the word itself if it is a training word; the probability is the sum
    over all segmentations: (c - discount) / N for the word as one piece, and the mass that discounts free times the
    marginal of the subword lattice. The end has its own training frequency. Null and empty texts are an end alone. Repeated
    rows are scored (and learned from) once each; without training rows every word is left to the lattice and
    ``base_score`` follows its formula with N = V = 0. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    counted = materialize(word_table(plain, F.col("held_out")), "words")
    ends = plain.where("NOT held_out").count()
    total, types = counted.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = total + ends, types + (ends > 0)
    words = materialize(scored_words(counted, vocabulary, fit(counted, vocabulary)), "word-scores")
    mass = DISCOUNT * types / n if types else 1.0
    end_score, end_base = (np.log10(ends / n) if ends else 0.0), np.log10((ends + 0.5) / (n + 0.5 * (v + 1)))

    def base_of(c):
        return np.log10((c + 0.5) / (n + 0.5 * (v + 1)))

    def score_of(c, s):
        # In logs, for a long word's marginal is below what a float can hold.
        whole = np.log(np.maximum(c - DISCOUNT, 1e-300) / max(n, 1))
        return np.where(c > 0, np.logaddexp(whole, np.log(mass) + s), np.log(mass) + s) / np.log(10)

    rows = held_words(words, held).toArrow()
    frequent, c, s = rows.column("word").combine_chunks(), rows.column("c").to_numpy(), rows.column("s").to_numpy()
    shared = spark.sparkContext.broadcast((frequent, np.append(base_of(c), 0.0), np.append(score_of(c, s), 0.0)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        frequent, base, score = shared.value
        for batch in parts(batches, 2_000):
            size = batch.num_rows
            flat, row = _split(batch.column(3))
            coded = flat.dictionary_encode()
            at = pc.fill_null(pc.index_in(coded.dictionary, value_set=frequent), len(frequent)).to_numpy()[coded.indices.to_numpy()]
            rare = at == len(frequent)
            ends_at = np.r_[0, np.cumsum(np.bincount(row[rare], minlength=size))].astype(np.int32)
            yield {
                "row_id": batch.column(0),
                "id": batch.column(1),
                "held_out": batch.column(2),
                "n_tokens": np.bincount(row, minlength=size) + 1,
                "n_known": np.bincount(row[~rare], minlength=size) + (1 if ends else 0),
                "base": np.bincount(row, weights=base[at], minlength=size) + end_base,
                "score": np.bincount(row, weights=score[at], minlength=size) + end_score,
                "rare": pa.ListArray.from_arrays(ends_at, flat.filter(pa.array(rare))),
            }

    numbered = plain.select(F.monotonically_increasing_id().alias("row_id"), F.col("id").cast("long"), "held_out", "text")
    schema = "row_id bigint, id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<string>"
    part = materialize(arrow_pass(numbered, task, schema), "lm-rows")
    log10 = np.log(10.0)
    unit = F.lit(float(n + 0.5 * (v + 1)))
    subword = F.lit(float(np.log(mass))) + F.col("s")
    whole = F.log((F.col("c") - DISCOUNT) / max(n, 1))
    top = F.greatest(whole, subword)
    both = top + F.log(F.exp(whole - top) + F.exp(subword - top))
    facts = words.select(
        "word",
        (F.col("c") > 0).cast("long").alias("known"),
        F.log10((F.col("c") + 0.5) / unit).alias("base"),
        (F.when(F.col("c") > 0, both).otherwise(subword) / log10).alias("score"),
    )
    rest = (
        part.select("row_id", F.explode("rare").alias("word"))
        .join(facts, "word")
        .groupBy("row_id")
        .agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("score").alias("more_score"))
    )
    zero = F.lit(0)
    return part.drop("rare").join(rest, "row_id", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )
