"""Lexical index and BM25 retrieval, set-at-a-time.

The index holds a forward table (terms of every chunk), postings sorted by (collection, term, chunk), and one row per block of a
postings list with what bounds the scores inside. Top-k retrieval is exact without scoring everything: rare terms find pilots,
the pilots' scores give a threshold, and only postings whose terms and blocks can still pass it are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from evispan.constants import BM25_B, BM25_K1, CANDIDATES
from evispan.functions.stopwords import stopwords as default_stopwords
from evispan.functions.text import normalize_text, remove_stopwords, strip, term_counts, tokenize
from evispan.session import counted_join, fits, materialize, never_broadcast, parts_of, prune, salted_join, spread

SCORE_DECIMALS = 6
# Chunk numbers per block of a postings list.
BLOCK_CHUNKS = 256
# Pilots per asked row, and the postings of a query's rarest terms among which they are found.
PILOTS, PILOT_POSTINGS = 2, 20
# Matches of query terms and postings up to which all of them are scored. Finding out which matter takes a row of a shuffle for every block of a
# postings list that a query can't leave out, and for every chunk found there; matches scored block by block take none.
FULL_SCORING = 1_000_000_000_000
# Matches up to which each is a row; more are added up in arrays, block by block.
ROW_SCORING = 20_000_000
# Postings of a block of chunks, and terms of a block of queries: what meets in one group.
BLOCK_POSTINGS, BLOCK_TERMS = 2_000_000, 500_000
# Bytes of tokens that a task counts at a time.
COUNTED_BYTES = 8_000_000
# Scores are rounded; a bound must miss the threshold by more than this.
SLACK = 1e-5


@dataclass(frozen=True)
class LexicalIndex:
    """Forward table ``(collection_id, chunk_id, dl, terms)``, per-collection statistics, stored postings ``(collection_id, term,
    chunk_id, tf, dl)`` and their blocks ``(collection_id, term, block, n, max_tf, min_dl)``; rows of several parts of an index
    add up."""

    forward: DataFrame
    stats: DataFrame
    postings: DataFrame
    blocks: DataFrame


def forward_table(
    chunks: DataFrame, stopwords: Sequence[str] | None = None, exact: bool = True, key: str = "text", dealt: bool = False
) -> DataFrame:
    """One row per chunk with its counted terms. Chunks with empty text are dropped; chunks whose text has
    no terms stay and count in N with length 0. Narrow: no shuffle; rows that are ``dealt`` out stay where they are."""
    words = default_stopwords() if stopwords is None else stopwords
    filled = chunks.where(F.length(key) > 0)
    filled = filled if dealt else spread(filled, "collection_id", "chunk_id")
    tokens = filled.select("collection_id", "chunk_id", F.array_join(tokenize(normalize_text(F.col(key), exact)), " ").alias("tokens"))
    kept = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in tokens.schema[:2])
    return tokens.mapInArrow(_count_terms(list(words)), f"{kept}, dl int, terms array<struct<term: string, tf: int>>")


def _count_terms(stopwords: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``term_counts`` gives for the rows' tokens (one text, a blank between two) without stop words, for many rows at once: tokens
    become numbers in the order of their text, and pairs of row and number are sorted and counted."""

    def counted(part: pa.RecordBatch) -> pa.RecordBatch:
        split = pc.split_pattern(part.column("tokens"), " ")
        coded = split.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        terms = coded.dictionary.take(pa.array(order))
        numbers = np.empty(len(order), np.int64)
        numbers[order] = np.arange(len(order))
        left_out = pc.is_in(terms, value_set=pa.array([*stopwords, ""], terms.type)).to_numpy(zero_copy_only=False)
        number = numbers[coded.indices.to_numpy()]
        kept = ~left_out[number]
        row = pc.list_parent_indices(split).to_numpy()[kept].astype(np.int64)
        found, times = np.unique(row * len(terms) + number[kept], return_counts=True)
        ends = np.searchsorted(found, np.arange(len(part) + 1) * len(terms)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([terms.take(pa.array(found % max(1, len(terms)))), pa.array(times.astype(np.int32))], ["term", "tf"])
        length = pa.array(np.bincount(row, minlength=len(part)).astype(np.int32))
        columns = [part.column(0), part.column(1), length, pa.ListArray.from_arrays(pa.array(ends), pairs)]
        return pa.RecordBatch.from_arrays(columns, [*part.schema.names[:2], "dl", "terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(pc.binary_length(batch.column("tokens")).to_numpy())
            start = 0
            while start < len(batch):
                before = upto[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(upto, before + COUNTED_BYTES, "right")))
                yield counted(batch.slice(start, end - start))
                start = end

    return run


def partial_stats(forward: DataFrame) -> DataFrame:
    """``(collection_id, n_chunks, total_dl)``; rows of several parts of an index add up."""
    return forward.groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.col("dl").cast("long")).alias("total_dl")
    )


def collection_stats(partial: DataFrame) -> DataFrame:
    """``(collection_id, n_chunks, avgdl)``."""
    return partial.groupBy("collection_id").agg(
        F.sum("n_chunks").alias("n_chunks"), (F.sum("total_dl") / F.sum("n_chunks")).alias("avgdl")
    )


def postings(forward: DataFrame) -> DataFrame:
    """``(collection_id, term, chunk_id, tf, dl)``. The outer form of the generator keeps Spark from adding
    a second evaluation of the term arrays as an inferred filter."""
    return (
        forward.select("collection_id", "chunk_id", "dl", F.inline_outer("terms"))
        .where(F.col("term").isNotNull())
        .select("collection_id", "term", "chunk_id", "tf", "dl")
    )


def block_of(chunk_id: Column) -> Column:
    return F.floor(chunk_id / BLOCK_CHUNKS).cast("bigint")


def posting_blocks(postings_: DataFrame, rows: int = 0) -> DataFrame:
    """``(collection_id, term, block, n, max_tf, min_dl)`` of at most ``rows`` postings, in order: ranges of blocks are dealt out and grouped
    where they are, in one shuffle. A block has ``BLOCK_CHUNKS`` postings at most, so hot terms are spread."""
    keys = ["collection_id", "term", "block"]
    placed = postings_.withColumn("block", block_of(F.col("chunk_id"))).repartitionByRange(*parts_of(postings_.sparkSession, rows), *keys)
    blocks = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    return blocks.sortWithinPartitions(*keys)


def term_df(blocks: DataFrame) -> DataFrame:
    """``(collection_id, term, df, max_tf, min_dl)`` from the blocks of the postings lists."""
    return blocks.groupBy("collection_id", "term").agg(
        F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")
    )


def in_order(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Range-partitioned and sorted, so that a written table's row groups can be skipped by their statistics. With ``rows`` (a bound on
    their number) a task sorts a bounded share."""
    return df.repartitionByRange(*parts_of(df.sparkSession, rows), *keys).sortWithinPartitions(*keys)


def by_chunk(postings_: DataFrame, rows: int) -> DataFrame:
    """Postings dealt out by chunk, before any grouping: they lie by term, so sums taken where they are would hardly add anything up."""
    return postings_.repartition(*parts_of(postings_.sparkSession, rows), "collection_id", "chunk_id")


def posting_bound(stats: DataFrame) -> int:
    """At least the number of postings: the length of all chunks, from partial statistics."""
    return stats.agg(F.sum("total_dl")).first()[0] or 0


def build_index(chunks: DataFrame, stopwords: Sequence[str] | None = None, exact: bool = True) -> LexicalIndex:
    """Analyse every chunk once and keep the result as a written table."""
    forward = materialize(forward_table(chunks, stopwords, exact), "forward")
    stats = materialize(partial_stats(forward), "stats")
    rows = posting_bound(stats)
    stored = materialize(in_order(postings(forward), "collection_id", "term", "chunk_id", rows=rows), "postings")
    blocks = materialize(posting_blocks(stored, rows), "blocks")
    return LexicalIndex(forward, collection_stats(stats), stored, blocks)


def query_terms(queries: DataFrame, stopwords: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """``(query_id, collection_id, term, qtf)`` of queries ``(query_id, collection_id, query)``; blank
    queries and queries left without terms yield no rows."""
    words = default_stopwords() if stopwords is None else stopwords
    tokens = queries.where(strip(F.col("query")) != "").select(
        "query_id",
        "collection_id",
        remove_stopwords(tokenize(normalize_text(F.col("query"), exact)), words).alias("tokens"),
    )
    return (
        tokens.select("query_id", "collection_id", term_counts(F.col("tokens")).alias("terms"))
        .select("query_id", "collection_id", F.inline_outer("terms"))
        .where(F.col("term").isNotNull())
        .withColumnRenamed("tf", "qtf")
    )


def idf(n_chunks: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_chunks - df + F.lit(0.5)) / (df + F.lit(0.5)))


def tf_part(tf: Column, dl: Column, avgdl: Column, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    """Grows with ``tf`` and falls with ``dl``."""
    return tf / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl))


@dataclass(frozen=True)
class QueryWeights:
    """Analysed queries ``table (query_id, collection_id, term, qtf, idf, avgdl, df, bound)``, the ``blocks`` of their terms, the
    index, and whether the queries are few enough to broadcast. ``bound`` is the most a term can add to a score."""

    table: DataFrame
    blocks: DataFrame
    index: LexicalIndex
    small: bool

    @property
    def matches(self) -> int:
        """Matches of the queries' terms and postings."""
        return self.table.agg(F.sum("df")).first()[0] or 0

    @property
    def hits(self) -> DataFrame:
        """All stored postings of the queries' terms."""
        used = self.table.select("collection_id", "term").distinct()
        asked_of = prune(self.index.postings, self.table, "collection_id")
        return salted_join(asked_of, used, ["collection_id", "term"], F.col("chunk_id"), "left_semi", self.small or None)


def query_weights(
    index: LexicalIndex, queries: DataFrame, stopwords: Sequence[str] | None = None, exact: bool = True
) -> QueryWeights:
    """Terms of the queries with their inverse document frequency, from the stored blocks of their postings lists; no
    posting is read. Terms found in no chunk of the collection stay, with the idf of df = 0; they match no posting."""
    terms = materialize(query_terms(queries, stopwords, exact), "terms")
    small = fits(terms)
    used = terms.select("collection_id", "term").distinct()
    asked_of = prune(index.blocks, terms, "collection_id")
    blocks = materialize(salted_join(asked_of, used, ["collection_id", "term"], F.col("block"), "left_semi", small or None), "blocks")
    counted = terms.join(term_df(blocks), ["collection_id", "term"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    weights = counted.join(index.stats, "collection_id").withColumn("idf", idf(F.col("n_chunks"), F.col("df")))
    most = F.coalesce(tf_part(F.col("max_tf"), F.col("min_dl"), F.col("avgdl")), F.lit(0.0))
    weights = weights.select(
        "query_id", "collection_id", "term", "qtf", "idf", "avgdl", "df", (F.col("qtf") * F.col("idf") * most).alias("bound")
    )
    return QueryWeights(materialize(weights, "weights"), blocks, index, small)


def bm25_scores(weights: QueryWeights, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """``(query_id, collection_id, chunk_id, score)`` of every chunk that shares a term with the query.

    A term repeated in the query counts each time. The postings are partitioned by chunk, which spreads them
    evenly whatever the skew of collections and terms and also satisfies the grouping by (query, chunk): the
    fan-out to queries and the sums need no further shuffle. The partitions are as many as the counted matches ask for.
    """
    return (
        salted_join(by_chunk(weights.hits, weights.matches), weights.table, ["collection_id", "term"], F.col("chunk_id"), small_fits=weights.small)
        .groupBy("query_id", "collection_id", "chunk_id")
        .agg(F.sum(F.col("qtf") * F.col("idf") * tf_part(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("score"))
        .withColumn("score", F.round("score", SCORE_DECIMALS))
    )


def _best_of_block(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def best(postings_: pa.Table, asked: pa.Table) -> pa.Table:
        column = lambda table, name: table.column(name).to_numpy()
        by_term = np.argsort(column(postings_, "term_no"), kind="stable")
        terms, starts = np.unique(column(postings_, "term_no")[by_term], return_index=True)
        ends = np.append(starts[1:], len(by_term))
        chunks, slots = np.unique(column(postings_, "chunk_id")[by_term], return_inverse=True)
        parts = column(postings_, "part")[by_term]
        lists = asked.column("asked").combine_chunks()
        wanted, factors = (pc.struct_field(lists.flatten(), name).to_numpy() for name in ("no", "factor"))
        upto = np.cumsum(pc.list_value_length(lists).to_numpy())
        places = np.searchsorted(terms, wanted)
        here = places < len(terms)
        here[here] = terms[places[here]] == wanted[here]
        kept = []
        for query, first, last in zip(column(asked, "query_no"), np.append(0, upto[:-1]), upto):
            rows = [(slice(starts[p], ends[p]), f) for p, f, h in zip(places[first:last], factors[first:last], here[first:last]) if h]
            if not rows:
                continue
            scores = np.bincount(np.concatenate([slots[at] for at, _ in rows]), np.concatenate([factor * parts[at] for at, factor in rows]), len(chunks))
            # Rounding brings no score to the k-th best that is further from it than two last digits.
            least = np.partition(scores, -k)[-k] - 2 * 10.0**-SCORE_DECIMALS if len(scores) > k else 0.0
            found = np.flatnonzero((scores >= least) & (scores != 0.0))
            scores = np.round(scores[found], SCORE_DECIMALS)
            first_k = np.lexsort((found, -scores))[:k]  # chunk numbers ascend with their slots
            kept.append((np.full(len(first_k), query), chunks[found[first_k]], scores[first_k]))
        return pa.table(dict(zip(BLOCK_SCHEMA.names, (np.concatenate(parts) for parts in zip(*kept))))) if kept else BLOCK_SCHEMA.empty_table()

    def run(postings_: pa.Table, asked: pa.Table) -> pa.Table:
        return best(postings_, asked) if postings_.num_rows and asked.num_rows else BLOCK_SCHEMA.empty_table()

    return run


BLOCK_SCHEMA = pa.schema([("query_no", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])


def block_scores(weights: QueryWeights, k: int) -> DataFrame:
    """``(query_id, collection_id, chunk_id, score)`` of at least the best ``k`` chunks of each query: all matches are scored, and each pair of
    a block of chunks and a block of queries hands on its best ``k`` a query.

    The matches are never rows, so neither a shuffle nor a task holds them. Blocks follow the counted postings and terms; chunks and queries are
    dealt over them by hash, whatever the skew of collections and terms. A query meets every block of its collection's chunks, as one row
    of numbers.
    """
    keys = ["collection_id", "term"]
    found = weights.table.where("df > 0")
    counted = found.groupBy(*keys).agg(F.max("df").alias("df"), F.max("avgdl").alias("avgdl"), F.count(F.lit(1)).alias("n_asked"))
    many = lambda column, size: F.ceil(F.sum(column) / F.lit(size)).cast("int")
    blocks = counted.groupBy("collection_id").agg(many("df", BLOCK_POSTINGS).alias("chunk_blocks"), many("n_asked", BLOCK_TERMS).alias("query_blocks"))
    terms = counted.join(never_broadcast(blocks), "collection_id").withColumn("term_no", F.monotonically_increasing_id())
    terms = materialize(terms, "block-terms")
    small = fits(terms)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    of = lambda column, count: F.pmod(F.xxhash64(column), F.col(count)).cast("int")
    # Groups of two collections that share a number are one group: terms' numbers are those of one collection, so nothing else meets.
    numbered = lambda df: df.withColumn("met", F.xxhash64("collection_id", "chunk_block", "query_block"))
    stored = prune(weights.index.postings, weights.table, "collection_id")
    left = salted_join(stored, terms.drop("df", "n_asked"), keys, F.col("chunk_id"), small_fits=small).select(
        "collection_id", "term_no", "chunk_id", tf_part(F.col("tf"), F.col("dl"), F.col("avgdl")).alias("part"),
        of("chunk_id", "chunk_blocks").alias("chunk_block"), every("query_blocks").alias("query_block"),
    )
    left = numbered(left).select("met", "term_no", "chunk_id", "part")
    asked = salted_join(found, terms.drop("df", "avgdl", "n_asked"), keys, F.col("query_id"), small_fits=small)
    asked = asked.groupBy("query_id", "collection_id").agg(
        F.collect_list(F.struct(F.col("term_no").alias("no"), (F.col("qtf") * F.col("idf")).alias("factor"))).alias("asked"),
        F.max("chunk_blocks").alias("chunk_blocks"), F.max("query_blocks").alias("query_blocks"),
    )
    asked = materialize(asked.withColumn("query_no", F.monotonically_increasing_id()), "block-queries")
    right = asked.select("collection_id", "query_no", "asked", of("query_no", "query_blocks").alias("query_block"), every("chunk_blocks").alias("chunk_block"))
    right = numbered(right).select("met", "query_no", "asked")
    rows = terms.agg(F.sum(F.col("df") * F.col("query_blocks")) + F.sum(F.col("n_asked") * F.col("chunk_blocks"))).first()[0] or 0
    parts = parts_of(terms.sparkSession, rows)
    if parts:
        left, right = left.repartition(*parts, "met"), right.repartition(*parts, "met")
    best = left.groupBy("met").cogroup(right.groupBy("met")).applyInArrow(_best_of_block(k), "query_no bigint, chunk_id bigint, score double")
    best = top_k(best, k, F.col("score").desc(), "chunk_id", key="query_no")
    named = asked.select("query_no", "query_id", "collection_id")
    return counted_join(best, named, ["query_no"]).select("query_id", "collection_id", "chunk_id", "score")


def scores_of(weights: QueryWeights, slots: DataFrame) -> DataFrame:
    """``(query_id, collection_id, chunk_id, score)`` of given pairs ``(query_id, collection_id, chunk_id)``, from the forward
    rows of their chunks. Pairs that share no term give no row."""
    keys = ["collection_id", "chunk_id"]
    asked = prune(weights.index.forward, slots, "collection_id")
    terms = counted_join(asked, slots, keys).select("query_id", *keys, "dl", F.inline("terms"))
    table = weights.table.select("query_id", "term", "qtf", "idf", "avgdl")
    return (
        counted_join(terms, table, ["query_id", "term"], small_fits=weights.small)
        .groupBy("query_id", *keys)
        .agg(F.sum(F.col("qtf") * F.col("idf") * tf_part(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score"))
        .withColumn("score", F.round("score", SCORE_DECIMALS))
    )


def partial_scores(weights: QueryWeights, terms: DataFrame, *block: str) -> DataFrame:
    """``(query_id, collection_id, chunk_id, part)``: sums over some of the queries' ``terms``, or blocks of them. A block of a
    postings list holds ``BLOCK_CHUNKS`` postings at most, so its key can't be hot and needs no salt."""
    stored = prune(weights.index.postings, terms, "term")  # postings are sorted by term: row groups without one are skipped
    stored = prune(stored, terms, "collection_id").withColumn("block", block_of(F.col("chunk_id")))
    wanted = terms.select("query_id", "collection_id", "term", "qtf", "idf", "avgdl", *block)
    keys = ["collection_id", "term", *block]
    return (
        (counted_join(stored, wanted, keys) if block else salted_join(stored, wanted, keys, F.col("chunk_id")))
        .groupBy("query_id", "collection_id", "chunk_id")
        .agg(F.sum(F.col("qtf") * F.col("idf") * tf_part(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("part"))
    )


def thresholds(weights: QueryWeights, k: int) -> DataFrame:
    """``(query_id, least)``: a score that ``k`` chunks of the query reach; no row for queries with fewer pilots.

    The postings of a query's rarest terms name its pilots, which are then scored in full.
    """
    rarest = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    rare = weights.table.where("df > 0").withColumn("before", F.coalesce(F.sum("df").over(rarest), F.lit(0)))
    found = partial_scores(weights, materialize(rare.where(F.col("before") < PILOT_POSTINGS * k), "rare"))
    pilots = top_k(found, PILOTS * k, F.col("part").desc(), "chunk_id").select("query_id", "collection_id", "chunk_id")
    best = top_k(scores_of(weights, materialize(pilots, "pilots")), k, F.col("score").desc(), "chunk_id")
    return best.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))


def candidates(weights: QueryWeights, k: int) -> DataFrame:
    """``(query_id, collection_id, chunk_id)``: every chunk that can be among the best ``k`` of its query. Written.

    The terms of a query that can't reach its threshold together (those with the smallest bounds) are never looked up:
    a chunk without another term stays below. Of the other terms those blocks are read where a chunk could
    still pass, and of the chunks found there those stay whose part of the score leaves it possible.
    """
    least = F.coalesce(F.col("least"), F.lit(0.0)) - F.lit(SLACK)
    smallest = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    ranked = weights.table.where("df > 0").join(thresholds(weights, k), "query_id", "left").select(
        "*", F.sum("bound").over(smallest).alias("upto"), F.sum("bound").over(Window.partitionBy("query_id")).alias("most")
    )
    ranked = materialize(ranked, "bounds")
    rest = ranked.groupBy("query_id").agg(
        F.max("least").alias("least"), F.coalesce(F.max(F.when(F.col("upto") < least, F.col("upto"))), F.lit(0.0)).alias("rest")
    )
    looked_up = ranked.where(F.col("upto") >= least)
    inside = F.col("qtf") * F.col("idf") * tf_part(F.col("max_tf"), F.col("min_dl"), F.col("avgdl"))
    live = salted_join(weights.blocks, looked_up, ["collection_id", "term"], F.col("block"), small_fits=weights.small)
    live = materialize(live.where(F.col("most") - F.col("bound") + inside >= least), "live-blocks")
    found = partial_scores(weights, live, "block").join(rest, "query_id")
    return materialize(
        found.where(F.col("part") + F.col("rest") >= least).select("query_id", "collection_id", "chunk_id"), "candidates"
    )


def top_k(scored: DataFrame, k: int, score: Column, *tie_breaks: str, key: str = "query_id", rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key in a total order; Spark cuts each partition to ``k`` before the shuffle."""
    order = Window.partitionBy(key).orderBy(score, *tie_breaks)
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def keyword_topk(
    weights: QueryWeights, k: int = CANDIDATES, full_up_to: int = FULL_SCORING, rows_up_to: int = ROW_SCORING
) -> DataFrame:
    """``(query_id, collection_id, chunk_id, score, rank)``, the best ``k`` chunks of each query by full score; none for
    ``k`` below 1. With more than ``rows_up_to`` matches of terms and postings they are added up block by block, and with more than
    ``full_up_to`` only chunks that can be among the best are scored; the result is the same."""
    matches = weights.matches
    if k < 1 or matches <= min(rows_up_to, full_up_to):
        scored = bm25_scores(weights)
    else:
        scored = block_scores(weights, k) if matches <= full_up_to else scores_of(weights, candidates(weights, k))
    return top_k(scored, k, F.col("score").desc(), "chunk_id")
