"""Candidate fusion, reranking, sources and context."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from evispan.constants import RERANK_FAILED, RERANK_INVALID, RERANK_NO_DOCUMENTS, RERANK_TOP_N
from evispan.functions.labels import document_location, source_struct
from evispan.functions.text import bind, excerpt
from evispan.operators.lexical import QueryWeights, top_k
from evispan.plugins import Factory
from evispan.schema import METADATA_COLUMNS
from evispan.session import counted_join, fits, materialize, prune


def hybrid_candidates(vector_picks: DataFrame, keyword_hits: DataFrame, chunks: DataFrame, excerpts: bool = False) -> DataFrame:
    """Ordered union of the two paths with chunk text and metadata; of equal (text, metadata) the first
    stays, vector path before keyword path. Adds ``ord``, the 0-based position handed to the reranker.

    Only candidates (at most 20 per query) meet the chunk table: broadcast when counted few; otherwise both sides are shuffled, and a
    chunk that many queries found is split by the adaptive skew join. The texts are never broadcast. With ``excerpts`` a row has the column
    ``excerpt`` in place of ``text``, and texts are compared by digest: a chunk's text is as long as it is, and each of its queries' rows
    would carry it through every shuffle and table that follows.
    """
    paths = vector_picks.select(
        "query_id", "collection_id", "chunk_id", F.lit(0).alias("origin"), F.col("mmr_rank").alias("origin_rank")
    ).unionByName(
        keyword_hits.select(
            "query_id", "collection_id", "chunk_id", F.lit(1).alias("origin"), F.col("rank").alias("origin_rank")
        )
    )
    texts = prune(chunks, paths, "collection_id").select("collection_id", "chunk_id", "text", *METADATA_COLUMNS)
    keys = ["collection_id", "chunk_id"]
    few = fits(paths)

    def shortened(df: DataFrame) -> DataFrame:
        cut = {"excerpt": excerpt(F.col("text")), "digest": F.unhex(F.sha2("text", 256))}
        return df.withColumns(cut).drop("text") if excerpts else df

    # The fewer rows are cut: the candidates' when they are few, the chunks' before these are shuffled.
    located = shortened(counted_join(texts, paths, keys, small_fits=True)) if few else counted_join(shortened(texts), paths, keys, small_fits=False)
    same = Window.partitionBy("query_id", "digest" if excerpts else "text", *METADATA_COLUMNS).orderBy("origin", "origin_rank")
    order = Window.partitionBy("query_id").orderBy("origin", "origin_rank")
    return (
        located.repartition("query_id")  # serves both windows
        .withColumn("copy", F.row_number().over(same))
        .where(F.col("copy") == 1)
        .drop("copy", "digest")
        .withColumn("ord", F.row_number().over(order) - 1)
    )


RESULTS = "query_id string, result_ord int, index int, relevance_score double, status_code int, detail string"


def rerank_overlap(candidates: DataFrame, weights: QueryWeights, top_n: int = RERANK_TOP_N) -> DataFrame:
    """Default scorer, native: share of the query's terms, weighted by rarity, found in the candidate. Works
    on the stored terms of the candidates' chunks; no text is analysed."""
    slots = candidates.select("query_id", "ord", "collection_id", "chunk_id")
    stored = prune(weights.index.forward, slots, "collection_id").select("collection_id", "chunk_id", F.col("terms.term").alias("held"))
    # A query's terms travel to its candidates as one value, so neither side is taken apart into a row per term.
    wanted = weights.table.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("wanted"), F.sum("idf").alias("total"))
    asked = counted_join(slots, wanted, ["query_id"], "left", weights.small)
    shared = bind(
        F.array_intersect("wanted.term", "held"),
        lambda both: F.aggregate(F.filter("wanted", lambda w: F.array_contains(both, w["term"])), F.lit(0.0), lambda sum_, w: sum_ + w["idf"]),
    )
    found = (
        counted_join(stored, asked.select("query_id", "ord", "collection_id", "chunk_id", "wanted"), ["collection_id", "chunk_id"])
        .select("query_id", "ord", shared.alias("found"))
        .groupBy("query_id", "ord")
        .agg(F.sum("found").alias("found"))
    )
    scored = asked.drop("wanted").join(found, ["query_id", "ord"], "left")
    score = F.round(F.coalesce("found", F.lit(0.0)) / F.col("total"), 6)
    ranked = top_k(
        scored.select("query_id", "ord", F.coalesce(score, F.lit(0.0)).alias("relevance_score")),
        top_n, F.col("relevance_score").desc(), "ord", rank="result_ord",
    )
    return ranked.select(
        "query_id", "result_ord", F.col("ord").alias("index"), "relevance_score",
        F.lit(None).cast("int").alias("status_code"), F.lit(None).cast("string").alias("detail"),
    )


RAW_RESULTS = "query_id string, results array<struct<index: string, relevance_score: double>>, status_code int, detail string"


def rerank_with(candidates: DataFrame, queries: DataFrame, factory: Factory, top_n: int = RERANK_TOP_N) -> DataFrame:
    """Scores from a plug-in that is set up once per task and called once per query with its candidates (20 at
    most). A failed call or an answer that is not a list becomes one row with a status code."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = factory()
        for frame in frames:
            rows = []
            for query_id, query, texts in zip(frame["query_id"], frame["query"], frame["texts"]):
                try:
                    got, reason = score(query, list(texts), min(top_n, len(texts))), None
                except Exception:
                    got, reason = None, RERANK_FAILED
                if reason is None and not isinstance(got, list):
                    reason = RERANK_INVALID
                entries = [] if reason else [entry if isinstance(entry, dict) else {} for entry in got]
                plain = [{"index": (repr if isinstance(e.get("index"), str) else str)(e.get("index")), "relevance_score": e.get("relevance_score")} for e in entries]
                rows.append((query_id, plain, *(reason or (None, None))))
            yield pd.DataFrame(rows, columns=["query_id", "results", "status_code", "detail"]).astype({"status_code": "Int32"})

    gathered = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text")))["text"].alias("texts"))
    asked = gathered.join(queries.select("query_id", "query"), "query_id")
    raw = materialize(asked.select("query_id", "query", "texts").mapInPandas(run, RAW_RESULTS), "results")
    named = raw.where("size(results) > 0").select("query_id", F.posexplode("results").alias("at", "entry"))
    index = F.when(F.col("entry.index").rlike("^-?[0-9]{1,18}$"), F.col("entry.index").cast("bigint"))
    none = lambda kind: F.lit(None).cast(kind)
    good = named.select(
        "query_id",
        (F.col("at") + 1).alias("result_ord"),
        F.when(index.between(-(2**31), 2**31 - 1), index).cast("int").alias("index"),
        F.col("entry.relevance_score").alias("relevance_score"),
        none("int").alias("status_code"),
        none("string").alias("detail"),
    )
    failed = raw.where("size(results) = 0").select(
        "query_id",
        F.lit(1).alias("result_ord"),
        none("int").alias("index"),
        none("double").alias("relevance_score"),
        F.coalesce("status_code", F.lit(RERANK_NO_DOCUMENTS[0])).alias("status_code"),
        F.coalesce("detail", F.lit(RERANK_NO_DOCUMENTS[1])).alias("detail"),
    )
    return good.unionByName(failed)


def rerank_validate(candidates: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(reranked, failures)``: results whose index names a candidate, in the scorer's order; queries left
    with none fail. An index named twice stays twice."""
    kept = counted_join(
        candidates,
        results.select("query_id", "result_ord", F.col("index").alias("ord"), F.col("relevance_score").alias("rerank_score")),
        ["query_id", "ord"],
    )
    order = Window.partitionBy("query_id").orderBy("result_ord")
    reranked = kept.withColumn("rank", F.row_number().over(order))
    failures = (
        candidates.select("query_id")
        .distinct()
        .join(kept.select("query_id").distinct(), "query_id", "left_anti")
        .join(
            results.where(F.col("status_code").isNotNull()).select("query_id", "status_code", "detail"),
            "query_id",
            "left",
        )
        .select(
            "query_id",
            F.coalesce("status_code", F.lit(RERANK_NO_DOCUMENTS[0])).alias("status_code"),
            F.coalesce("detail", F.lit(RERANK_NO_DOCUMENTS[1])).alias("detail"),
        )
    )
    return reranked, failures


def sources(reranked: DataFrame) -> DataFrame:
    """One source record per reranked chunk."""
    return reranked.select(
        "query_id",
        "rank",
        "chunk_id",
        source_struct(F.col("page"), F.col("row_start"), F.col("row_end"), F.col("text")).alias("source"),
        "rerank_score",
    )


def answer_context(reranked: DataFrame) -> DataFrame:
    """``(query_id, context)``: located chunk texts in rank order, a blank line between them. At most
    ``RERANK_TOP_N`` texts per query are gathered."""
    block = F.concat(
        F.lit("["), document_location(F.col("page"), F.col("row_start"), F.col("row_end")), F.lit("]\n"), F.col("text")
    )
    gathered = reranked.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks")
    )
    return gathered.select("query_id", F.array_join(F.col("blocks.block"), "\n\n").alias("context"))
