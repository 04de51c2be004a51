"""The whole quick answer for a table of questions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from evispan.constants import CANDIDATES, FETCH_K, NO_EVIDENCE_ANSWER, SEARCH_FAILED_ANSWER
from evispan.functions.labels import document_location, excerpt_struct
from evispan.functions.text import excerpt
from evispan.operators import hybrid, vector
from evispan.operators.lexical import LexicalIndex, QueryWeights, build_index, keyword_topk, query_weights
from evispan.plugins import Factory, run_texts
from evispan.schema import SOURCE_STRUCT
from evispan.session import materialize


@dataclass(frozen=True)
class Corpus:
    """Chunks with their lexical index and, unless retrieval is by keywords only, their vectors."""

    chunks: DataFrame
    index: LexicalIndex
    vectors: DataFrame | None = None


@dataclass(frozen=True)
class Models:
    """Plug-ins; ``None`` takes the deterministic default."""

    embed: Factory | None = None
    score: Factory | None = None
    generate: Factory | None = None
    stopwords: Sequence[str] | None = None
    exact: bool = True
    prompt: str = field(default="evidence:\n{context}\nquestion:\n{question}")


def build_corpus(chunks: DataFrame, models: Models = Models(), with_vectors: bool = True) -> Corpus:
    """Index a chunk table: terms and vectors, each computed once and written."""
    index = build_index(chunks, models.stopwords, models.exact)
    if not with_vectors:
        return Corpus(chunks, index)
    embedded = vector.embed(chunks.select("collection_id", "chunk_id", "text"), factory=models.embed)
    return Corpus(chunks, index, materialize(embedded, "vectors"))


def embed_queries(corpus: Corpus, queries: DataFrame, models: Models = Models()) -> DataFrame | None:
    """Queries with ``query_vector``, or with the status of the failure; written once."""
    if corpus.vectors is None:
        return None
    return materialize(vector.embed(queries, "query", models.embed).withColumnRenamed("embedding", "query_vector"), "asked")


def retrieve(
    corpus: Corpus, queries: DataFrame, weights: QueryWeights, models: Models = Models(), asked: DataFrame | None = None, excerpts: bool = False
) -> DataFrame:
    """Merged candidates of ``(query_id, collection_id, query)``; ``asked`` saves embedding the queries again. With ``excerpts`` they have
    no texts (see ``hybrid_candidates``)."""
    hits = materialize(keyword_topk(weights, CANDIDATES), "hits")
    if corpus.vectors is None:
        picks = queries.select(
            "query_id", "collection_id", F.lit(0).cast("bigint").alias("chunk_id"), F.lit(0).alias("mmr_rank")
        ).where(F.lit(False))
    else:
        asked = embed_queries(corpus, queries, models) if asked is None else asked
        picks = materialize(
            vector.mmr_select(vector.vector_topk(corpus.vectors, asked, FETCH_K), asked, CANDIDATES), "picks"
        )
    return hybrid.hybrid_candidates(picks, hits, corpus.chunks, excerpts)


def rerank(candidates: DataFrame, queries: DataFrame, weights: QueryWeights, models: Models = Models()) -> DataFrame:
    """Results of the scorer, called once and written."""
    if models.score is None:
        results = hybrid.rerank_overlap(candidates, weights)
    else:
        results = hybrid.rerank_with(candidates, queries, models.score)
    return materialize(results, "scores")


def answer(corpus: Corpus, queries: DataFrame, models: Models = Models()) -> DataFrame:
    """``(query_id, collection_id, query, answer, sources, error)``, one row per query.

    Queries whose embedding, reranking or generation failed carry an error; queries without candidates are
    answered from an empty context.
    """
    weights = query_weights(corpus.index, queries, models.stopwords, models.exact)
    asked = embed_queries(corpus, queries, models)
    whole = bool(models.score or models.generate)  # only a plug-in reads more of a text than its excerpt
    candidates = materialize(retrieve(corpus, queries, weights, models, asked, not whole), "candidates")
    results = rerank(candidates, queries, weights, models)
    reranked, failures = hybrid.rerank_validate(candidates, results)
    gathered = reranked.groupBy("query_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "rank",
                    excerpt_struct(F.col("page"), F.col("row_start"), F.col("row_end"), excerpt(F.col("text")) if whole else F.col("excerpt")).alias("source"),
                    document_location(F.col("page"), F.col("row_start"), F.col("row_end")).alias("location"),
                    *([F.col("text")] if models.generate else []),
                )
            )
        ).alias("found")
    )
    none = F.array().cast(f"array<{SOURCE_STRUCT}>")
    if asked is not None:  # a query that could not be embedded fails, whatever its words found
        unasked = asked.where(F.col("embed_status").isNotNull()).select(
            "query_id", F.col("embed_status").alias("status_code"), F.col("embed_error").alias("detail")
        )
        failures = failures.join(unasked.select("query_id"), "query_id", "left_anti").unionByName(unasked)
    base = (
        queries.join(gathered, "query_id", "left")
        .join(failures, "query_id", "left")
        .withColumn("sources", F.coalesce(F.col("found.source"), none))
    )
    if models.generate is None:
        best = F.get("found", F.lit(0))
        text = F.when(
            best.isNotNull(), F.concat(F.lit("["), best["location"], F.lit("] "), best["source"]["excerpt"])
        ).otherwise(F.lit(NO_EVIDENCE_ANSWER))
        answered = base.withColumn("answer", text).withColumn("error", F.col("detail"))
    else:
        block = F.transform("found", lambda s: F.concat(F.lit("["), s["location"], F.lit("]\n"), s["text"]))
        before, after = models.prompt.split("{context}")
        middle, end = after.split("{question}")
        prompt = F.concat(
            F.lit(before), F.coalesce(F.array_join(block, "\n\n"), F.lit("")), F.lit(middle), F.col("query"), F.lit(end)
        )
        working = base.where(F.col("detail").isNull()).withColumn("prompt", prompt)
        generated = materialize(
            run_texts(working.select("query_id", "prompt"), "prompt", "answer", "string", models.generate), "answers"
        )
        answered = base.join(generated, "query_id", "left").withColumn(
            "error", F.coalesce("detail", "answer_error")
        )
    failed = F.col("error").isNotNull()
    return answered.select(
        "query_id",
        "collection_id",
        "query",
        F.when(failed, F.lit(SEARCH_FAILED_ANSWER)).otherwise(F.col("answer")).alias("answer"),
        F.when(failed, none).otherwise(F.col("sources")).alias("sources"),
        "error",
    )
