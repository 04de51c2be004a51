import dataclasses
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispan import session
from evispan.operators import cells, hybrid, lexical, vector
from evispan.plans import quick_answer as qa
from evispan.plugins import hashed_terms_embedder, run_texts

TEXTS = {
    "a": ["red fox red", "blue fox", "green tree", "", "--"],
    "b": ["red tree tree", "tree"],
}
ASKED = [("q1", "a", "red fox fox"), ("q2", "a", "unknown"), ("q3", "b", "tree red"), ("q4", "a", "  "), ("q5", "z", "red")]


def chunks(spark):
    rows = [(col, i, t) for col, texts in TEXTS.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "collection_id string, chunk_id bigint, text string").selectExpr(
        "*", "'s' source", "'pdf' file_type", "'docling_hybrid' chunking", "cast(chunk_id as int) page", "array(1) pages",
        "cast(null as bigint) row_start", "cast(null as bigint) row_end",
    )


def queries(spark):
    return spark.createDataFrame(ASKED, "query_id string, collection_id string, query string")


def plain_bm25(query, texts, k1=1.5, b=0.75):
    docs = {i: re.findall(r"[^\W_]+", t) for i, t in enumerate(texts) if t}
    avgdl = sum(map(len, docs.values())) / len(docs)
    scores = {}
    for term in re.findall(r"[^\W_]+", query):
        df = sum(term in d for d in docs.values())
        idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        for i, d in docs.items():
            tf = d.count(term)
            if tf:
                scores[i] = scores.get(i, 0) + idf * tf / (tf + k1 * (1 - b + b * len(d) / avgdl))
    return scores


def test_bm25_equals_plain_arithmetic(spark):
    index = lexical.build_index(chunks(spark))
    weights = lexical.query_weights(index, queries(spark))
    got = {(r.query_id, r.chunk_id): r.score for r in lexical.bm25_scores(weights).collect()}
    want = {(q, i): round(s, 6) for q, col, text in ASKED if col in TEXTS for i, s in plain_bm25(text, TEXTS[col]).items()}
    assert got.keys() == want.keys()
    assert all(abs(got[key] - want[key]) < 2e-6 for key in want)


def test_bm25_without_broadcast_gives_the_same(spark):
    index = lexical.build_index(chunks(spark))
    weights = lexical.query_weights(index, queries(spark))
    big = dataclasses.replace(weights, small=False)
    assert sorted(lexical.bm25_scores(big).collect()) == sorted(lexical.bm25_scores(weights).collect())


def test_many_rows_in_small_files_are_not_broadcast(spark):
    index = lexical.build_index(chunks(spark))
    weights = lexical.query_weights(index, queries(spark))
    pairs = F.lit("q1").alias("query_id"), F.lit("a").alias("collection_id"), F.col("id").alias("chunk_id")
    slots = session.materialize(spark.range(session.BROADCAST_ROWS + 1).select(*pairs), "slots")
    scored = lexical.scores_of(weights, slots)
    assert {r.chunk_id for r in scored.collect()} == {0, 1}
    joins = dataclasses.replace(weights, small=False)
    assert "BroadcastExchange" not in lexical.scores_of(joins, slots)._jdf.queryExecution().executedPlan().toString()
    salted = session.salted_join(index.postings, slots.withColumn("term", F.lit("red")), ["collection_id", "term"], F.col("chunk_id"), small_fits=False)
    assert "Broadcast" not in salted._jdf.queryExecution().executedPlan().toString()


def test_many_results_in_small_files_are_not_broadcast(spark):
    rows = spark.range(session.BROADCAST_ROWS + 1).select(F.lit("q1").alias("query_id"), F.col("id").cast("int").alias("ord"))
    columns = F.col("ord").alias("result_ord"), F.col("ord").alias("index"), (F.col("ord") * 0.5).alias("relevance_score")
    none = F.lit(None).cast("int").alias("status_code"), F.lit(None).cast("string").alias("detail")
    candidates = session.materialize(rows, "candidates")
    results = session.materialize(rows.select("query_id", *columns, *none), "scores")
    kept, _ = hybrid.rerank_validate(candidates, results)
    assert "BroadcastExchange" not in kept._jdf.queryExecution().executedPlan().toString()
    few = results.where("index IN (7, 3)")
    kept, failed = hybrid.rerank_validate(candidates, few)
    assert [(r.ord, r["rank"], r.rerank_score) for r in kept.orderBy("rank").collect()] == [(3, 1, 1.5), (7, 2, 3.5)]
    assert failed.count() == 0


def test_rows_of_long_ids_are_not_broadcast_however_few(spark):
    rows = spark.range(session.BROADCAST_ROWS // 2).select("id", F.sha2(F.col("id").cast("string"), 256).alias("query_id"), F.lit("red").alias("term"))
    rows = session.materialize(rows, "terms")
    assert session.fits(rows.select("id")) and not session.fits(rows) and session.fits(rows, session.BROADCAST_ROWS)
    assert session.fits(rows.limit(0)) and session.fits(rows.select(F.lit(None).cast("string").alias("query_id")))
    assert not session.fits(rows.select(F.array("query_id", "query_id").alias("ids")))
    few = rows.where("id < 3").select("query_id")
    joined = session.counted_join(few, rows, ["query_id"])
    assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in joined.collect()) == [0, 1, 2]


def test_vectors_of_queries_are_not_broadcast_by_the_size_of_files(spark):
    queries_ = session.materialize(spark.range(3_000).select(F.col("id").cast("string").alias("query_id"), F.array_repeat(F.lit(0.5).cast("float"), 64).alias("query_vector")), "asked")
    near = queries_.where("query_id IN ('7', '8')").select("query_id", F.lit("a").alias("collection_id"), F.lit(5).cast("bigint").alias("chunk_id"), F.col("query_vector").alias("embedding"))
    picked = vector.mmr_select(near, queries_)
    assert "BroadcastExchange" not in picked._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query_id, r.chunk_id, r.mmr_rank) for r in picked.collect()) == [("7", 5, 1), ("8", 5, 1)]


def test_index_of_many_rows_is_cut_by_their_number(spark, monkeypatch):
    index = lexical.build_index(chunks(spark))
    monkeypatch.setattr(session, "TASK_ROWS", 1)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 2)
    placed = lexical.in_order(lexical.postings(index.forward), "collection_id", "term", "chunk_id", rows=8)
    blocks = lexical.posting_blocks(index.postings, 8)
    weights = lexical.query_weights(index, queries(spark))
    assert placed.rdd.getNumPartitions() >= 6 and sorted(placed.collect()) == sorted(index.postings.collect())
    assert blocks.rdd.getNumPartitions() >= 6 and sorted(blocks.collect()) == sorted(index.blocks.collect())
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange rangepartitioning" in plan and "Exchange hashpartitioning" not in plan
    assert sorted(lexical.bm25_scores(weights).collect()) == sorted(lexical.bm25_scores(dataclasses.replace(weights, small=False)).collect())


def test_topk_limits_and_plan(spark):
    index = lexical.build_index(chunks(spark))
    weights = lexical.query_weights(index, queries(spark))
    top = lexical.keyword_topk(weights, 1)
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in top.collect()) == [("q1", 0, 1), ("q3", 0, 1)]
    assert lexical.keyword_topk(weights, 0).count() == 0
    plan = top._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scoring_shuffles_postings_once(spark):
    index = lexical.build_index(chunks(spark))
    scored = lexical.bm25_scores(lexical.query_weights(index, queries(spark)))
    executed = scored._jdf.queryExecution().executedPlan().toString()
    above_join = executed.split("BroadcastHashJoin")[0]
    assert "HashAggregate" in above_join and "Exchange" not in above_join


@pytest.mark.parametrize("seed,small", [(1, True), (2, False)])
def test_scores_by_blocks_equal_scores_by_rows(spark, monkeypatch, seed, small):
    """Skewed terms, copies of one text, repeated and unknown terms, empty questions, a collection of one chunk; many small blocks."""
    rng = random.Random(seed)
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 150)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 20)
    word = lambda: f"w{int(rng.paretovariate(0.7))}"
    rows = [(col, i * 7 % n, " ".join(word() for _ in range(rng.randrange(0, 40)))) for col, n in (("a", 200), ("b", 30), ("c", 1)) for i in range(n)]
    rows += [("a", 1000 + i, "w1 w2 w3 w1") for i in range(50)]
    stored = spark.createDataFrame(rows, "collection_id string, chunk_id bigint, text string")
    asked = [(f"q{i}", rng.choice("aab c").strip() or "z", " ".join(word() for _ in range(rng.randrange(0, 12)))) for i in range(40)]
    asked += [("same", "a", "w3 w1 w1"), ("none", "a", "unheard"), ("blank", "b", " ")]
    index = lexical.build_index(stored)
    weights = lexical.query_weights(index, spark.createDataFrame(asked, "query_id string, collection_id string, query string"))
    weights = dataclasses.replace(weights, small=small)
    if not small:
        monkeypatch.setattr(lexical, "fits", lambda df: False)
        monkeypatch.setattr(session, "TASK_ROWS", 100)
    for k in (1, 7):
        want = lexical.top_k(lexical.bm25_scores(weights), k, F.col("score").desc(), "chunk_id").collect()
        got = lexical.keyword_topk(weights, k, rows_up_to=0)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and plan.count("HashAggregate") == 0  # the matches are never rows
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 10 * k


@pytest.mark.parametrize("seed", [1, 2])
def test_pruned_topk_equals_full_scoring(spark, monkeypatch, seed):
    """Skewed term frequencies, repeated and unknown terms, ties, collections of one chunk; small blocks."""
    rng = random.Random(seed)
    monkeypatch.setattr(lexical, "BLOCK_CHUNKS", 8)
    word = lambda: f"w{int(rng.paretovariate(0.7))}"
    rows = [(col, i, " ".join(word() for _ in range(rng.randrange(1, 40)))) for col, n in (("a", 400), ("b", 60), ("c", 1)) for i in range(n)]
    stored = spark.createDataFrame(rows, "collection_id string, chunk_id bigint, text string")
    asked = [(f"q{i}", rng.choice("aab c").strip() or "z", " ".join(word() for _ in range(rng.randrange(0, 12)))) for i in range(40)]
    index = lexical.build_index(stored)
    for k in (1, 20):
        weights = lexical.query_weights(index, spark.createDataFrame(asked, "query_id string, collection_id string, query string"))
        full = lexical.bm25_scores(weights)
        want = lexical.top_k(full, k, F.col("score").desc(), "chunk_id").collect()
        got = lexical.keyword_topk(weights, k, full_up_to=0).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, lexical.keyword_topk(weights, k).collect()))
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
        if k == 1:
            assert lexical.candidates(weights, k).count() < full.count() / 2


def test_postings_are_stored_in_order_and_read_by_term(spark):
    index = lexical.build_index(chunks(spark))
    stored = [(r.collection_id, r.term, r.chunk_id, r.tf, r.dl) for r in index.postings.collect()]
    assert sorted(stored) == sorted(map(tuple, lexical.postings(index.forward).collect()))
    weights = lexical.query_weights(index, queries(spark))
    part = lexical.partial_scores(weights, weights.table.where("query_id = 'q3'"))
    plan = part._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "tf#" in line)
    assert "PushedFilters" in scan and "In(term, [red,tree])" in scan and "EqualTo(collection_id,b)" in scan.replace("In(collection_id, [b])", "EqualTo(collection_id,b)")


def random_vectors(spark, n, name, seed, collections=("x", "y")):
    rng = np.random.default_rng(seed)
    data = rng.integers(-3, 4, size=(n, 8)).astype(np.float32)
    rows = [(f"{name}{i}" if name == "query" else i, collections[i % len(collections)], data[i].tolist()) for i in range(n)]
    if name == "query":
        return spark.createDataFrame(rows, "query_id string, collection_id string, query_vector array<float>"), rows
    return spark.createDataFrame(rows, "chunk_id bigint, collection_id string, embedding array<float>"), rows


def plain_nearest(vectors, asked, k):
    out = set()
    for query, collection, q in asked:
        near = sorted((round(float(((np.array(v) - np.array(q)) ** 2).sum()), 6), i) for i, col, v in vectors if col == collection)
        out |= {(query, i, rank) for rank, (_, i) in enumerate(near[:k], start=1)}
    return out


@pytest.mark.parametrize("broadcast_queries", [1000, 0])
def test_vector_topk_is_exact(spark, monkeypatch, broadcast_queries):
    monkeypatch.setattr(vector, "VECTOR_BLOCK", 50)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vector, "DISTANCE_CELLS", 300)
    stored, plain = random_vectors(spark, 300, "chunk", 1)
    asked, wanted = random_vectors(spark, 20, "query", 2)
    got = vector.vector_topk(stored.repartition(5), asked, 7, broadcast_queries)
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got.collect()} == plain_nearest(plain, wanted, 7)


def plain_mmr(query, entries, k, mult):
    entries = sorted(entries)
    cos = lambda a, b: round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 6) if np.any(a) and np.any(b) else 0.0
    vectors = [np.array(v, dtype=float) for _, v in entries]
    taken = []
    while len(taken) < min(k, len(entries)):
        best = max(
            (i for i in range(len(entries)) if i not in taken),
            key=lambda i: (mult * cos(query, vectors[i]) - (1 - mult) * max((cos(vectors[i], vectors[j]) for j in taken), default=0.0), -i),
        )
        taken.append(best)
    return [entries[i][0] for i in taken]


@pytest.mark.parametrize("mult", [0.9, 1.0, 0.3])
def test_mmr_equals_plain_loop(spark, mult):
    stored, plain = random_vectors(spark, 60, "chunk", 3, ("x",))
    asked, wanted = random_vectors(spark, 5, "query", 4, ("x",))
    near = vector.vector_topk(stored, asked, 12)
    members = {}
    for r in near.collect():
        members.setdefault(r.query_id, []).append((r.chunk_id, r.embedding))
    picks = vector.mmr_select(near, asked, 5, mult).orderBy("query_id", "mmr_rank").collect()
    for query, _, q in wanted:
        assert [r.chunk_id for r in picks if r.query_id == query] == plain_mmr(np.array(q, dtype=float), members[query], 5, mult)


def embed_with(spark, factory, n=20, **options):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(n)], "i int, text string").coalesce(1)
    return vector.embed(df, factory=factory, **options).orderBy("i").collect()


def test_embed_default_and_batches(spark):
    call = hashed_terms_embedder()()
    plain = call(["Ação ação x", ""])
    assert abs(np.linalg.norm(plain[0]) - 1) < 1e-6 and not plain[1].any()
    sizes = lambda: lambda texts: [(i, [float(len(texts)), float(texts[i][1:])]) for i in reversed(range(len(texts)))]
    got = embed_with(spark, sizes)
    assert [r.embedding[1] for r in got] == [float(i) for i in range(20)]
    assert max(r.embedding[0] for r in got) <= 16
    with pytest.raises(ValueError):
        embed_with(spark, sizes, batch_size=0)


@pytest.mark.parametrize("kind, status", [("timeout", 504), ("408", 504), ("500", 502), ("connection", 502), ("short", 502)])
def test_embed_failures(spark, kind, status):
    def factory():
        def call(texts):
            if "t3" not in texts:
                return [[1.0]] * len(texts)
            if kind == "short":
                return [[1.0]]
            problem = {"timeout": TimeoutError(), "connection": ConnectionError()}.get(kind) or RuntimeError(kind)
            if kind.isdigit():
                problem.status_code = int(kind)
            raise problem

        return call

    got = embed_with(spark, factory, n=8, batch_size=2)
    assert [r.embed_status for r in got] == [None, None, status, status, None, None, None, None]
    assert got[2].embedding is None and got[2].embed_error


def test_embed_retries(spark):
    def factory():
        calls = []

        def call(texts):
            calls.append(1)
            if len(calls) % 3:
                raise RuntimeError
            return [[1.0]] * len(texts)

        return call

    assert all(r.embedding for r in embed_with(spark, factory, n=6, batch_size=2))


def test_merge_keeps_the_first_and_other_metadata(spark):
    store = chunks(spark).where("collection_id = 'a'").limit(0)
    texts = [(1, "same", 0), (2, "same", 0), (3, "same", 1), (4, "other", 0)]
    store = spark.createDataFrame([("a", i, t, "s", "pdf", "c", p, [1], None, None) for i, t, p in texts], store.schema)
    picks = spark.createDataFrame([("q", "a", 2, 1), ("q", "a", 3, 2)], "query_id string, collection_id string, chunk_id bigint, mmr_rank int")
    hits = spark.createDataFrame([("q", "a", 1, 1), ("q", "a", 4, 2), ("q", "a", 3, 3)], "query_id string, collection_id string, chunk_id bigint, rank int")
    got = hybrid.hybrid_candidates(picks, hits, store).orderBy("ord").collect()
    assert [(r.ord, r.chunk_id, r.origin) for r in got] == [(0, 2, 0), (1, 3, 0), (2, 4, 1)]


def candidates(spark):
    return spark.createDataFrame(
        [("q1", i, f"text {i}", "t") for i in range(3)] + [("q2", 0, "x", "t"), ("q3", 0, "y", "t")],
        "query_id string, ord int, text string, query string",
    )


def test_rerank_protocol(spark):
    def factory():
        def score(query, texts, top_n):
            if texts == ["x"]:
                raise ConnectionError
            if texts == ["y"]:
                return [{"index": 7}, {"index": "0"}, "junk"]
            assert top_n == 3
            return [{"index": 2, "relevance_score": 0.5}, {"index": -1}, {"index": 0, "relevance_score": 0.9}, {"index": None}, {"index": 2}]

        return score

    frame = candidates(spark)
    asked = frame.select("query_id", F.col("query")).distinct()
    results = hybrid.rerank_with(frame.drop("query"), asked, factory)
    kept, failed = hybrid.rerank_validate(frame, results)
    assert [(r.ord, r.rerank_score) for r in kept.orderBy("rank").collect()] == [(2, 0.5), (0, 0.9), (2, None)]
    assert sorted((r.query_id, r.status_code) for r in failed.collect()) == [("q2", 502), ("q3", 502)]


def test_one_bad_text_fails_alone(spark):
    def factory():
        def call(texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return [t.upper() for t in texts]

        return call

    texts = spark.createDataFrame([(i, "bad" if i == 5 else f"t{i}") for i in range(16)], "i int, t string").coalesce(1)
    got = {r.i: (r.o, r.o_error) for r in run_texts(texts, "t", "o", "string", factory).collect()}
    assert got[5] == (None, "RuntimeError: no") and all(got[i] == (f"T{i}", None) for i in got if i != 5)


def test_failed_query_embedding_is_an_error(spark):
    corpus = qa.build_corpus(chunks(spark))

    def embed():
        def call(texts):
            raise TimeoutError

        return call

    got = qa.answer(corpus, queries(spark), qa.Models(embed=embed)).collect()
    assert len(got) == len(ASKED) and all(r.error and r.sources == [] for r in got)


def test_answers_with_plugins(spark):
    def generate():
        def call(prompts):
            if any("unknown" in prompt for prompt in prompts):
                raise RuntimeError
            return [prompt.upper() for prompt in prompts]

        return call

    corpus = qa.build_corpus(chunks(spark), with_vectors=False)
    asked = queries(spark).where("query_id in ('q1', 'q2', 'q3')").repartition(3, "query_id")
    got = {r.query_id: r for r in qa.answer(corpus, asked, qa.Models(generate=generate)).collect()}
    assert got["q1"].answer.startswith("EVIDENCE:\n[PÁGINA 1]\nRED FOX RED") and got["q1"].error is None
    assert "QUESTION:\nRED FOX FOX" in got["q1"].answer
    plain = {r.query_id: r for r in qa.answer(corpus, queries(spark)).collect()}
    assert plain["q2"].sources == [] and plain["q2"].answer.startswith("Não encontrei evidências suficientes")
    assert len(plain) == len(ASKED)


def test_benchmark_passages_are_found(spark):
    from checks import workload

    sf = "/root/testdata/sf0.01"
    documents = workload.table(spark, sf, "documents").select(F.lit("all").alias("collection_id"), F.col("doc_id").alias("chunk_id"), "text")
    items = workload.table(spark, sf, "benchmark")
    truth = documents.select("chunk_id", "text").collect()
    pairs = {(str(item.item_id), d.chunk_id) for item in items.collect() for d in truth if item.text in d.text}
    index = lexical.build_index(documents)
    asked = items.select(F.col("item_id").cast("string").alias("query_id"), F.lit("all").alias("collection_id"), F.col("text").alias("query"))
    top = {(r.query_id, r.chunk_id) for r in lexical.keyword_topk(lexical.query_weights(index, asked)).collect()}
    assert pairs and len(pairs & top) / len(pairs) >= 0.95


@pytest.mark.parametrize("spread_by", [0.05, 3.0])
def test_cells_give_the_exact_neighbours_and_skip_far_ones(spark, spread_by):
    """Clustered and unclustered vectors, equal ones, small and empty collections, queries without vector."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 2
    rows = [("x", i, (centres[i % 12] + rng.normal(size=8) * spread_by).tolist()) for i in range(900)]
    rows += [("x", 900 + i, rows[i][2]) for i in range(30)] + [("y", i, rng.normal(size=8).tolist()) for i in range(3)] + [("y", 9, None)]
    stored = spark.createDataFrame(rows, "collection_id string, chunk_id bigint, embedding array<float>")
    asked = [(f"q{i}", "x" if i % 5 else "y", rows[i * 7][2]) for i in range(40)] + [("none", "x", None), ("nowhere", "z", rows[0][2])]
    asked = spark.createDataFrame(asked, "query_id string, collection_id string, query_vector array<float>")
    index = cells.build_cells(stored, cell_rows=40)
    columns = ["query_id", "collection_id", "chunk_id", "distance", "rank"]
    for k in (1, 7) if spread_by < 1 else (7,):
        got = sorted(map(tuple, cells.vector_topk_cells(index, asked, k).select(columns).collect()))
        assert got == sorted(map(tuple, vector.vector_topk(stored, asked, k).select(columns).collect())) and got
        if spread_by < 1:
            read = cells.live_cells(index, asked, k).where("opening").count() + cells.cell_pairs(index, asked, k)[1].count()
            assert read < 0.5 * asked.join(index.cells, "collection_id").count()


def test_cells_of_an_empty_table(spark):
    none = spark.createDataFrame([], "collection_id string, chunk_id bigint, embedding array<float>")
    asked = spark.createDataFrame([("q", "x", [1.0])], "query_id string, collection_id string, query_vector array<float>")
    assert cells.vector_topk_cells(cells.build_cells(none), asked).collect() == []


def test_candidates_with_excerpts_are_the_same_without_their_texts(spark):
    long = "word  \n" * 300
    texts = [(1, long, 0), (2, long, 0), (3, long, 1), (4, None, 0), (5, None, 0), (6, " " * 2_000 + "end", 0), (7, "", 0)]
    store = spark.createDataFrame([("a", i, t, "s", "pdf", "c", p, [1], None, None) for i, t, p in texts], chunks(spark).schema)
    picks = spark.createDataFrame([("q", "a", 2, 1), ("q", "a", 3, 2)], "query_id string, collection_id string, chunk_id bigint, mmr_rank int")
    hits = spark.createDataFrame([("q", "a", i, i) for i in (1, 4, 5, 6, 7)], "query_id string, collection_id string, chunk_id bigint, rank int")
    whole = hybrid.hybrid_candidates(picks, hits, store).orderBy("ord").collect()
    for many in (False, True):
        with pytest.MonkeyPatch.context() as patch:
            if many:
                patch.setattr(session, "BROADCAST_ROWS", 1)
            short = hybrid.hybrid_candidates(picks, hits, store, excerpts=True)
            assert "text" not in short.columns and "digest" not in short.columns
            got = short.orderBy("ord").collect()
        assert [(r.ord, r.chunk_id, r.origin, r.page) for r in got] == [(r.ord, r.chunk_id, r.origin, r.page) for r in whole]
        assert [r.excerpt for r in got] == [r.text if r.text is None else " ".join(r.text.split())[:300] for r in whole]


def test_answers_write_no_texts_unless_a_model_reads_them(spark, monkeypatch):
    written = {}

    def kept(df, name, write=session.materialize):
        written[name] = df.columns
        return write(df, name)

    monkeypatch.setattr(qa, "materialize", kept)
    corpus = qa.Corpus(chunks(spark), lexical.build_index(chunks(spark)))
    first = qa.answer(corpus, queries(spark)).collect()
    assert "text" not in written["candidates"]
    again = qa.answer(corpus, queries(spark), qa.Models(generate=lambda: lambda prompts: prompts)).collect()
    assert "text" in written["candidates"]
    assert sorted((r.query_id, r.sources) for r in first) == sorted((r.query_id, r.sources) for r in again)


def test_reranking_makes_no_row_per_term(spark):
    index = lexical.build_index(chunks(spark))
    weights = lexical.query_weights(index, queries(spark))
    slots = spark.createDataFrame(
        [("q1", 0, "a", 0), ("q1", 1, "a", 1), ("q1", 2, "a", 2), ("q2", 0, "a", 0), ("q4", 0, "a", 0), ("q1", 3, "a", 3)],
        "query_id string, ord int, collection_id string, chunk_id bigint",
    )
    idf = {(r.query_id, r.term): r.idf for r in weights.table.collect()}
    total = idf["q1", "red"] + idf["q1", "fox"]
    want = [("q1", 0, 1.0), ("q1", 1, round(idf["q1", "fox"] / total, 6)), ("q1", 2, 0.0), ("q1", 3, 0.0), ("q2", 0, 0.0), ("q4", 0, 0.0)]
    for few in (True, False):
        made = hybrid.rerank_overlap(slots, dataclasses.replace(weights, small=few))
        assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.query_id, r["index"], r.relevance_score) for r in made.collect()) == want


def test_very_many_matches_are_scored_without_rows_for_them(spark, monkeypatch):
    index = lexical.build_index(chunks(spark))
    weights = lexical.query_weights(index, queries(spark))
    want = sorted(lexical.keyword_topk(weights, 2).collect())
    monkeypatch.setattr(lexical.QueryWeights, "matches", property(lambda self: 40_000_000_000))
    monkeypatch.setattr(lexical, "candidates", None)
    got = lexical.keyword_topk(weights, 2)
    assert sorted(got.collect()) == want


def test_a_written_table_leaves_no_shuffle(spark):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {name for top in folders for _, _, names in os.walk(top) for name in names if name.startswith("shuffle_")}
    before = shuffled()
    kept = session.materialize(spark.range(1_000).repartition(5, "id"), "spread")
    assert shuffled() <= before and kept.count() == 1_000
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == "false"


def test_counted_terms_equal_those_of_the_native_functions(spark, monkeypatch):
    rng = random.Random(5)
    words = ["red", "Straße", "ÑAR", "de", "não", "x1", "ﬁn", "日本", "\U0001d54f", "e\u0301", "\uffee\U00010400", "--", "\n", "a_b"]
    texts = ["", " ", "--", None, "red"] + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(120)]
    rows = [(rng.choice(["a", "b", None]), None if i % 40 == 7 else i // 2, text) for i, text in enumerate(texts)]
    made = spark.createDataFrame(rows, "collection_id string, chunk_id bigint, text string")
    monkeypatch.setattr(lexical, "COUNTED_BYTES", 300)
    for stop in (None, ["red", "x1"], []):
        tokens = lexical.remove_stopwords(lexical.tokenize(lexical.normalize_text(F.col("text"))), lexical.default_stopwords() if stop is None else stop)
        filled = made.where(F.length("text") > 0).select("collection_id", "chunk_id", tokens.alias("tokens"))
        want = filled.select("collection_id", "chunk_id", F.size("tokens").alias("dl"), lexical.term_counts(F.col("tokens")).alias("terms"))
        got = lexical.forward_table(made, stop)
        assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [(f.name, f.dataType.simpleString()) for f in want.schema]
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert "transform(" not in got._jdf.queryExecution().executedPlan().toString()
