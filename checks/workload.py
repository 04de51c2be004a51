"""One registered query per operator, over whole tables.

Documents are the chunks of four collections (one per language); every benchmark text is asked of every
collection. Conversations give sessions, plans, findings and guardrail input. The index of a data folder is
built once per session and kept as written tables, as an index is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evispan.constants import CLARIFICATION_FIELD, MAX_CLARIFICATION_CHARS, SEARCH_FAILED_ANSWER, SEARCH_FAILED_ERROR
from evispan.functions import guardrails as rules
from evispan.functions import labels, tokenizers
from evispan.functions import text as tx
from evispan.functions.stopwords import stopwords
from evispan.operators import findings as fo
from evispan.operators import cells, guardrail, hybrid, lexical, sessions, vector
from evispan.plans import quick_answer as qa
from evispan.plans import requests as plan_requests
from evispan.plans import research
from evispan.plans import sessions as plan_sessions
from evispan.schema import CHUNK_COLUMNS
from evispan.session import materialize, new_path, spread
from evispan.sources import blocks, files, rows, store, uploads
from evispan.streaming import jobs

LANGUAGES = ("de", "en", "es", "fr")
REFUSED = ["straße", "ñar", "pour"]
BLOCKED = ["The", "straße", "und", "pour", "ñar"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- shared inputs


def _chunk_row(documents: DataFrame, collection: str) -> DataFrame:
    return documents.select(
        F.col(collection).cast("string").alias("collection_id"),
        F.col("doc_id").alias("chunk_id"),
        "text",
        "source",
        F.lit("pdf").alias("file_type"),
        F.lit("docling_hybrid").alias("chunking"),
        F.lit(0).alias("page"),
        F.array(F.lit(1)).alias("pages"),
        F.lit(None).cast("bigint").alias("row_start"),
        F.lit(None).cast("bigint").alias("row_end"),
        F.lit(None).cast("int").alias("n_tokens"),
    ).select(*CHUNK_COLUMNS)


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunk_row(table(spark, sf, "documents"), "lang")


_built: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf: str, name: str, build):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def index(spark: SparkSession, sf: str) -> lexical.LexicalIndex:
    return _once(spark, sf, "index", lambda: lexical.build_index(chunks(spark, sf)))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    text = chunks(spark, sf).select("collection_id", "chunk_id", "text")
    return _once(spark, sf, "vectors", lambda: materialize(vector.embed(text), "vectors"))


def corpus(spark: SparkSession, sf: str, with_vectors: bool = True) -> qa.Corpus:
    return qa.Corpus(chunks(spark, sf), index(spark, sf), vectors(spark, sf) if with_vectors else None)


def queries_table(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select(
        "item_id", "text", F.explode(F.array(*[F.lit(lang) for lang in LANGUAGES])).alias("collection_id")
    )
    return items.select(
        F.concat_ws(":", F.col("item_id").cast("string"), "collection_id").alias("query_id"),
        "collection_id",
        F.col("text").alias("query"),
        (F.col("item_id") % 3 + 1).cast("int").alias("depth"),
    )


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return queries_table(spark, sf).select("query_id", "collection_id", "query")


def _weights(spark: SparkSession, sf: str) -> lexical.QueryWeights:
    return lexical.query_weights(index(spark, sf), _queries(spark, sf))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    embedded = vector.embed(_queries(spark, sf), "query").withColumnRenamed("embedding", "query_vector")
    return materialize(embedded, "asked")


def _keyword_candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, lexical.QueryWeights]:
    weights = _weights(spark, sf)
    found = qa.retrieve(corpus(spark, sf, with_vectors=False), _queries(spark, sf), weights)
    return materialize(found, "candidates"), weights


def _keyword_reranked(spark: SparkSession, sf: str) -> DataFrame:
    candidates, weights = _keyword_candidates(spark, sf)
    results = materialize(hybrid.rerank_overlap(candidates, weights), "scores")
    return hybrid.rerank_validate(candidates, results)[0]


def research_questions(spark: SparkSession, sf: str) -> DataFrame:
    return queries_table(spark, sf).select(F.col("query_id").alias("question_id"), "collection_id", F.col("query").alias("question"), "depth")


def sentence_plan(questions: DataFrame) -> DataFrame:
    """Planned sub-questions: the sentences of the question, one per line."""
    return fo.parse_subquestions(questions.select("question_id", "question", F.replace("question", F.lit(". "), F.lit("\n")).alias("output")))


def _round_searches(spark: SparkSession, sf: str) -> DataFrame:
    questions = research_questions(spark, sf)
    queue = fo.initial_queue(questions, sentence_plan(questions))
    return queue.join(questions.select("question_id", "collection_id"), "question_id").select(
        "question_id", "collection_id", F.lit(1).alias("round"), "ord", "query"
    )


def searched_findings(spark: SparkSession, sf: str) -> DataFrame:
    found = research.search(corpus(spark, sf, with_vectors=False), _round_searches(spark, sf))
    return materialize(found, "findings")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").withColumn("session_id", F.col("conv_id").cast("string"))


def talk_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings out of conversations: a user turn is a sub-question, the assistant turn after it its answer,
    the lines of the answer are the sources (odd lines by page, even ones by rows)."""
    order = Window.partitionBy("session_id").orderBy("turn")
    paired = turns(spark, sf).select(
        "session_id", "turn", "role", "text",
        F.when(F.lead("role").over(order) == "assistant", F.lead("text").over(order)).alias("reply"),
    ).where("role = 'user'")
    lines = F.transform(
        F.split("reply", "\n"),
        lambda line, i: F.struct(
            F.when(i % 2 == 0, i + 1).cast("int").alias("page"),
            F.when(i % 2 == 1, i + 1).cast("bigint").alias("row_start"),
            F.when(i % 4 == 1, F.lit(0)).when(i % 4 == 3, i + 3).cast("bigint").alias("row_end"),
            tx.excerpt(line).alias("excerpt"),
        ),
    )
    none = F.slice(F.transform(F.array(F.lit("")), lambda x, i: F.struct(i.alias("page"), i.cast("bigint").alias("row_start"), i.cast("bigint").alias("row_end"), x.alias("excerpt"))), 1, 0)
    missing = F.col("reply").isNull()
    return paired.select(
        F.col("session_id").alias("question_id"),
        F.lit(1).alias("round"),
        F.col("turn").cast("int").alias("ord"),
        F.col("text").alias("subquestion"),
        F.when(missing, F.lit(SEARCH_FAILED_ANSWER)).otherwise(F.col("reply")).alias("answer"),
        F.when(missing, none).otherwise(lines).alias("sources"),
        F.when(missing, F.lit(0)).otherwise(F.size(F.split("reply", "\n"))).alias("evidence_count"),
        F.when(missing, F.lit(SEARCH_FAILED_ERROR)).alias("error"),
    )


def talk_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The first user turn of every conversation."""
    first = F.min_by("text", "turn")
    users = turns(spark, sf).where("role = 'user'")
    return users.groupBy(F.col("session_id").alias("question_id")).agg(first.alias("question"))


def talk_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Plan texts: the question in lower case, then the lines of the assistant turns as bullets."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "text")))  # a conversation has few turns
    replies = turns(spark, sf).where("role = 'assistant'").groupBy(F.col("session_id").alias("question_id")).agg(
        F.array_join(ordered["text"], "\n\n- ").alias("reply")
    )
    bullets = F.concat(F.lit("Subperguntas\n1. "), F.lower("question"), F.lit("\n\n- "), F.replace("reply", F.lit("\n"), F.lit("\n 2) ")))
    return talk_questions(spark, sf).join(replies, "question_id").select("question_id", "question", bullets.alias("output"))


def talk_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions: short questions need clarification."""
    base = talk_questions(spark, sf).select(F.col("question_id").alias("session_id"), F.col("question").alias("original_query"))
    return sessions.clarification_questions(base.withColumn("needs_clarification", F.length("original_query") < 200))


def talk_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers: all later turns; those of every conversation are also sent to a session that does not exist."""
    later = turns(spark, sf).where("turn > 0").select("session_id", F.col("turn").alias("seq"), "text")
    return later.unionByName(later.where("seq = 1").withColumn("session_id", F.concat(F.lit("x"), "session_id")))


# ---------------------------------------------------------------- sources and ingestion


def admission_filter(spark, sf):
    extension = F.create_map(*[F.lit(v) for v in ("en", ".PDF", "fr", ".csv", "de", ".txt", "es", ".Csv")])[F.col("lang")]
    uploads = table(spark, sf, "documents").select(
        F.concat(F.lit("/in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), extension).alias("path"),
        (F.col("n_chars") * 8000).alias("length"),
    )
    accepted, rejects = files.admission_filter(uploads)
    none = accepted.select(F.col("path").alias("id"), F.lit(None).cast("int").alias("status_code"), F.lit(None).cast("string").alias("detail"))
    return none.unionByName(rejects)


def csv_rows_ingest(spark, sf):
    made, _ = files.csv_chunks(files.csv_records(_customer_files(spark, sf)))
    return made.select("source", "chunk_id", "row_start", "row_end", "text", "n_tokens")


def header_normalize(spark, sf):
    headers = turns(spark, sf).select(
        F.concat_ws(":", "session_id", F.col("turn").cast("string")).alias("file_id"), F.posexplode_outer(F.split("text", " ")).alias("pos", "value")
    )
    return files.header_normalize(headers.withColumn("pos", F.col("pos") + 1))


def row_chunks(spark, sf):
    orders = table(spark, sf, "orders")
    made = rows.row_chunks(orders, "o_orderstatus", "o_orderkey", ["o_orderkey", "o_orderpriority", "o_custkey"], F.lit("orders"))
    return made.select("collection_id", "chunk_id", "text", "row_start", "row_end", "n_tokens")


def _customer_files(spark, sf):
    line = F.concat(
        F.col("c_name"), F.lit("; "), F.col("c_mktsegment"), F.lit(" ;\""), F.col("c_nationkey").cast("string"), F.lit("\nx\";"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit("\n;;;")).otherwise(F.lit("")),
    )
    return (
        table(spark, sf, "customer")
        .groupBy(F.floor(F.col("c_custkey") / 500).alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("lines"))
        .select(
            F.concat(F.lit("/in/customers-"), F.col("part").cast("string"), F.lit(".csv")).alias("path"),
            F.encode(F.concat(F.lit("name;segment;segment;\n"), F.array_join(F.col("lines.line"), "\n"), F.lit("\n")), "utf-8").alias("content"),
        )
    )


def _line_parser():
    """Stands for a PDF parser: a text's lines are blocks of page 1; it fails on texts of some lengths."""

    def parse(content):
        text = content.decode()
        if len(text) % 50 == 0:
            raise ValueError("unreadable")
        return [(1, None, line) for line in text.split("\n")]

    return parse


def uploads_profile(spark, sf):
    """Profiles and rejects of uploads of all kinds: documents as PDF files, customers as CSV files, CSV files of a
    header alone for nations, text files for regions, and files that are too large for suppliers."""
    named = lambda df, key, ending: df.withColumn("path", F.concat(F.lit("/in/"), F.col(key).cast("string"), F.lit(ending)))
    made = named(table(spark, sf, "documents"), "doc_id", ".pdf").select("path", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    made = made.unionByName(_customer_files(spark, sf))
    headers = named(table(spark, sf, "nation"), "n_name", ".csv").select("path", F.encode(F.concat("n_name", F.lit(";x\n")), "utf-8").alias("content"))
    plain = named(table(spark, sf, "region"), "r_name", ".txt").select("path", F.encode("r_name", "utf-8").alias("content"))
    uploads_ = made.unionByName(headers).unionByName(plain).withColumn("length", F.octet_length("content").cast("bigint"))
    large = named(table(spark, sf, "supplier"), "s_suppkey", ".large.pdf").select("path", F.lit(None).cast("binary").alias("content"))
    done = uploads.ingest_uploads(uploads_.unionByName(large.withColumn("length", F.lit(files.MAX_FILE_BYTES + 1).cast("bigint"))), _line_parser)
    columns = ["source", "file_type", "pages", "rows", "chunks", "minimum_chunk_tokens", "average_chunk_tokens", "maximum_chunk_tokens", "average_chunk_characters"]
    profiles = done.profiles.select(F.col("source").alias("id"), *columns[1:], F.lit(None).cast("int").alias("status_code"), F.lit(None).cast("string").alias("detail"))
    return profiles.unionByName(done.rejects, allowMissingColumns=True)


def _document_chunks(spark, sf):
    documents = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("collection_id"), "source", "text")
    return blocks.chunk_documents(documents)


def chunk_documents(spark, sf):
    return _document_chunks(spark, sf).select("collection_id", "chunk_id", "text", "n_tokens")


def chunk_blocks(spark, sf):
    lines = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("collection_id"), "source", F.posexplode_outer(F.split("text", "\n")).alias("block_no", "text")
    )
    paged = lines.withColumn("page_no", F.floor(F.col("block_no") / 3).cast("int") + 1).withColumn("heading", F.lit(None).cast("string"))
    return blocks.chunk_blocks(paged).select("collection_id", "chunk_id", "text", "n_tokens")


def chunk_pages(spark, sf):
    lines = spread(table(spark, sf, "documents")).select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("block_no", "text"))
    located = lines.groupBy("doc_id").agg(F.collect_set((F.floor(F.col("block_no") / 4) + F.col("doc_id") % 3).cast("int")).alias("found"))
    page, pages = blocks.page_provenance(F.col("found"))
    return located.select("doc_id", page.alias("page"), F.array_join(pages.cast("array<string>"), ",").alias("pages"))


def token_counts(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", tx.token_count(F.col("text")).alias("n_tokens"))


def token_counts_pieces(spark, sf):
    """Token counts by a plug-in: pieces of at most four characters."""
    return spread(table(spark, sf, "documents")).select("doc_id", tokenizers.counted(F.col("text"), tokenizers.fixed_pieces(4)).alias("n_tokens"))


def document_profile(spark, sf):
    return store.document_profile(_document_chunks(spark, sf)).drop("rows")


def embed_chunks(spark, sf):
    embedded = vector.embed(chunks(spark, sf).select("collection_id", "chunk_id", "text"))
    dims = embedded.select("collection_id", "chunk_id", F.posexplode_outer("embedding").alias("dim", "weight"))
    return dims.where("weight > 0").select("collection_id", "chunk_id", "dim", F.round(F.col("weight").cast("double"), 6).alias("weight"))


def index_build(spark, sf):
    kept = store.IndexStore(spark, new_path(spark, "store"))
    kept.add(chunks(spark, sf), "all")
    built = kept.corpus()
    terms = built.index.forward.groupBy("collection_id").agg(F.sum(F.size("terms")).alias("n_postings"))
    stored = built.vectors.groupBy("collection_id").agg(F.count(F.lit(1)).alias("n_vectors"))
    return built.index.stats.join(terms, "collection_id").join(stored, "collection_id").select("collection_id", "n_chunks", "n_postings", "n_vectors")


def repeated_upload(spark, sf):
    """Chunks of a store after a first upload of everything, a second one of two collections with fewer chunks, a
    compaction, and a third upload of one collection."""
    kept = store.IndexStore(spark, new_path(spark, "store"))
    rows = chunks(spark, sf)
    kept.add(rows, "first", with_vectors=False)
    kept.add(rows.where("collection_id IN ('de', 'fr') AND chunk_id % 2 = 0"), "second", with_vectors=False)
    kept.compact("together", with_vectors=False)
    kept.add(rows.where("collection_id = 'es'").withColumn("text", F.concat(F.lit("3 "), "text")), "third", with_vectors=False)
    kept.vacuum()
    built = kept.corpus(with_vectors=False)
    matched = lexical.by_chunk(built.index.postings, lexical.posting_bound(kept.stats()))
    lengths = matched.groupBy("collection_id", "chunk_id").agg(F.sum("tf").alias("n_terms"))
    return kept.chunks().select("collection_id", "chunk_id", "text").join(lengths, ["collection_id", "chunk_id"], "left")


def _collection_questions(spark, sf):
    asked = table(spark, sf, "conversations").where("role = 'user'").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        F.concat(F.lit("src"), (F.col("conv_id") % 25).cast("string")).alias("collection_id"),
        F.col("text").alias("question"),
    )
    return asked, _chunk_row(table(spark, sf, "documents"), "source")


def known_collections(spark, sf):
    return guardrail.known_collections(*_collection_questions(spark, sf))[0].select("question_id", "collection_id")


def unknown_collections(spark, sf):
    return guardrail.known_collections(*_collection_questions(spark, sf))[1]


# ---------------------------------------------------------------- text functions


def normalize_text(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", tx.normalize_text(F.col("text")).alias("normalized"))


def tokenize(spark, sf):
    tokens = spread(table(spark, sf, "documents")).select("doc_id", tx.tokenize(tx.normalize_text(F.col("text"))).alias("tokens"))
    return tokens.select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n_tokens"))


def stopword_filter(spark, sf):
    tokens = spread(table(spark, sf, "documents")).select(
        "doc_id", tx.remove_stopwords(tx.tokenize(tx.normalize_text(F.col("text"))), stopwords()).alias("tokens")
    )
    return tokens.select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n_tokens"))


def excerpt(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


def location_label(spark, sf):
    start = F.when(F.col("l_returnflag") != "R", F.col("l_linenumber"))
    end = F.when(F.col("l_linestatus") == "O", F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3).when(F.col("l_returnflag") == "A", F.lit(0))
    page = F.when(F.col("l_tax") > 0.02, F.col("l_suppkey").cast("int"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        labels.document_location(F.coalesce(page, F.lit(0)), start, end).alias("chunk_label"),
        labels.source_location(page, start, end).alias("source_label"),
    )


def parse_subquestions(spark, sf):
    return fo.parse_subquestions(talk_plans(spark, sf))


def short_summary(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", tx.short_summary(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("summary"))


# ---------------------------------------------------------------- retrieval


def postings(spark, sf):
    return index(spark, sf).postings


def collection_stats(spark, sf):
    return index(spark, sf).stats.select("collection_id", "n_chunks", F.round("avgdl", 6).alias("avgdl"))


def term_df(spark, sf):
    return lexical.term_df(index(spark, sf).blocks).select("collection_id", "term", "df")


def bm25_scores(spark, sf):
    return lexical.bm25_scores(_weights(spark, sf))


def keyword_topk(spark, sf):
    return lexical.keyword_topk(_weights(spark, sf))


def keyword_topk_pruned(spark, sf):
    """The same through thresholds, term and block bounds, whatever the size."""
    return lexical.keyword_topk(_weights(spark, sf), full_up_to=0)


def vector_topk(spark, sf):
    return vector.vector_topk(vectors(spark, sf), _asked(spark, sf)).drop("embedding")


def vector_topk_blocks(spark, sf):
    return vector.vector_topk(vectors(spark, sf), _asked(spark, sf), broadcast_queries=0).drop("embedding")


def vector_cells(spark, sf):
    return cells.vector_topk_cells(cells.build_cells(vectors(spark, sf), cell_rows=64), _asked(spark, sf)).drop("embedding")


def label_neighbours(spark, sf):
    """Nearest stored vectors of every label's mean vector, over the embeddings table as one collection."""
    stored = table(spark, sf, "embeddings").select(F.lit("all").alias("collection_id"), F.col("vec_id").alias("chunk_id"), "embedding", "label")
    means = (
        stored.select("label", F.posexplode_outer("embedding").alias("dim", "value"))
        .groupBy("label", "dim")
        .agg((F.sum(F.col("value").cast("decimal(20,12)")) / F.count(F.lit(1))).cast("double").alias("mean"))
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("dim", F.round("mean", 6).alias("mean")))).alias("parts"))
        .select(F.col("label").cast("string").alias("query_id"), F.lit("all").alias("collection_id"), F.col("parts.mean").cast("array<float>").alias("query_vector"))
    )
    return vector.vector_topk(stored, materialize(means, "means")).drop("embedding", "collection_id")


def mmr_select(spark, sf):
    asked = _asked(spark, sf)
    return vector.mmr_select(vector.vector_topk(vectors(spark, sf), asked), asked)


def _hybrid(spark, sf):
    weights = _weights(spark, sf)
    return materialize(qa.retrieve(corpus(spark, sf), _queries(spark, sf), weights), "candidates"), weights


def hybrid_candidates(spark, sf):
    return _hybrid(spark, sf)[0].select("query_id", "ord", "chunk_id", "origin", "origin_rank")


def rerank_topn(spark, sf):
    candidates, weights = _hybrid(spark, sf)
    results = materialize(hybrid.rerank_overlap(candidates, weights), "scores")
    return hybrid.rerank_validate(candidates, results)[0].select("query_id", "rank", "chunk_id", "rerank_score")


def rerank_validate(spark, sf):
    candidates, _ = _keyword_candidates(spark, sf)
    results = candidates.select(
        "query_id", (F.col("ord") + 1).alias("result_ord"),
        F.when(F.col("ord") % 5 != 4, F.col("ord") * 3 - 4 + F.when(F.col("collection_id") == "es", 20).otherwise(0)).alias("index"),
        (F.col("ord") * 0.25).alias("relevance_score"), F.lit(None).cast("int").alias("status_code"), F.lit(None).cast("string").alias("detail"),
    )
    kept, failed = hybrid.rerank_validate(candidates, results)
    good = kept.select("query_id", "rank", "chunk_id", "rerank_score", F.lit(None).cast("int").alias("status_code"))
    bad = failed.select(
        "query_id", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("bigint").alias("chunk_id"),
        F.lit(None).cast("double").alias("rerank_score"), "status_code",
    )
    return good.unionByName(bad)


def sources(spark, sf):
    return hybrid.sources(_keyword_reranked(spark, sf)).select("query_id", "rank", "chunk_id", "source.*", "rerank_score")


def answer_context(spark, sf):
    return hybrid.answer_context(_keyword_reranked(spark, sf))


def quick_answer(spark, sf):
    return qa.answer(corpus(spark, sf), _queries(spark, sf)).select(
        "query_id", "answer", F.size("sources").alias("n_sources"), F.array_join(F.transform("sources", lambda s: s["excerpt"]), "\n").alias("excerpts")
    )


# ---------------------------------------------------------------- guardrails


def request_validation(spark, sf):
    requests = turns(spark, sf).where("role = 'user'").select(
        F.concat_ws(":", "session_id", F.col("turn").cast("string")).alias("question_id"),
        F.when(F.col("conv_id") % 7 == 0, F.substring("text", 1, 2)).otherwise(F.col("text")).alias("question"),
        F.when(F.col("turn") != 2, F.col("turn")).cast("int").alias("depth"),
    )
    valid, rejects = guardrail.validate_requests(requests)
    good = valid.select(F.col("question_id").alias("id"), "depth", F.lit(None).cast("int").alias("status_code"), F.lit(None).cast("string").alias("detail"))
    return good.unionByName(rejects.select("id", F.lit(None).cast("int").alias("depth"), "status_code", "detail"))


def request_outcomes(spark, sf):
    """Every user turn as a request: some malformed, some refused, a fifth for a collection that doesn't exist."""
    languages = F.array(*[F.lit(lang) for lang in (*LANGUAGES, "xx")])
    requests = turns(spark, sf).where("role = 'user'").select(
        F.concat_ws(":", "session_id", F.col("turn").cast("string")).alias("question_id"),
        F.get(languages, (F.col("conv_id") % 5).cast("int")).alias("collection_id"),
        F.when(F.col("conv_id") % 7 == 0, F.substring("text", 1, 2)).otherwise(F.col("text")).alias("question"),
    )
    built = corpus(spark, sf, with_vectors=False)
    made = plan_requests.request_outcomes(built, requests, built.index.stats, REFUSED)
    return made.select("id", "status_code", "detail", "answer", F.size("sources").alias("n_sources"))


def guardrail_length(spark, sf):
    text = F.when(F.col("doc_id") % 50 == 0, F.lit(" \t\n")).otherwise(F.col("text"))
    return spread(table(spark, sf, "documents")).select("doc_id", rules.is_empty(text).alias("is_empty"), rules.is_too_long(text, 2000).alias("is_too_long"))


def blocked_terms(spark, sf):
    normalized = spread(table(spark, sf, "documents")).select("doc_id", tx.compat_casefold(F.col("text")).alias("normalized"))
    found = normalized.select("doc_id", rules.blocked_terms(F.col("normalized"), BLOCKED).alias("found"))
    return found.select("doc_id", F.posexplode_outer("found").alias("pos", "term")).where("term is not null").select("doc_id", "term")


def blocked_terms_long(spark, sf):
    """A long list, all words of four letters and more of the test items, in every document."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))).alias("term")).distinct()
    terms = sorted(row.term for row in words.collect())  # the list is configuration; its bytes are checked
    normalized = spread(table(spark, sf, "documents")).select("doc_id", tx.compat_casefold(F.col("text")).alias("normalized"))
    found = normalized.select("doc_id", rules.blocked_terms(F.col("normalized"), terms).alias("found")).where(F.size("found") > 0)
    return found.select("doc_id", F.size("found").alias("n_terms"), F.array_join("found", ",").alias("terms"))


def _decided(spark, sf):
    texts = turns(spark, sf).select(F.concat_ws(":", "session_id", F.col("turn").cast("string")).alias("id"), F.concat(F.lit("  "), "text", F.lit("\n")).alias("text"))
    return guardrail.guardrail_decision(texts, "text", CLARIFICATION_FIELD, MAX_CLARIFICATION_CHARS, BLOCKED)


def guardrail_decision(spark, sf):
    return _decided(spark, sf).select("id", "allowed", "reason", F.size("violations").alias("n_violations"))


def guardrail_enforce(spark, sf):
    accepted, rejects = guardrail.guardrail_enforce(_decided(spark, sf), "id", "text")
    good = accepted.select("id", "text", F.lit(None).cast("int").alias("status_code"), F.lit(None).cast("string").alias("detail"))
    return good.unionByName(rejects.select("id", F.lit(None).cast("string").alias("text"), "status_code", "detail"))


def blocked_term_list(spark, sf):
    as_json = F.to_json(F.split("text", r"\. "))
    raw = F.when(F.col("role") == "user", F.col("text")).when(F.col("role") == "assistant", as_json).otherwise(F.lit(" [1, 2] "))
    lists = turns(spark, sf).select("conv_id", "turn", rules.blocked_term_list(raw).alias("terms"))
    return lists.select("conv_id", "turn", F.size("terms").alias("n_terms"), F.array_join("terms", "|").alias("terms"))


# ---------------------------------------------------------------- research


def unsupported(spark, sf):
    return fo.unsupported(talk_findings(spark, sf))


def repeated_answers(spark, sf):
    return fo.repeated_answers(searched_findings(spark, sf)).select("question_id", "first_ord", "subquestions")


def follow_ups(spark, sf):
    return fo.follow_ups(talk_findings(spark, sf)).select("question_id", "ord", "follow_up")


def dedupe_sources(spark, sf):
    return fo.dedupe_sources(searched_findings(spark, sf))


def initial_queue(spark, sf):
    return fo.initial_queue(talk_questions(spark, sf), fo.parse_subquestions(talk_plans(spark, sf)))


def unseen_queries(spark, sf):
    users = turns(spark, sf).where("role = 'user'").select(F.col("session_id").alias("question_id"), "turn", F.col("text").alias("query"))
    return fo.unseen(users.unionByName(users.withColumn("query", F.lower("query"))), talk_questions(spark, sf).withColumnRenamed("question", "query")).select("question_id", "turn", "query")


def findings(spark, sf):
    return searched_findings(spark, sf).select("question_id", "ord", "subquestion", "answer", "evidence_count", "error")


def format_findings(spark, sf):
    return fo.format_findings(_all_talks(spark, sf), talk_findings(spark, sf))


def _all_talks(spark, sf):
    """All conversations, and as many that have no findings."""
    talks = turns(spark, sf).select(F.col("session_id").alias("question_id")).distinct()
    return talks.unionByName(talks.select(F.concat(F.lit("x"), "question_id").alias("question_id")))


def sufficiency(spark, sf):
    judged = fo.sufficiency(_all_talks(spark, sf), talk_findings(spark, sf))
    return judged.select("question_id", "is_sufficient", "reason", F.array_join("missing_information", " | ").alias("missing"))


def refinement_dedupe(spark, sf):
    lines = turns(spark, sf).select(F.col("session_id").alias("question_id"), "turn", F.posexplode_outer(F.split("text", "\n")).alias("pos", "query"))
    planned = lines.select("question_id", (F.col("turn") * 10_000 + F.col("pos")).cast("int").alias("ord"), "query")
    twice = planned.unionByName(planned.select("question_id", (F.col("ord") + 5_000).alias("ord"), F.lower("query").alias("query")))
    executed = lines.where("pos = 0").select("question_id", F.lower("query").alias("query"))
    return fo.refinement_dedupe(twice, executed)


def refinement_fallback(spark, sf):
    questions = talk_questions(spark, sf)
    return fo.refinement_fallback(fo.sufficiency(questions, talk_findings(spark, sf)), questions)


def _research(spark, sf):
    questions = research_questions(spark, sf)
    return questions, research.research_rounds(corpus(spark, sf, with_vectors=False), questions, sentence_plan(questions))


def research_rounds(spark, sf):
    _, result = _research(spark, sf)
    last = result.judged.select("question_id", "rounds_completed", "is_sufficient")
    return result.findings.select("question_id", "round", "subquestion", "answer", "evidence_count").join(last, "question_id")


def report_fallback(spark, sf):
    questions = talk_questions(spark, sf)
    found = talk_findings(spark, sf)
    return fo.report_fallback(fo.sufficiency(questions, found), found)


def research_report(spark, sf):
    questions, result = _research(spark, sf)
    made = research.research_report(questions, result)
    return made.select(
        "question_id", "answer", "short_summary", "rounds_completed", "is_sufficient", F.size("sources").alias("n_sources"),
        F.array_join("follow_up_questions", "|").alias("follow_ups"), F.array_join("conflicting_subquestions", "|").alias("conflicts"),
    )


# ---------------------------------------------------------------- sessions and streams


def clarification_questions(spark, sf):
    made = talk_sessions(spark, sf)
    return made.select("session_id", F.posexplode_outer("clarification_questions").alias("pos", "question")).where("question is not null")


def _outcomes(spark, sf):
    made = talk_sessions(spark, sf)
    return made, sessions.answer_outcomes(made, talk_answers(spark, sf), BLOCKED)


def answer_outcomes(spark, sf):
    return _outcomes(spark, sf)[1].select("session_id", "seq", "status_code", "detail", "answer_no")


def _states(spark, sf):
    made, outcomes = _outcomes(spark, sf)
    completed = made.where(F.col("session_id").cast("int") % 2 == 0)
    return sessions.session_states(made, outcomes, completed)


def session_states(spark, sf):
    return _states(spark, sf).select("session_id", "status", F.size("clarification_responses").alias("n_responses"), F.array_join("clarification_responses", "|").alias("responses"))


def enriched_query(spark, sf):
    query = sessions.enriched_query(F.col("original_query"), F.col("clarification_questions"), F.col("clarification_responses"))
    return _states(spark, sf).select("session_id", query.alias("query"))


def session_lookup(spark, sf):
    states = turns(spark, sf).select("session_id", F.col("turn").alias("seq"), F.col("role").alias("status"))
    requested = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("session_id"))
    found, rejects = sessions.session_lookup(states, requested)
    good = found.select(F.col("session_id").alias("id"), "seq", "status", F.lit(None).cast("int").alias("status_code"))
    return good.unionByName(rejects.select("id", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("status"), "status_code"))


def _stream(spark, sf, name):
    """A table as a stream, be it one file or a folder of files. Spark takes no single file as the path of a stream, but a pattern."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/{name}.parque[t]")


EVENT_COLUMNS = "session_id string, seq bigint, kind string, text string, questions array<string>, at timestamp"
FIRST_SECOND = 1_700_000_000


def _clock(seq):
    """A conversation's turns are a second apart."""
    return F.timestamp_seconds(F.lit(FIRST_SECOND) + seq)


def _tick(spark, path, second):
    """An event that only moves the time on, so that everything before it is due."""
    none = F.lit(None).cast("string")
    row = spark.range(1).select(F.lit("clock").alias("session_id"), F.col("id").alias("seq"), F.lit(jobs.TICK).alias("kind"), none.alias("text"), F.array().cast("array<string>").alias("questions"), F.timestamp_seconds(F.lit(second)).alias("at"))
    row.write.mode("append").parquet(path)


def _session_events(spark, sf):
    """A folder of the clarification events of all conversations, and the sessions."""
    path = new_path(spark, "events")
    made = talk_sessions(spark, sf)
    none = F.array().cast("array<string>")
    starts = made.select("session_id", F.lit(0).cast("bigint").alias("seq"), F.lit("start").alias("kind"), F.col("original_query").alias("text"), F.col("clarification_questions").alias("questions"))
    answers = talk_answers(spark, sf).select("session_id", F.col("seq").cast("bigint").alias("seq"), F.lit("answer").alias("kind"), "text", none.alias("questions"))
    starts.unionByName(answers).withColumn("at", _clock(F.col("seq"))).write.parquet(path)
    _tick(spark, path, FIRST_SECOND + 2 * 86_400)
    return path, made


def _session_changes(spark, path, output, checkpoint, files=64):
    """Run the session stream over what is new in the folder; all changes so far."""
    events = spark.readStream.schema(EVENT_COLUMNS).option("maxFilesPerTrigger", files).parquet(path)
    run = jobs.session_stream(events, BLOCKED, delay="1 day").writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(jobs.SESSION_OUTPUT).parquet(output)


def session_stream(spark, sf, files=64):
    """The clarification events of all conversations as a stream on event time, and what became of every event."""
    path, _ = _session_events(spark, sf)
    states = _session_changes(spark, path, new_path(spark, "states"), new_path(spark, "checkpoint"), files)
    return states.select("session_id", "seq", "status_code", F.when(F.col("status").isNotNull(), F.size("clarification_responses")).alias("n_responses"))


def _sentence_planner():
    """Plan texts: the sentences of a question, one per line."""
    return lambda texts: [text.replace(". ", "\n") for text in texts]


def session_research(spark, sf):
    """Sessions through the stream, research of those that are ready, their end back into the stream: all sessions, and the
    reports of the completed ones."""
    path, made = _session_events(spark, sf)
    output, checkpoint = new_path(spark, "states"), new_path(spark, "checkpoint")
    changes = _session_changes(spark, path, output, checkpoint)
    number = F.col("session_id").cast("int")
    languages = F.array(*[F.lit(lang) for lang in LANGUAGES])
    requests = made.select("session_id", F.get(languages, number % len(LANGUAGES)).alias("collection_id"), (number % 3 + 1).cast("int").alias("depth"))
    done_at = FIRST_SECOND + 3 * 86_400
    ended = plan_sessions.research_sessions(
        corpus(spark, sf, with_vectors=False), changes, requests, research.Agents(plan=_sentence_planner), F.timestamp_seconds(F.lit(done_at))
    )
    ended.done.write.mode("append").parquet(path)
    _tick(spark, path, done_at + 2 * 86_400)
    states = plan_sessions.latest_states(_session_changes(spark, path, output, checkpoint))
    reports = ended.reports.select("session_id", "answer", "short_summary", "rounds_completed", "is_sufficient", F.size("sources").alias("n_sources"))
    return states.select("session_id", "status", F.size("clarification_responses").alias("n_responses")).join(reports, "session_id", "left")


def stream_ingest(spark, sf):
    kept = store.IndexStore(spark, new_path(spark, "store"))
    arrivals = _stream(spark, sf, "documents")
    run = jobs.stream_ingest(arrivals, kept, lambda batch: _chunk_row(batch, "lang"), new_path(spark, "checkpoint"))
    run.awaitTermination()
    built = kept.corpus()
    terms = built.index.forward.groupBy("collection_id").agg(F.sum(F.size("terms")).alias("n_postings"))
    stored = built.vectors.groupBy("collection_id").agg(F.count(F.lit(1)).alias("n_vectors"))
    return built.index.stats.join(terms, "collection_id").join(stored, "collection_id").select("collection_id", "n_chunks", "n_postings", "n_vectors")


def stream_questions(spark, sf):
    items = _stream(spark, sf, "benchmark").select("item_id", "text", F.explode(F.array(*[F.lit(lang) for lang in LANGUAGES])).alias("collection_id"))
    asked = items.select(F.concat_ws(":", F.col("item_id").cast("string"), "collection_id").alias("query_id"), "collection_id", F.col("text").alias("query"))
    output = new_path(spark, "answers")
    run = jobs.stream_questions(asked, lambda: corpus(spark, sf), output, new_path(spark, "checkpoint"))
    run.awaitTermination()
    return spark.read.parquet(output).select("query_id", "answer", F.size("sources").alias("n_sources"))


REGISTERED = [
    admission_filter, csv_rows_ingest, header_normalize, row_chunks, chunk_documents, chunk_blocks, chunk_pages, token_counts, token_counts_pieces, uploads_profile,
    document_profile, embed_chunks, index_build, repeated_upload, known_collections, unknown_collections,
    normalize_text, tokenize, stopword_filter, excerpt, location_label, parse_subquestions, short_summary,
    postings, collection_stats, term_df, bm25_scores, keyword_topk, keyword_topk_pruned, vector_topk, vector_topk_blocks, vector_cells, label_neighbours, mmr_select,
    hybrid_candidates, rerank_topn, rerank_validate, sources, answer_context, quick_answer,
    request_validation, request_outcomes, guardrail_length, blocked_terms, blocked_terms_long, guardrail_decision, guardrail_enforce, blocked_term_list,
    unsupported, repeated_answers, follow_ups, dedupe_sources, initial_queue, unseen_queries, findings, format_findings,
    sufficiency, refinement_dedupe, refinement_fallback, research_rounds, report_fallback, research_report,
    clarification_questions, answer_outcomes, session_states, enriched_query, session_lookup, session_stream, session_research,
    stream_ingest, stream_questions,
]
QUERIES = {function.__name__: function for function in REGISTERED}
