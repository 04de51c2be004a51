"""Registered queries of the operators, and the SQL they are checked against where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from evispan.llm import quality, toxicity
from evispan.llm.alignment import cross_tokenizer_alignment
from evispan.llm.common import fold_of, table
from evispan.llm.decontaminate import contamination, decontaminate
from evispan.llm.exact_dedup import exact_dedup
from evispan.llm.line_dedup import line_dedup
from evispan.llm.linear import training_rows
from evispan.llm.lm_score import lattice_scores
from evispan.llm.merkle import digest_of, fold, merkle_proofs, siblings_digest
from evispan.llm.minhash import near_duplicates
from evispan.llm.packing import pack
from evispan.llm.sharding import shard
from evispan.llm.suffix_dedup import suffix_dedup
from evispan.llm.warc_store import base32_sha1, read_records, write_archive

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Vocabulary file of a public tokenizer, on this machine and at the same place on executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[function.__name__] = function
    return function


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    placed = shard(table(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the boilerplate lines of their source."""
    cleaned = line_dedup(table(spark, sf_dir, "documents"), F.col("source"))
    return cleaned.select("doc_id", "source", "text", "n_dropped")


LLM_ORACLES["op2_line_dedup"] = r"""
WITH doc AS (SELECT row_number() OVER () AS rid, * FROM documents),
line AS (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM doc),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM line),
host AS (SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source),
bad AS (SELECT k.source, k.k FROM (SELECT DISTINCT rid, source, k FROM keyed WHERE k <> '') k JOIN host h ON h.source = k.source
  GROUP BY k.source, k.k, h.pages HAVING count(*) >= 5 AND count(*) > 0.1 * h.pages),
marked AS (SELECT l.*, b.k IS NOT NULL AS gone FROM keyed l LEFT JOIN bad b ON b.source = l.source AND b.k = l.k),
clean AS (SELECT rid, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS text FROM marked GROUP BY rid)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NOT NULL THEN coalesce(c.text, '') END AS text,
  CAST(coalesce(c.n_dropped, 0) AS BIGINT) AS n_dropped FROM doc d LEFT JOIN clean c USING (rid)"""


@query
def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document; four folds of five are learned from."""
    docs = table(spark, sf_dir, "documents")
    return lattice_scores(docs, fold_of("doc_id", 5) == 1, tokenizer_path("piece_bpe_32k.model"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a classifier that learned from labelled rows of two folds of three."""
    docs, held_out = table(spark, sf_dir, "documents"), fold_of("doc_id", 3) == 1
    rows = training_rows(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out, most=toxicity.SAMPLE_ROWS)
    scored = toxicity.toxicity_scores(docs.select("doc_id", "text"), toxicity.train(rows))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of word-pair similarity 0.8 and more."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


LLM_ORACLES["op6_minhash"] = r"""
WITH RECURSIVE split AS (SELECT row_number() OVER () AS rid, doc_id, string_split(trim(regexp_replace(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(w[i : i + least(len(w), 2) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, CAST(greatest(len(w) - 1, 1) + 1 AS BIGINT))) AS i FROM split WHERE w <> [''])),
size AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
link AS (SELECT a.rid AS a, b.rid AS b FROM sh a JOIN sh b ON a.s = b.s AND a.rid < b.rid JOIN size x ON x.rid = a.rid JOIN size y ON y.rid = b.rid
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY a.rid, b.rid, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT rid AS a, rid AS b FROM split UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
comp AS (SELECT r.a AS rid, min(s.doc_id) AS component_id FROM reach r JOIN split s ON s.rid = r.b GROUP BY r.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM split JOIN comp USING (rid) LEFT JOIN size USING (rid)"""


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a classifier that learned from labelled rows of four folds of five."""
    docs, held_out = table(spark, sf_dir, "documents"), fold_of("doc_id", 5) == 0
    rows = training_rows(docs, table(spark, sf_dir, "labels"), "quality", ~held_out)
    scored = quality.quality_scores(docs.select("doc_id", "text"), quality.train(rows))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to the archive and read back; the facts are those of the records read."""
    records = read_records(spark, write_archive(table(spark, sf_dir, "pages")))
    return records.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((CAST('0x' || substr(h, {1 + 5 * (i // 4)}, 5) AS BIGINT) >> {15 - 5 * (i % 4)}) & 31) AS INTEGER), 1)"
    for i in range(32)
)
LLM_ORACLES["op8_warc_archive"] = f"""
WITH page AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
named AS (SELECT page_id, strlen(body) AS payload_bytes, {_BASE32} AS payload_digest, max(page_id) OVER (PARTITION BY body) AS keeper FROM page)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM named"""


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal without white space, over all documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))


LLM_ORACLES["op9_exact_dedup"] = r"""
WITH plain AS (SELECT doc_id, length(coalesce(text, '')) AS points,
  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
ranked AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM plain WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM ranked"""


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows inside all documents."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return contamination(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"""string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ')"""
LLM_ORACLES["op10_decontaminate"] = rf"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, w, CASE WHEN w = [''] THEN 0 ELSE len(w) END AS n
  FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
item AS (SELECT item_id, w, least(len(w), 13) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE w <> ['']),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS body
  FROM (SELECT *, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS i FROM item)),
lengths AS (SELECT DISTINCT m FROM win),
pos AS (SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS body
  FROM (SELECT rid, w, m, unnest(range(1, CAST(n - m + 2 AS BIGINT))) AS i FROM doc, lengths WHERE n >= m)),
hits AS (SELECT p.rid, p.i, p.m, win.item_id FROM pos p JOIN win USING (m, body)),
hit AS (SELECT rid, count(DISTINCT spot) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS spot FROM hits) GROUP BY rid),
own AS (SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n AS contaminated
FROM doc LEFT JOIN hit USING (rid) LEFT JOIN own USING (rid)"""


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 200-byte strings that occur again."""
    cut = suffix_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, and whether what became of its text still folds to the root."""
    docs = table(spark, sf_dir, "documents")
    altered = F.when(fold_of("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    nodes = docs.select("doc_id", "source", digest_of(*fields, F.col("text")).alias("leaf"), digest_of(*fields, altered).alias("now"))
    proven = merkle_proofs(nodes, "source", ["doc_id"], "leaf").withColumn("folded_root", fold(F.col("now"), F.col("path")))
    return proven.select(
        "doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over all documents."""
    return cross_tokenizer_alignment(
        table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    )
