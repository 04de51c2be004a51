"""SQL the registered queries are checked against, in the dialect of DuckDB."""

from __future__ import annotations

from checks.workload import BLOCKED, LANGUAGES, REFUSED
from evispan import constants as c
from evispan.functions.stopwords import PORTUGUESE
from evispan.functions.text import TERM, TOKEN, WHITESPACE_CLASS as WS
from evispan.operators.findings import BULLET
from evispan.sources.blocks import PIECE


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(x):
    return f"replace(strip_accents(lower({x})), 'ß', 'ss')"


def fold(x):
    return f"replace(lower({x}), 'ß', 'ss')"


def tokens(x):
    return f"regexp_extract_all({norm(x)}, {lit(TERM)})"


def n_tokens(x):
    return f"CAST(len(regexp_extract_all({x}, {lit(TOKEN)})) AS INTEGER)"


def strip(x):
    return f"regexp_replace({x}, {lit(f'^{WS}+|{WS}+$')}, '', 'g')"


def collapse(x):
    return f"trim(regexp_replace({x}, {lit(WS + '+')}, ' ', 'g'))"


def excerpt(x):
    return f"substring({collapse(x)}, 1, {c.EXCERPT_CHARS})"


STOP = ", ".join(lit(word) for word in PORTUGUESE.split())
LANG_LIST = ", ".join(lit(lang) for lang in LANGUAGES)

# Fragments of WITH clauses. Each starts from the tables or from fragments before it.
INDEX = f"""
tok AS (SELECT lang AS collection_id, doc_id AS chunk_id, unnest({tokens('text')}) AS term FROM documents WHERE length(text) > 0),
kept AS (SELECT * FROM tok WHERE term NOT IN ({STOP})),
chunk_len AS (SELECT d.lang AS collection_id, d.doc_id AS chunk_id, count(k.term) AS dl
  FROM documents d LEFT JOIN kept k ON k.chunk_id = d.doc_id WHERE length(d.text) > 0 GROUP BY ALL),
posts AS (SELECT p.collection_id, p.term, p.chunk_id, p.tf, l.dl FROM
  (SELECT collection_id, term, chunk_id, count(*) AS tf FROM kept GROUP BY ALL) p JOIN chunk_len l USING (collection_id, chunk_id)),
stats AS (SELECT collection_id, count(*) AS n_chunks, sum(dl) / count(*) AS avgdl FROM chunk_len GROUP BY ALL),
dfs AS (SELECT collection_id, term, count(*) AS df FROM posts GROUP BY ALL)"""

QUERIES = f"""
asked AS (SELECT concat(item_id, ':', lang) AS query_id, lang AS collection_id, text AS query,
  CAST(item_id % 3 + 1 AS INTEGER) AS depth FROM benchmark, (SELECT unnest([{LANG_LIST}]) AS lang))"""

WEIGHTS = f"""
qtok AS (SELECT query_id, collection_id, unnest({tokens('query')}) AS term FROM asked),
qterm AS (SELECT query_id, collection_id, term, count(*) AS qtf FROM qtok WHERE term NOT IN ({STOP}) GROUP BY ALL),
weights AS (SELECT q.*, s.avgdl, ln(1.0 + (s.n_chunks - coalesce(d.df, 0) + 0.5) / (coalesce(d.df, 0) + 0.5)) AS idf
  FROM qterm q JOIN stats s USING (collection_id) LEFT JOIN dfs d USING (collection_id, term)),
scores AS (SELECT w.query_id, w.collection_id, p.chunk_id,
  round(sum(w.qtf * w.idf * p.tf / (p.tf + {c.BM25_K1} * (1 - {c.BM25_B} + {c.BM25_B} * p.dl / w.avgdl))), 6) AS score
  FROM weights w JOIN posts p USING (collection_id, term) GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scores)
  WHERE rank <= {c.CANDIDATES})"""


def embedding(name, source, key):
    """Unit vectors ``(key, embedding)`` of a text column, as ``name``."""
    return f"""
{name}_tok AS (SELECT {key}, unnest({tokens('body')}) AS term FROM ({source})),
{name}_cnt AS (SELECT {key}, CAST(concat('0x', substr(md5(term), 1, 4)) AS INTEGER) % {c.EMBED_DIMS} AS dim, count(*) AS n FROM {name}_tok GROUP BY ALL),
{name}_len AS (SELECT {key}, sqrt(sum(n * n)) AS length FROM {name}_cnt GROUP BY ALL),
{name}_dim AS (SELECT {key}, dim, CAST(n / length AS FLOAT) AS weight FROM {name}_cnt JOIN {name}_len USING ({key})),
{name} AS (SELECT k.{key}, list(CAST(coalesce(d.weight, 0) AS DOUBLE) ORDER BY k.dim) AS embedding
  FROM (SELECT {key}, unnest(range({c.EMBED_DIMS})) AS dim FROM (SELECT {key} FROM ({source}))) k LEFT JOIN {name}_dim d ON d.{key} = k.{key} AND d.dim = k.dim
  GROUP BY ALL)"""


def near(where):
    return f"""
dist AS (SELECT q.query_id, q.collection_id, v.chunk_id, v.embedding, q.query_vector,
  round(greatest(list_dot_product(q.query_vector, q.query_vector) + list_dot_product(v.embedding, v.embedding)
    - 2 * list_dot_product(q.query_vector, v.embedding), 0), 6) AS distance
  FROM {where}),
near AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER) AS rank FROM dist)
  WHERE rank <= {c.FETCH_K})"""


VECTORS = (
    embedding("docvec", "SELECT doc_id, text AS body FROM documents", "doc_id")
    + ","
    + embedding("queryvec", "SELECT query_id, query AS body FROM asked", "query_id")
    + f""",
stored AS (SELECT d.lang AS collection_id, d.doc_id AS chunk_id, v.embedding FROM documents d JOIN docvec v USING (doc_id)),
askedvec AS (SELECT a.query_id, a.collection_id, v.embedding AS query_vector FROM asked a JOIN queryvec v USING (query_id)),"""
    + near("askedvec q JOIN stored v USING (collection_id)")
)


def mmr_steps():
    value = f"CAST({c.MMR_LAMBDA} AS DOUBLE) * n.rel - (1 - CAST({c.MMR_LAMBDA} AS DOUBLE)) * m.red"
    cosine = "round(CASE WHEN list_dot_product({0}, {0}) * list_dot_product({1}, {1}) > 0 THEN list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0}) * list_dot_product({1}, {1})) ELSE 0 END, 6)"
    parts = [
        f"rel AS (SELECT query_id, collection_id, chunk_id, embedding, {cosine.format('query_vector', 'embedding')} AS rel FROM near)",
        f"among AS (SELECT a.query_id, a.chunk_id, b.chunk_id AS other, {cosine.format('a.embedding', 'b.embedding')} AS sim FROM rel a JOIN rel b USING (query_id))",
        "pick1 AS (SELECT query_id, collection_id, chunk_id, 1 AS mmr_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, chunk_id) AS nr FROM rel) WHERE nr = 1)",
        "taken1 AS (SELECT * FROM pick1)",
    ]
    for step in range(2, c.CANDIDATES + 1):
        parts.append(
            f"""red{step} AS (SELECT a.query_id, a.chunk_id, max(a.sim) AS red FROM among a JOIN taken{step - 1} t ON t.query_id = a.query_id AND t.chunk_id = a.other GROUP BY ALL),
pick{step} AS (SELECT query_id, collection_id, chunk_id, {step} AS mmr_rank FROM (
  SELECT n.query_id, n.collection_id, n.chunk_id, row_number() OVER (PARTITION BY n.query_id ORDER BY {value} DESC, n.chunk_id) AS nr
  FROM rel n JOIN red{step} m ON m.query_id = n.query_id AND m.chunk_id = n.chunk_id
  WHERE NOT EXISTS (SELECT 1 FROM taken{step - 1} t WHERE t.query_id = n.query_id AND t.chunk_id = n.chunk_id)) WHERE nr = 1),
taken{step} AS MATERIALIZED (SELECT * FROM taken{step - 1} UNION ALL SELECT * FROM pick{step})"""
        )
    return ",\n".join(parts)


NO_PICKS = f"taken{c.CANDIDATES} AS (SELECT query_id, collection_id, chunk_id, 0 AS mmr_rank FROM hits WHERE false)"

FUSED = f"""
paths AS (SELECT query_id, collection_id, chunk_id, 0 AS origin, CAST(mmr_rank AS INTEGER) AS origin_rank FROM taken{c.CANDIDATES}
  UNION ALL SELECT query_id, collection_id, chunk_id, 1, rank FROM hits),
fused AS (SELECT * FROM (SELECT p.*, d.text, d.source, row_number() OVER (PARTITION BY p.query_id, d.text, d.source ORDER BY origin, origin_rank) AS copy
  FROM paths p JOIN documents d ON d.doc_id = p.chunk_id) WHERE copy = 1),
cand AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY origin, origin_rank) - 1 AS INTEGER) AS ord FROM fused)"""

RERANKED = f"""
wanted AS (SELECT query_id, sum(idf) AS total FROM weights GROUP BY ALL),
matched AS (SELECT k.query_id, k.ord, sum(w.idf) AS found FROM cand k JOIN weights w ON w.query_id = k.query_id
  JOIN posts p ON p.collection_id = w.collection_id AND p.term = w.term AND p.chunk_id = k.chunk_id GROUP BY ALL),
rated AS (SELECT k.*, coalesce(round(coalesce(m.found, 0) / t.total, 6), 0) AS rerank_score FROM cand k
  LEFT JOIN matched m USING (query_id, ord) LEFT JOIN wanted t USING (query_id)),
reranked AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, ord) AS INTEGER) AS rank FROM rated)
  WHERE rank <= {c.RERANK_TOP_N})"""

ANSWERED = f"""
answered AS (SELECT a.*, coalesce((SELECT concat('[{c.PAGE_LABEL}1] ', {excerpt('r.text')}) FROM reranked r WHERE r.query_id = a.query_id AND r.rank = 1), {lit(c.NO_EVIDENCE_ANSWER)}) AS answer,
  CAST((SELECT count(*) FROM reranked r WHERE r.query_id = a.query_id) AS INTEGER) AS n_sources FROM asked a)"""

HYBRID = ", ".join([QUERIES, INDEX, WEIGHTS, VECTORS, mmr_steps(), FUSED])
KEYWORD_ONLY = ", ".join([QUERIES, INDEX, WEIGHTS, NO_PICKS, FUSED, RERANKED])


def parse_plan(name, source):
    """Sub-questions ``(question_id, ord, query)`` of ``(question_id, question, output)``, as ``name``."""
    return f"""
{name}_line AS (SELECT question_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
  FROM (SELECT question_id, string_split(output, chr(10)) AS lines FROM {source})),
{name}_item AS (SELECT question_id, item, min(pos) AS pos FROM (SELECT question_id, pos, {strip(f"regexp_replace(line, {lit(BULLET)}, '')")} AS item FROM {name}_line)
  WHERE item <> '' AND NOT starts_with(lower(item), 'subperguntas') AND NOT starts_with(lower(item), 'perguntas:') GROUP BY ALL),
{name}_kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS ord FROM {name}_item) WHERE ord <= {c.MAX_SUBQUESTIONS}),
{name} AS (SELECT s.question_id, CAST(coalesce(k.ord, 1) AS INTEGER) AS ord, coalesce(k.item, s.question) AS query FROM {source} s LEFT JOIN {name}_kept k USING (question_id))"""


QUEUE = (
    QUERIES.replace("asked AS", "researched AS").replace("AS query_id", "AS question_id").replace("text AS query", "text AS question")
    + ", sentences AS (SELECT question_id, question, replace(question, '. ', chr(10)) AS output FROM researched),"
    + parse_plan("planned", "sentences")
    + f""",
queue AS (SELECT question_id, collection_id, 0 AS ord, question AS query, depth FROM researched
  UNION ALL SELECT p.question_id, r.collection_id, p.ord, p.query, r.depth FROM planned p JOIN researched r USING (question_id)
  WHERE {fold('p.query')} <> {fold('r.question')})"""
)


def searched(universe):
    """Answers of every distinct (collection, query) of ``universe``."""
    asked = f"asked AS (SELECT DISTINCT concat(collection_id, chr(10), query) AS query_id, collection_id, query FROM {universe})"
    return ", ".join([asked, INDEX, WEIGHTS, NO_PICKS, FUSED, RERANKED, ANSWERED])


FINDINGS = QUEUE + ", " + searched("queue") + """,
found AS (SELECT q.question_id, q.ord, q.query AS subquestion, a.answer, a.n_sources AS evidence_count, a.query_id
  FROM queue q JOIN answered a USING (collection_id, query))"""

TALK = f"""
paired AS (SELECT conv_id, turn, role, text, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS reply
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
found AS (SELECT CAST(conv_id AS VARCHAR) AS question_id, CAST(turn AS INTEGER) AS ord, text AS subquestion, reply,
  coalesce(reply, {lit(c.SEARCH_FAILED_ANSWER)}) AS answer, CASE WHEN reply IS NULL THEN {lit(c.SEARCH_FAILED_ERROR)} END AS error FROM paired WHERE role = 'user'),
talks AS (SELECT question_id, arg_min(subquestion, ord) AS question FROM found GROUP BY ALL),
all_talks AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS question_id FROM conversations UNION ALL SELECT DISTINCT concat('x', conv_id) FROM conversations)"""

TALK_PLANS = f"""
plans AS (SELECT t.question_id, t.question, concat('Subperguntas', chr(10), '1. ', lower(t.question), chr(10), chr(10), '- ', replace(v.reply, chr(10), chr(10) || ' 2) ')) AS output
  FROM talks t JOIN (SELECT CAST(conv_id AS VARCHAR) AS question_id, string_agg(text, chr(10) || chr(10) || '- ' ORDER BY turn, text) AS reply
    FROM conversations WHERE role = 'assistant' GROUP BY conv_id) v USING (question_id)),""" + parse_plan("subquestions", "plans")


def judged(questions):
    lacking = "list(subquestion ORDER BY ord) FILTER (WHERE reply IS NULL)"
    return f"""
sums AS (SELECT question_id, count(*) AS n, {lacking} AS lacking FROM found GROUP BY ALL),
judged AS (SELECT q.question_id, coalesce(s.n > 0 AND s.lacking IS NULL, false) AS is_sufficient,
  CASE WHEN s.n > 0 AND s.lacking IS NULL THEN {lit(c.SUFFICIENT_REASON)} ELSE {lit(c.INSUFFICIENT_REASON)} END AS reason,
  coalesce(list_slice(s.lacking, 1, {c.MAX_SUBQUESTIONS}), []) AS missing FROM {questions} q LEFT JOIN sums s USING (question_id))"""


def blocked_regex(term):
    folded = term.lower().replace("ß", "ss")
    return rf"(^|[^\p{{L}}\p{{N}}_]){folded}($|[^\p{{L}}\p{{N}}_])"


def is_blocked(x, terms=BLOCKED):
    return "(" + " OR ".join(f"regexp_matches({fold(x)}, {lit(blocked_regex(term))})" for term in terms) + ")"


def violations(x, name=c.CLARIFICATION_FIELD, most=c.MAX_CLARIFICATION_CHARS, terms=BLOCKED):
    return f"""list_filter([CASE WHEN {strip(x)} = '' THEN {lit(name + c.EMPTY_VIOLATION)} END,
  CASE WHEN length({x}) > {most} THEN '{name} excede o limite de {most} caracteres' END,
  CASE WHEN {is_blocked(x, terms)} THEN {lit(c.BLOCKED_VIOLATION)} END], lambda v: v IS NOT NULL)"""


DECIDED = f"""
sent AS (SELECT concat(conv_id, ':', turn) AS id, concat('  ', text, chr(10)) AS text FROM conversations),
decided AS (SELECT id, text, {violations('text')} AS found FROM sent)"""

DEFAULTS = "[" + ", ".join(lit(question) for question in c.DEFAULT_CLARIFICATIONS) + "]"

SESSIONS = TALK + f""",
opened AS (SELECT question_id AS session_id, question AS original, CASE WHEN length(question) < 200 THEN {DEFAULTS} ELSE [] END AS questions FROM talks),
events AS (SELECT session_id, seq, text, {violations('text')} AS found FROM (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, text FROM conversations WHERE turn > 0
  UNION ALL SELECT concat('x', conv_id), turn, text FROM conversations WHERE turn = 1)),
ranked AS (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS nth FROM events WHERE len(found) = 0),
outcome AS (SELECT e.session_id, e.seq, {strip('e.text')} AS answer,
  CASE WHEN o.session_id IS NULL THEN {c.UNKNOWN_SESSION[0]}
       WHEN len(o.questions) = 0 OR coalesce(e.seq > last.seq, false) THEN {c.SESSION_NOT_WAITING[0]} WHEN len(e.found) > 0 THEN 422 END AS status_code,
  CASE WHEN o.session_id IS NULL THEN {lit(c.UNKNOWN_SESSION[1])}
       WHEN len(o.questions) = 0 OR coalesce(e.seq > last.seq, false) THEN {lit(c.SESSION_NOT_WAITING[1])}
       WHEN len(e.found) > 0 THEN concat('Entrada rejeitada: ', array_to_string(e.found, '; '), '.') END AS detail, CAST(r.nth AS INTEGER) AS nth, o.session_id IS NOT NULL AS known, len(o.questions) AS n_questions
  FROM events e LEFT JOIN opened o USING (session_id) LEFT JOIN ranked r ON r.session_id = e.session_id AND r.seq = e.seq
  LEFT JOIN ranked last ON last.session_id = e.session_id AND last.nth = len(o.questions)),
states AS (SELECT o.session_id, o.original, o.questions, coalesce(list(x.answer ORDER BY x.seq) FILTER (WHERE x.status_code IS NULL AND x.seq IS NOT NULL), []) AS responses
  FROM opened o LEFT JOIN outcome x USING (session_id) GROUP BY ALL)"""

PACKED = f"""
doc_lines AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents)),
cut AS (SELECT doc_id, source, i, CASE WHEN {n_tokens('line')} <= {c.CHUNK_TOKENS} THEN [{strip('line')}]
  ELSE list_transform(range(0, CAST(ceil({n_tokens('line')} / {c.CHUNK_TOKENS}.0) AS BIGINT)), lambda k: {strip(f"array_to_string(list_slice(regexp_extract_all(line, {lit(PIECE)}), k * {c.CHUNK_TOKENS} + 1, (k + 1) * {c.CHUNK_TOKENS}), '')")}) END AS parts
  FROM doc_lines WHERE {strip('line')} <> ''),
cut_parts AS (SELECT doc_id, source, i, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM cut),
pieces AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM
  (SELECT doc_id, source, part, {n_tokens('part')} AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS pos FROM cut_parts)),
starts(doc_id, start, base, no) AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST(0 AS HUGEINT), CAST(0 AS BIGINT) FROM pieces
  UNION ALL SELECT doc_id, pos, upto - n, no + 1 FROM (
    SELECT p.doc_id, p.pos, p.upto, p.n, s.no, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.pos) AS nr
    FROM starts s JOIN pieces p ON p.doc_id = s.doc_id AND p.pos > s.start AND p.upto - s.base > {c.CHUNK_TOKENS}) WHERE nr = 1),
spans AS (SELECT doc_id, no, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY no), 9223372036854775807) AS stop FROM starts),
made AS (SELECT CAST(p.doc_id AS VARCHAR) AS collection_id, p.source, s.no AS chunk_id, string_agg(p.part, chr(10) ORDER BY p.pos) AS text, CAST(sum(p.n) AS INTEGER) AS n_tokens
  FROM pieces p JOIN spans s ON s.doc_id = p.doc_id AND p.pos >= s.start AND p.pos < s.stop GROUP BY p.doc_id, p.source, s.no)"""


def cte(*parts, select, recursive=False):
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}\n{select}"


STORE_SUMMARY = cte(
    INDEX,
    select="""SELECT s.collection_id, s.n_chunks, p.n_postings, v.n_vectors FROM stats s
  JOIN (SELECT collection_id, count(*) AS n_postings FROM posts GROUP BY ALL) p USING (collection_id)
  JOIN (SELECT lang AS collection_id, count(*) AS n_vectors FROM documents GROUP BY ALL) v USING (collection_id)""",
)
NULLS = "CAST(NULL AS INTEGER) AS status_code, CAST(NULL AS VARCHAR) AS detail"

def rounds(queue):
    """All rounds of the searches in ``queue``, as ``every``."""
    return queue + f""",
level1 AS (SELECT collection_id, concat({lit(c.REFINEMENT_PREFIX)}, query) AS query FROM queue),
level2 AS (SELECT collection_id, concat({lit(c.REFINEMENT_PREFIX)}, query) AS query FROM level1),
universe AS (SELECT collection_id, query FROM queue UNION SELECT * FROM level1 UNION SELECT * FROM level2), """ + searched("universe") + f""",
round1 AS (SELECT q.question_id, q.collection_id, q.depth, 1 AS round, q.ord, q.query, a.answer, a.n_sources FROM queue q JOIN answered a USING (collection_id, query)),
open1 AS (SELECT DISTINCT question_id FROM round1 WHERE n_sources = 0 AND depth > 1),
gaps1 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round, ord) AS gap FROM round1 WHERE n_sources = 0),
next2 AS (SELECT question_id, collection_id, depth, gap AS ord, concat({lit(c.REFINEMENT_PREFIX)}, query) AS query FROM gaps1 JOIN open1 USING (question_id) WHERE gap <= 4),
round2 AS (SELECT n.question_id, n.collection_id, n.depth, 2 AS round, n.ord, n.query, a.answer, a.n_sources FROM next2 n JOIN answered a USING (collection_id, query)
  WHERE NOT EXISTS (SELECT 1 FROM round1 r WHERE r.question_id = n.question_id AND r.query = n.query)),
first_two AS (SELECT * FROM round1 UNION ALL SELECT * FROM round2),
open2 AS (SELECT DISTINCT question_id FROM round2 WHERE depth > 2),
gaps2 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round, ord) AS gap FROM first_two WHERE n_sources = 0),
next3 AS (SELECT question_id, collection_id, depth, gap AS ord, concat({lit(c.REFINEMENT_PREFIX)}, query) AS query FROM gaps2 JOIN open2 USING (question_id) WHERE gap <= 4),
round3 AS (SELECT n.question_id, n.collection_id, n.depth, 3 AS round, n.ord, n.query, a.answer, a.n_sources FROM next3 n JOIN answered a USING (collection_id, query)
  WHERE NOT EXISTS (SELECT 1 FROM first_two r WHERE r.question_id = n.question_id AND r.query = n.query)),
every AS (SELECT * FROM first_two UNION ALL SELECT * FROM round3)"""


ROUNDS = rounds(QUEUE)

QUEUE_OF_SESSIONS = f"""
asked_for AS (SELECT session_id AS question_id, [{LANG_LIST}][CAST(session_id AS INTEGER) % {len(LANGUAGES)} + 1] AS collection_id, CAST(CAST(session_id AS INTEGER) % 3 + 1 AS INTEGER) AS depth,
  original, CASE WHEN len(questions) = 0 THEN original ELSE concat(original, chr(10), chr(10), {lit(c.CLARIFICATIONS_HEADER)}, chr(10),
  array_to_string(list_transform(range(1, len(responses) + 1), lambda i: concat('- ', questions[i], ': ', responses[i])), chr(10))) END AS question
  FROM states WHERE len(responses) = len(questions)),
planned_texts AS (SELECT question_id, question, replace(question, '. ', chr(10)) AS output FROM asked_for),""" + parse_plan("planned", "planned_texts") + f""",
queue AS (SELECT question_id, collection_id, 0 AS ord, original AS query, depth FROM asked_for
  UNION ALL SELECT p.question_id, r.collection_id, p.ord, p.query, r.depth FROM planned p JOIN asked_for r USING (question_id)
  WHERE {fold('p.query')} <> {fold('r.original')})"""
SESSION_ROUNDS = rounds(SESSIONS + "," + QUEUE_OF_SESSIONS)

# The report of every question, from the rows of all its rounds.
REPORTED = f"""ended AS (SELECT question_id, CAST(max(round) AS INTEGER) AS rounds_completed, NOT bool_or(n_sources = 0) AS is_sufficient,
  list(query ORDER BY round, ord) FILTER (WHERE n_sources = 0) AS lacking,
  string_agg(concat(query, ': ', answer), chr(10) || chr(10) ORDER BY round, ord) FILTER (WHERE n_sources > 0) AS body FROM every GROUP BY ALL),
same AS (SELECT question_id, min(round * 1000 + ord) AS first, string_agg(query, '; ' ORDER BY round, ord) AS queries FROM (SELECT *, lower({collapse('answer')}) AS key FROM every)
  WHERE length(key) > {c.REPEATED_ANSWER_CHARS} GROUP BY question_id, key HAVING count(*) > 1),
conflict AS (SELECT question_id, string_agg(queries, '|' ORDER BY first) AS conflicts FROM same GROUP BY ALL),
cited AS (SELECT e.question_id, count(DISTINCT {excerpt('r.text')}) AS n FROM every e JOIN answered a USING (collection_id, query) JOIN reranked r ON r.query_id = a.query_id GROUP BY ALL),
written AS (SELECT *, CASE WHEN body IS NULL THEN {lit(c.NO_EVIDENCE_REPORT)} WHEN lacking IS NULL THEN body
  ELSE concat(body, chr(10), chr(10), {lit(c.LIMITATIONS_PREFIX)}, array_to_string(list_slice(lacking, 1, 4), '; ')) END AS answer FROM ended)"""

TALK_LABELS = """array_to_string(list_transform(range(1, len(string_split(reply, chr(10))) + 1), lambda j:
  CASE WHEN j % 2 = 1 THEN concat('página ', j) WHEN j % 4 = 2 THEN concat('linha ', j) ELSE concat('linhas ', j, '-', j + 2) END), ', ')"""

ORACLES = {
    "admission_filter": f"""SELECT concat('/in/', source, '/', doc_id, ext) AS id,
  CASE WHEN lower(ext) NOT IN ('.pdf', '.csv') THEN 415 WHEN n_chars * 8000 > {c.MAX_FILE_BYTES} THEN 413 END AS status_code,
  CASE WHEN lower(ext) NOT IN ('.pdf', '.csv') THEN {lit(c.UNSUPPORTED_FILE[1])} WHEN n_chars * 8000 > {c.MAX_FILE_BYTES} THEN {lit(c.FILE_TOO_LARGE[1])} END AS detail
  FROM (SELECT *, CASE lang WHEN 'en' THEN '.PDF' WHEN 'fr' THEN '.csv' WHEN 'de' THEN '.txt' ELSE '.Csv' END AS ext FROM documents)""",
    "csv_rows_ingest": f"""WITH placed AS (SELECT *, c_custkey // 500 AS part, CAST(1 + row_number() OVER w + coalesce(sum(CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END)
    OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS n FROM customer WINDOW w AS (PARTITION BY c_custkey // 500 ORDER BY c_custkey)),
  written AS (SELECT part, n, concat('Linha ', n, chr(10), 'name: ', c_name, chr(10), 'segment: ', c_mktsegment, chr(10), 'segment_2: ', c_nationkey, chr(10), 'x', chr(10), 'coluna_4: ') AS text FROM placed)
  SELECT concat('customers-', part, '.csv') AS source, CAST(n AS BIGINT) AS chunk_id, CAST(n AS BIGINT) AS row_start, CAST(n AS BIGINT) AS row_end, text, {n_tokens('text')} AS n_tokens FROM written""",
    "uploads_profile": cte(
        PACKED,
        f"""placed AS (SELECT *, c_custkey // 500 AS part, CAST(1 + row_number() OVER w + coalesce(sum(CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END)
    OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS n FROM customer WINDOW w AS (PARTITION BY c_custkey // 500 ORDER BY c_custkey)),
  firsts AS (SELECT coalesce(text, '') AS text, min(concat(doc_id, '.pdf')) AS id FROM documents GROUP BY ALL),
  pieces_of AS (SELECT f.id, 'pdf' AS file_type, m.text, m.n_tokens FROM made m JOIN firsts f ON f.id = concat(m.collection_id, '.pdf') WHERE length(f.text) % 50 <> 0
    UNION ALL SELECT concat('customers-', part, '.csv'), 'csv', body, {n_tokens('body')} FROM (SELECT part, concat('Linha ', n, chr(10), 'name: ', c_name, chr(10),
      'segment: ', c_mktsegment, chr(10), 'segment_2: ', c_nationkey, chr(10), 'x', chr(10), 'coluna_4: ') AS body FROM placed)),
  refused AS (SELECT concat('/in/', doc_id, '.pdf') AS id, CASE WHEN length(coalesce(text, '')) % 50 = 0 THEN {c.PDF_UNREADABLE[0]} ELSE {c.PDF_NO_CONTENT[0]} END AS status_code,
      CASE WHEN length(coalesce(text, '')) % 50 = 0 THEN {lit(c.PDF_UNREADABLE[1])} ELSE {lit(c.PDF_NO_CONTENT[1])} END AS detail
      FROM documents WHERE length(coalesce(text, '')) % 50 = 0 OR CAST(doc_id AS VARCHAR) NOT IN (SELECT collection_id FROM made)
    UNION ALL SELECT concat('/in/', n_name, '.csv'), {c.CSV_NO_ROWS[0]}, {lit(c.CSV_NO_ROWS[1])} FROM nation
    UNION ALL SELECT concat('/in/', r_name, '.txt'), {c.UNSUPPORTED_FILE[0]}, {lit(c.UNSUPPORTED_FILE[1])} FROM region
    UNION ALL SELECT concat('/in/', s_suppkey, '.large.pdf'), {c.FILE_TOO_LARGE[0]}, {lit(c.FILE_TOO_LARGE[1])} FROM supplier)""",
        select="""SELECT id, file_type, CASE WHEN file_type = 'pdf' THEN 1 END AS pages, CASE WHEN file_type = 'csv' THEN CAST(count(*) AS INTEGER) END AS rows, count(*) AS chunks,
  min(n_tokens) AS minimum_chunk_tokens, CAST(round_even(avg(n_tokens), 0) AS BIGINT) AS average_chunk_tokens, max(n_tokens) AS maximum_chunk_tokens,
  CAST(round_even(avg(length(text)), 0) AS BIGINT) AS average_chunk_characters, CAST(NULL AS INTEGER) AS status_code, CAST(NULL AS VARCHAR) AS detail FROM pieces_of GROUP BY id, file_type
  UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, status_code, detail FROM refused""",
        recursive=True,
    ),
    "token_counts_pieces": """SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\p{M}\\p{Z}\\p{C}]'),
  lambda t: (length(t) + 3) // 4)), 0) AS INTEGER) AS n_tokens FROM documents""",
    "header_normalize": f"""WITH cells AS (SELECT concat(conv_id, ':', turn) AS file_id, unnest(parts) AS value, CAST(generate_subscripts(parts, 1) AS INTEGER) AS pos
    FROM (SELECT conv_id, turn, string_split(text, ' ') AS parts FROM conversations)),
  based AS (SELECT file_id, pos, coalesce(nullif({strip('value')}, ''), concat('coluna_', pos)) AS base FROM cells),
  counted AS (SELECT *, row_number() OVER (PARTITION BY file_id, base ORDER BY pos) AS nth FROM based)
  SELECT file_id, pos, CASE WHEN nth = 1 THEN base ELSE concat(base, '_', nth) END AS name FROM counted""",
    "row_chunks": f"""WITH placed AS (SELECT *, CAST(1 + row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS INTEGER) AS n FROM orders),
  written AS (SELECT o_orderstatus AS collection_id, n, concat('Linha ', n, chr(10), 'o_orderkey: ', o_orderkey, chr(10), 'o_orderpriority: ', {strip('o_orderpriority')}, chr(10), 'o_custkey: ', o_custkey) AS text FROM placed)
  SELECT collection_id, CAST(n AS BIGINT) AS chunk_id, text, CAST(n AS BIGINT) AS row_start, CAST(n AS BIGINT) AS row_end, {n_tokens('text')} AS n_tokens FROM written""",
    "chunk_documents": cte(PACKED, select="SELECT collection_id, chunk_id, text, n_tokens FROM made", recursive=True),
    "chunk_blocks": cte(PACKED, select="SELECT collection_id, chunk_id, text, n_tokens FROM made", recursive=True),
    "chunk_pages": """SELECT doc_id, CAST(greatest(min(page) - 1, 0) AS INTEGER) AS page, string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS INTEGER)) AS pages FROM (
  SELECT doc_id, (i - 1) // 4 + doc_id % 3 AS page FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) GROUP BY doc_id""".replace(
        "string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS INTEGER))", "array_to_string(list_transform(list_sort(list_distinct(list(page))), lambda p: CAST(p AS VARCHAR)), ',')"
    ),
    "token_counts": f"SELECT doc_id, {n_tokens('text')} AS n_tokens FROM documents",
    "document_profile": cte(
        PACKED,
        select=f"""SELECT collection_id, source, 'pdf' AS file_type, 'docling_hybrid' AS chunking, 1 AS pages, count(*) AS chunks, {c.CHUNK_TOKENS} AS max_tokens_per_chunk,
  min(n_tokens) AS minimum_chunk_tokens, CAST(round_even(avg(n_tokens), 0) AS BIGINT) AS average_chunk_tokens, max(n_tokens) AS maximum_chunk_tokens,
  CAST(round_even(avg(length(text)), 0) AS BIGINT) AS average_chunk_characters FROM made GROUP BY collection_id, source""",
        recursive=True,
    ),
    "embed_chunks": cte(
        embedding("docvec", "SELECT doc_id, text AS body FROM documents", "doc_id"),
        select="SELECT d.lang AS collection_id, v.doc_id AS chunk_id, CAST(v.dim AS INTEGER) AS dim, round(CAST(v.weight AS DOUBLE), 6) AS weight FROM docvec_dim v JOIN documents d USING (doc_id)",
    ),
    "index_build": STORE_SUMMARY,
    "repeated_upload": f"""WITH held AS (SELECT lang AS collection_id, doc_id AS chunk_id, CASE WHEN lang = 'es' THEN concat('3 ', text) ELSE text END AS text
    FROM documents WHERE lang NOT IN ('de', 'fr') OR doc_id % 2 = 0),
  words AS (SELECT collection_id, chunk_id, unnest({tokens('text')}) AS term FROM held WHERE length(text) > 0),
  counts AS (SELECT collection_id, chunk_id, count(*) AS n_terms FROM words WHERE term NOT IN ({STOP}) GROUP BY ALL)
  SELECT h.*, c.n_terms FROM held h LEFT JOIN counts c USING (collection_id, chunk_id)""",
    "stream_ingest": STORE_SUMMARY,
    "known_collections": """SELECT concat(conv_id, ':', turn) AS question_id, concat('src', conv_id % 25) AS collection_id FROM conversations
  WHERE role = 'user' AND concat('src', conv_id % 25) IN (SELECT source FROM documents)""",
    "unknown_collections": f"""SELECT concat(conv_id, ':', turn) AS id, {c.UNKNOWN_COLLECTION[0]} AS status_code, {lit(c.UNKNOWN_COLLECTION[1])} AS detail FROM conversations
  WHERE role = 'user' AND concat('src', conv_id % 25) NOT IN (SELECT source FROM documents)""",
    "normalize_text": f"SELECT doc_id, {norm('text')} AS normalized FROM documents",
    "tokenize": f"SELECT doc_id, array_to_string({tokens('text')}, ' ') AS tokens, CAST(len({tokens('text')}) AS INTEGER) AS n_tokens FROM documents",
    "stopword_filter": f"""SELECT doc_id, array_to_string(kept, ' ') AS tokens, CAST(len(kept) AS INTEGER) AS n_tokens FROM (
  SELECT doc_id, list_filter({tokens('text')}, lambda t: NOT list_contains([{STOP}], t)) AS kept FROM documents)""",
    "excerpt": f"SELECT doc_id, {excerpt('text')} AS excerpt FROM documents",
    "location_label": """WITH placed AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN l_linenumber END AS a,
    CASE WHEN l_linestatus = 'O' THEN l_linenumber + CAST(l_quantity AS INTEGER) % 3 WHEN l_returnflag = 'A' THEN 0 END AS b, CASE WHEN l_tax > 0.02 THEN l_suppkey END AS page FROM lineitem)
  SELECT l_orderkey, l_linenumber,
    CASE WHEN a IS NULL THEN concat('Página ', coalesce(page, 0) + 1) WHEN coalesce(b, a) = a THEN concat('Linha ', a) ELSE concat('Linhas ', a, '-', b) END AS chunk_label,
    CASE WHEN a IS NULL THEN concat('página ', coalesce(CAST(page AS VARCHAR), 'none')) WHEN coalesce(nullif(b, 0), a) = a THEN concat('linha ', a) ELSE concat('linhas ', a, '-', b) END AS source_label FROM placed""",
    "parse_subquestions": cte(TALK, TALK_PLANS, select="SELECT question_id, ord, query FROM subquestions"),
    "short_summary": f"SELECT doc_id, substring(string_split(text, chr(10))[1], 1, {c.SUMMARY_CHARS}) AS summary FROM documents",
    "postings": cte(INDEX, select="SELECT collection_id, term, chunk_id, CAST(tf AS INTEGER) AS tf, CAST(dl AS INTEGER) AS dl FROM posts"),
    "collection_stats": cte(INDEX, select="SELECT collection_id, n_chunks, round(avgdl, 6) AS avgdl FROM stats"),
    "term_df": cte(INDEX, select="SELECT * FROM dfs"),
    "bm25_scores": cte(QUERIES, INDEX, WEIGHTS, select="SELECT * FROM scores"),
    "keyword_topk": cte(QUERIES, INDEX, WEIGHTS, select="SELECT * FROM hits"),
    "keyword_topk_pruned": cte(QUERIES, INDEX, WEIGHTS, select="SELECT * FROM hits"),
    "vector_topk": cte(QUERIES, VECTORS, select="SELECT query_id, collection_id, chunk_id, distance, rank FROM near"),
    "vector_topk_blocks": cte(QUERIES, VECTORS, select="SELECT query_id, collection_id, chunk_id, distance, rank FROM near"),
    "vector_cells": cte(QUERIES, VECTORS, select="SELECT query_id, collection_id, chunk_id, distance, rank FROM near"),
    "label_neighbours": cte(
        """dims AS (SELECT label, unnest(embedding) AS value, generate_subscripts(embedding, 1) AS dim FROM embeddings),
means AS (SELECT label, dim, round(CAST(sum(CAST(value AS DECIMAL(20, 12))) AS DOUBLE) / count(*), 6) AS mean FROM dims GROUP BY ALL),
askedvec AS (SELECT CAST(label AS VARCHAR) AS query_id, 'all' AS collection_id, list(CAST(CAST(mean AS FLOAT) AS DOUBLE) ORDER BY dim) AS query_vector FROM means GROUP BY label),
stored AS (SELECT 'all' AS collection_id, vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)""",
        near("askedvec q JOIN stored v USING (collection_id)"),
        select="SELECT query_id, chunk_id, distance, rank FROM near",
    ),
    "mmr_select": cte(QUERIES, VECTORS, mmr_steps(), select=f"SELECT query_id, collection_id, chunk_id, CAST(mmr_rank AS INTEGER) AS mmr_rank FROM taken{c.CANDIDATES}"),
    "hybrid_candidates": cte(HYBRID, select="SELECT query_id, ord, chunk_id, CAST(origin AS INTEGER) AS origin, origin_rank FROM cand"),
    "rerank_topn": cte(HYBRID, RERANKED, select="SELECT query_id, rank, chunk_id, rerank_score FROM reranked"),
    "rerank_validate": cte(
        KEYWORD_ONLY,
        """results AS (SELECT query_id, ord + 1 AS result_ord, CASE WHEN ord % 5 <> 4 THEN ord * 3 - 4 + CASE WHEN collection_id = 'es' THEN 20 ELSE 0 END END AS nr, ord * 0.25 AS score FROM cand),
good AS (SELECT k.query_id, CAST(row_number() OVER (PARTITION BY k.query_id ORDER BY r.result_ord) AS INTEGER) AS rank, k.chunk_id, CAST(r.score AS DOUBLE) AS rerank_score FROM cand k JOIN results r ON r.query_id = k.query_id AND r.nr = k.ord)""",
        select=f"""SELECT query_id, rank, chunk_id, rerank_score, CAST(NULL AS INTEGER) AS status_code FROM good
  UNION ALL SELECT DISTINCT query_id, CAST(NULL AS INTEGER), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), {c.RERANK_NO_DOCUMENTS[0]} FROM cand WHERE query_id NOT IN (SELECT query_id FROM good)""",
    ),
    "sources": cte(
        KEYWORD_ONLY,
        select=f"SELECT query_id, rank, chunk_id, 1 AS page, CAST(NULL AS BIGINT) AS row_start, CAST(NULL AS BIGINT) AS row_end, {excerpt('text')} AS excerpt, rerank_score FROM reranked",
    ),
    "answer_context": cte(KEYWORD_ONLY, select="SELECT query_id, string_agg(concat('[Página 1]', chr(10), text), chr(10) || chr(10) ORDER BY rank) AS context FROM reranked GROUP BY query_id"),
    "quick_answer": cte(
        HYBRID, RERANKED, ANSWERED,
        select=f"SELECT query_id, answer, n_sources, coalesce((SELECT string_agg({excerpt('r.text')}, chr(10) ORDER BY rank) FROM reranked r WHERE r.query_id = answered.query_id), '') AS excerpts FROM answered",
    ),
    "stream_questions": cte(HYBRID, RERANKED, ANSWERED, select="SELECT query_id, answer, n_sources FROM answered"),
    "request_validation": f"""WITH sent AS (SELECT concat(conv_id, ':', turn) AS id, CASE WHEN conv_id % 7 = 0 THEN substring(text, 1, 2) ELSE text END AS question,
    coalesce(CASE WHEN turn <> 2 THEN CAST(turn AS INTEGER) END, {c.DEFAULT_DEPTH}) AS depth FROM conversations WHERE role = 'user')
  SELECT id, CASE WHEN length(question) >= 3 AND depth BETWEEN 1 AND 3 THEN depth END AS depth, CASE WHEN NOT (length(question) >= 3 AND depth BETWEEN 1 AND 3) THEN 422 END AS status_code,
    CASE WHEN length(question) < 3 THEN 'question' WHEN depth NOT BETWEEN 1 AND 3 THEN 'depth' END AS detail FROM sent""",
    "request_outcomes": cte(
        f"""requests AS (SELECT concat(conv_id, ':', turn) AS id, [{LANG_LIST}, 'xx'][conv_id % 5 + 1] AS collection_id, CASE WHEN conv_id % 7 = 0 THEN substring(text, 1, 2) ELSE text END AS question
  FROM conversations WHERE role = 'user'),
checked AS (SELECT *, {violations('question', c.QUESTION_FIELD, c.MAX_QUESTION_CHARS, REFUSED)} AS broken FROM requests),
decided AS (SELECT *, CASE WHEN length(question) < 3 OR len(broken) > 0 THEN 422 WHEN collection_id NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL AND length(text) > 0) THEN {c.UNKNOWN_COLLECTION[0]} ELSE 200 END AS status_code FROM checked),
passed AS (SELECT collection_id, {strip('question')} AS query FROM decided WHERE status_code = 200), """ + searched("passed"),
        select=f"""SELECT d.id, CAST(d.status_code AS INTEGER) AS status_code, CASE WHEN length(d.question) < 3 THEN 'question' WHEN len(d.broken) > 0 THEN concat('Entrada rejeitada: ', array_to_string(d.broken, '; '), '.')
    WHEN d.status_code = 404 THEN {lit(c.UNKNOWN_COLLECTION[1])} END AS detail, a.answer, coalesce(a.n_sources, 0) AS n_sources
  FROM decided d LEFT JOIN answered a ON d.status_code = 200 AND a.collection_id = d.collection_id AND a.query = {strip('d.question')}""",
    ),
    "guardrail_length": f"SELECT doc_id, {strip('t')} = '' AS is_empty, length(t) > 2000 AS is_too_long FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN concat(' ', chr(9), chr(10)) ELSE text END AS t FROM documents)",
    "blocked_terms": " UNION ALL ".join(f"SELECT doc_id, {lit(term)} AS term FROM documents WHERE regexp_matches({fold('text')}, {lit(blocked_regex(term))})" for term in BLOCKED),
    "blocked_terms_long": f"""WITH term AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{{4,}}')) AS term FROM benchmark),
  word AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all({fold('text')}, '[\\p{{L}}\\p{{N}}_]+')) AS term FROM documents)
  SELECT doc_id, CAST(count(*) AS INTEGER) AS n_terms, string_agg(term, ',' ORDER BY term) AS terms FROM word JOIN term USING (term) GROUP BY doc_id""",
    "guardrail_decision": cte(DECIDED, select=f"SELECT id, len(found) = 0 AS allowed, CASE WHEN len(found) = 0 THEN {lit(c.ALLOWED_REASON)} ELSE array_to_string(found, '; ') END AS reason, CAST(len(found) AS INTEGER) AS n_violations FROM decided"),
    "guardrail_enforce": cte(
        DECIDED,
        select=f"""SELECT id, CASE WHEN len(found) = 0 THEN {strip('text')} END AS text, CASE WHEN len(found) > 0 THEN 422 END AS status_code,
  CASE WHEN len(found) > 0 THEN concat('Entrada rejeitada: ', array_to_string(found, '; '), '.') END AS detail FROM decided""",
    ),
    "blocked_term_list": f"""WITH lists AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN string_split(text, ',') WHEN role = 'assistant' THEN string_split(text, '. ') END AS raw FROM conversations),
  cleaned AS (SELECT conv_id, turn, list_filter(list_transform(raw, lambda t: {strip('t')}), lambda t: t <> '') AS terms FROM lists)
  SELECT conv_id, turn, CASE WHEN terms IS NULL THEN NULL ELSE CAST(len(terms) AS INTEGER) END AS n_terms, array_to_string(terms, '|') AS terms FROM cleaned""",
    "unsupported": cte(TALK, select="SELECT question_id, 1 AS round, ord, subquestion FROM found WHERE reply IS NULL"),
    "repeated_answers": cte(
        FINDINGS,
        select=f"""SELECT question_id, CAST(min(ord) AS INTEGER) AS first_ord, string_agg(subquestion, '; ' ORDER BY ord) AS subquestions FROM (SELECT *, lower({collapse('answer')}) AS key FROM found)
  WHERE length(key) > {c.REPEATED_ANSWER_CHARS} GROUP BY question_id, key HAVING count(*) > 1""",
    ),
    "follow_ups": cte(TALK, select=f"SELECT question_id, ord, concat({lit(c.FOLLOW_UP_PREFIX)}, subquestion) AS follow_up FROM found WHERE reply IS NULL"),
    "dedupe_sources": cte(
        FINDINGS,
        f"""cited AS (SELECT f.question_id, f.ord, r.rank, {excerpt('r.text')} AS excerpt FROM found f JOIN reranked r USING (query_id)),
firsts AS (SELECT question_id, excerpt, min(ord * 100 + rank) AS first FROM cited GROUP BY ALL)""",
        select="SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY first) AS INTEGER) AS ord, 1 AS page, CAST(NULL AS BIGINT) AS row_start, CAST(NULL AS BIGINT) AS row_end, excerpt FROM firsts",
    ),
    "initial_queue": cte(
        TALK, TALK_PLANS,
        select=f"""SELECT question_id, 0 AS ord, question AS query, {lit(c.ORIGINAL_REASON)} AS reason FROM talks
  UNION ALL SELECT s.question_id, s.ord, s.query, {lit(c.PLANNED_REASON)} FROM subquestions s JOIN talks t USING (question_id) WHERE {fold('s.query')} <> {fold('t.question')}""",
    ),
    "unseen_queries": """WITH users AS (SELECT CAST(conv_id AS VARCHAR) AS question_id, turn, text AS query FROM conversations WHERE role = 'user'),
  talks AS (SELECT question_id, arg_min(query, turn) AS question FROM users GROUP BY question_id),
  searches AS (SELECT * FROM users UNION ALL SELECT question_id, turn, lower(query) FROM users)
  SELECT * FROM searches s WHERE NOT EXISTS (SELECT 1 FROM talks t WHERE t.question_id = s.question_id AND t.question = s.query)""",
    "findings": cte(FINDINGS, select="SELECT question_id, CAST(ord AS INTEGER) AS ord, subquestion, answer, evidence_count, CAST(NULL AS VARCHAR) AS error FROM found"),
    "format_findings": cte(
        TALK,
        select=f"""SELECT q.question_id, coalesce(string_agg(concat('Subpergunta: ', f.subquestion, chr(10), 'Resposta: ', f.answer, chr(10), 'Fontes: ',
    CASE WHEN f.reply IS NULL THEN 'nenhuma' ELSE {TALK_LABELS} END, chr(10), 'Erro: ', coalesce(f.error, 'nenhum')), chr(10) || chr(10) ORDER BY f.ord) FILTER (WHERE f.question_id IS NOT NULL), {lit(c.NO_FINDINGS)}) AS findings_text
  FROM all_talks q LEFT JOIN found f USING (question_id) GROUP BY q.question_id""",
    ),
    "sufficiency": cte(TALK, judged("all_talks"), select="SELECT question_id, is_sufficient, reason, array_to_string(missing, ' | ') AS missing FROM judged"),
    "refinement_dedupe": f"""WITH split AS (SELECT CAST(conv_id AS VARCHAR) AS question_id, turn, unnest(lines) AS query, generate_subscripts(lines, 1) - 1 AS pos FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS lines FROM conversations)),
  planned AS (SELECT question_id, turn * 10000 + pos AS plan_ord, query FROM split UNION ALL SELECT question_id, turn * 10000 + pos + 5000, lower(query) FROM split),
  fresh AS (SELECT p.question_id, p.query, p.plan_ord, row_number() OVER (PARTITION BY p.question_id, {fold('p.query')} ORDER BY p.plan_ord) AS copy FROM planned p
    WHERE NOT EXISTS (SELECT 1 FROM split e WHERE e.pos = 0 AND e.question_id = p.question_id AND {fold('e.query')} = {fold('p.query')})),
  numbered AS (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY plan_ord) AS INTEGER) AS ord, query FROM fresh WHERE copy = 1)
  SELECT * FROM numbered WHERE ord <= {c.MAX_SUBQUESTIONS}""",
    "refinement_fallback": cte(
        TALK, judged("talks"),
        "gaps AS (SELECT j.question_id, CASE WHEN len(j.missing) > 0 THEN j.missing ELSE [t.question] END AS gaps FROM judged j JOIN talks t USING (question_id))",
        select=f"SELECT question_id, ord, concat({lit(c.REFINEMENT_PREFIX)}, gap) AS query, {lit(c.REFINEMENT_REASON)} AS reason FROM (SELECT question_id, unnest(gaps) AS gap, CAST(generate_subscripts(gaps, 1) AS INTEGER) AS ord FROM gaps)",
    ),
    "research_rounds": cte(
        ROUNDS,
        """ended AS (SELECT question_id, CAST(max(round) AS INTEGER) AS rounds_completed, NOT bool_or(n_sources = 0) AS is_sufficient FROM every GROUP BY ALL)""",
        select="SELECT e.question_id, CAST(e.round AS INTEGER) AS round, e.query AS subquestion, e.answer, e.n_sources AS evidence_count, d.rounds_completed, d.is_sufficient FROM every e JOIN ended d USING (question_id)",
    ),
    "research_report": cte(
        ROUNDS,
        REPORTED,
        select=f"""SELECT w.question_id, w.answer, substring(string_split(w.answer, chr(10) || chr(10))[1], 1, {c.SUMMARY_CHARS}) AS short_summary, w.rounds_completed, w.is_sufficient,
  CAST(coalesce(i.n, 0) AS INTEGER) AS n_sources, coalesce(array_to_string(list_transform(w.lacking, lambda q: concat({lit(c.FOLLOW_UP_PREFIX)}, q)), '|'), '') AS follow_ups, coalesce(x.conflicts, '') AS conflicts
  FROM written w LEFT JOIN cited i USING (question_id) LEFT JOIN conflict x USING (question_id)""",
    ),
    "report_fallback": cte(
        TALK, judged("talks"),
        f"bodies AS (SELECT question_id, string_agg(concat(subquestion, ': ', answer), chr(10) || chr(10) ORDER BY ord) AS body FROM found WHERE reply IS NOT NULL GROUP BY ALL)",
        select=f"""SELECT j.question_id, CASE WHEN b.body IS NULL THEN {lit(c.NO_EVIDENCE_REPORT)} WHEN j.is_sufficient THEN b.body
    ELSE concat(b.body, chr(10), chr(10), {lit(c.LIMITATIONS_PREFIX)}, CASE WHEN len(j.missing) > 0 THEN array_to_string(j.missing, '; ') ELSE j.reason END) END AS report FROM judged j LEFT JOIN bodies b USING (question_id)""",
    ),
    "clarification_questions": cte(SESSIONS, select="SELECT session_id, unnest(questions) AS question, CAST(generate_subscripts(questions, 1) - 1 AS INTEGER) AS pos FROM opened"),
    "answer_outcomes": cte(SESSIONS, select="SELECT session_id, seq, status_code, detail, CASE WHEN status_code IS NULL THEN nth END AS answer_no FROM outcome"),
    "session_states": cte(
        SESSIONS,
        select="""SELECT session_id, CASE WHEN len(responses) < len(questions) THEN 'awaiting_clarification' WHEN CAST(session_id AS INTEGER) % 2 = 0 THEN 'completed' ELSE 'researching' END AS status,
  CAST(len(responses) AS INTEGER) AS n_responses, array_to_string(responses, '|') AS responses FROM states""",
    ),
    "enriched_query": cte(
        SESSIONS,
        select=f"""SELECT session_id, CASE WHEN len(questions) = 0 THEN original ELSE concat(original, chr(10), chr(10), {lit(c.CLARIFICATIONS_HEADER)}, chr(10),
  array_to_string(list_transform(range(1, len(responses) + 1), lambda i: concat('- ', questions[i], ': ', responses[i])), chr(10))) END AS query FROM states""",
    ),
    "session_lookup": f"""WITH latest AS (SELECT CAST(conv_id AS VARCHAR) AS id, max(turn) AS seq, arg_max(role, turn) AS status FROM conversations GROUP BY conv_id)
  SELECT CAST(d.doc_id AS VARCHAR) AS id, l.seq, l.status, CASE WHEN l.id IS NULL THEN {c.UNKNOWN_SESSION[0]} END AS status_code FROM documents d LEFT JOIN latest l ON l.id = CAST(d.doc_id AS VARCHAR)""",
    "session_research": cte(
        SESSION_ROUNDS,
        REPORTED,
        select=f"""SELECT s.session_id, CASE WHEN len(s.responses) < len(s.questions) THEN 'awaiting_clarification' ELSE 'completed' END AS status, CAST(len(s.responses) AS INTEGER) AS n_responses,
  w.answer, substring(string_split(w.answer, chr(10) || chr(10))[1], 1, {c.SUMMARY_CHARS}) AS short_summary, w.rounds_completed, w.is_sufficient,
  CASE WHEN w.question_id IS NOT NULL THEN CAST(coalesce(i.n, 0) AS INTEGER) END AS n_sources
  FROM states s LEFT JOIN written w ON w.question_id = s.session_id LEFT JOIN cited i ON i.question_id = s.session_id""",
    ),
    "session_stream": cte(
        SESSIONS,
        select="""SELECT session_id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS INTEGER) AS status_code, 0 AS n_responses FROM opened
  UNION ALL SELECT x.session_id, x.seq, x.status_code, CASE WHEN x.known THEN CAST((SELECT count(*) FROM outcome y WHERE y.session_id = x.session_id AND y.seq <= x.seq AND y.status_code IS NULL) AS INTEGER) END FROM outcome x""",
    ),
}
