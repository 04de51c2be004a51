"""Fixed schemas of the canonical tables, as DDL text."""

SOURCE = "page INT, row_start BIGINT, row_end BIGINT, excerpt STRING"
SOURCE_STRUCT = "STRUCT<page: INT, row_start: BIGINT, row_end: BIGINT, excerpt: STRING>"

CHUNKS = (
    "collection_id STRING, chunk_id BIGINT, text STRING, source STRING, file_type STRING, "
    "chunking STRING, page INT, pages ARRAY<INT>, row_start BIGINT, row_end BIGINT, n_tokens INT"
)
CHUNK_COLUMNS = [part.split()[0] for part in CHUNKS.split(", ")]
METADATA_COLUMNS = ["source", "file_type", "chunking", "page", "pages", "row_start", "row_end"]
LOCATION_COLUMNS = ["page", "row_start", "row_end"]

FORWARD = (
    "collection_id STRING, chunk_id BIGINT, dl INT, terms ARRAY<STRUCT<term: STRING, tf: INT>>"
)
POSTINGS = "collection_id STRING, term STRING, chunk_id BIGINT, tf INT, dl INT"
BLOCKS = "collection_id STRING, term STRING, block BIGINT, n BIGINT, max_tf INT, min_dl INT"
VECTORS = (
    "collection_id STRING, chunk_id BIGINT, embedding ARRAY<FLOAT>, embed_status INT, embed_error STRING"
)
QUESTIONS = "question_id STRING, collection_id STRING, question STRING, depth INT"
REJECTS = "id STRING, status_code INT, detail STRING"
FINDINGS = (
    "question_id STRING, round INT, ord INT, subquestion STRING, answer STRING, "
    f"sources ARRAY<{SOURCE_STRUCT}>, evidence_count INT, error STRING"
)
FINDING_COLUMNS = ["question_id", "round", "ord", "subquestion", "answer", "sources", "evidence_count", "error"]
SESSION_EVENTS = "session_id STRING, seq BIGINT, kind STRING, text STRING"
