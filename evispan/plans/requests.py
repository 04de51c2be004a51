"""Requests to outcomes: validation, guardrail, collection lookup and answer as one plan with one row per request."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evispan.constants import MAX_QUESTION_CHARS, QUESTION_FIELD
from evispan.operators.guardrail import guardrail_decision, guardrail_enforce, known_collections, semantic_check, validate_requests
from evispan.plans.quick_answer import Corpus, Models, answer
from evispan.plugins import Factory
from evispan.schema import SOURCE_STRUCT
from evispan.session import materialize

ANSWERED = 200


def request_outcomes(
    corpus: Corpus,
    requests: DataFrame,
    collections: DataFrame,
    terms: list[str] | None = None,
    classify: Factory | None = None,
    models: Models = Models(),
) -> DataFrame:
    """``(id, status_code, detail, answer, sources, error)`` of ``requests (question_id, collection_id, question[, depth])``.

    The first check that fails decides: the form of the request (422), the guardrail (422), the collection (404). Only what
    passes all three is searched, and no model sees anything else; the classifier sees what the exact rules let pass.
    An answered request has status 200; ``error`` tells of a model that failed on it. Ids must be unique. Null questions are a
    wrong form, null collections unknown ones. An empty table gives no row.
    """
    if "depth" not in requests.columns:
        requests = requests.withColumn("depth", F.lit(None).cast("int"))
    valid, malformed = validate_requests(requests.select("question_id", "collection_id", F.coalesce("question", F.lit("")).alias("question"), "depth"))
    decided = semantic_check(guardrail_decision(valid, "question", QUESTION_FIELD, MAX_QUESTION_CHARS, terms), "question", classify, terms)
    # The rules and the classifier run once; the branches below read what they decided.
    accepted, refused = guardrail_enforce(materialize(decided, "decided"))
    found, unknown = known_collections(accepted, collections)
    queries = materialize(
        found.select(F.col("question_id").cast("string").alias("query_id"), "collection_id", F.col("question").alias("query")), "accepted"
    )
    answered = answer(corpus, queries, models).select(
        F.col("query_id").alias("id"), F.lit(ANSWERED).alias("status_code"), F.lit(None).cast("string").alias("detail"), "answer", "sources", "error"
    )
    rejects = malformed.unionByName(refused).unionByName(unknown)
    nothing = F.lit(None).cast("string")
    empty = F.array().cast(f"array<{SOURCE_STRUCT}>")
    return answered.unionByName(rejects.withColumns({"answer": nothing, "sources": empty, "error": nothing}))
