"""Guardrail over tables of texts: validate, decide, split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evispan.constants import (
    MAX_QUESTION_CHARS,
    QUESTION_FIELD,
    SEMANTIC_UNAVAILABLE_REASON,
    UNKNOWN_COLLECTION,
)
from evispan.functions import guardrails as rules
from evispan.functions.text import strip
from evispan.plugins import Factory, run_texts
from evispan.session import materialize


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects)`` of ``(question_id, question, depth)``; a missing depth becomes the default."""
    good = rules.valid_question(F.col("question")) & rules.valid_depth(F.col("depth"))
    valid = requests.where(good).withColumn("depth", rules.depth_or_default(F.col("depth")))
    rejects = requests.where(~good).select(
        F.col("question_id").cast("string").alias("id"), F.lit(422).alias("status_code"),
        F.when(~rules.valid_question(F.col("question")), F.lit("question")).otherwise(F.lit("depth")).alias("detail"),
    )
    return valid, rejects


def guardrail_decision(
    texts: DataFrame,
    column: str = "question",
    field: str = QUESTION_FIELD,
    max_characters: int = MAX_QUESTION_CHARS,
    terms: list[str] | None = None,
) -> DataFrame:
    """Add ``allowed``, ``reason`` and ``violations`` from the exact rules."""
    found = rules.violations(F.col(column), field, max_characters, terms or [])
    return (
        texts.withColumn("violations", found)
        .withColumn("_decision", rules.decision(F.col("violations")))
        .withColumn("allowed", F.col("_decision.allowed"))
        .withColumn("reason", F.col("_decision.reason"))
        .drop("_decision")
    )


VERDICT = "struct<refused: boolean, reason: string, violations: array<string>>"
MAX_VIOLATIONS = 5


def semantic_check(decided: DataFrame, column: str, classify: Factory | None, terms: list[str] | None) -> DataFrame:
    """Second opinion by a plug-in, asked only about texts the exact rules allow and only if terms are configured.

    The plug-in says whether to refuse a text, or gives a verdict ``{"refused", "reason", "violations"}`` of which
    the reason and at most five violations are kept. A failing plug-in lets the text pass."""
    if classify is None or not terms:
        return decided

    def verdicts():
        call = classify()

        def full(texts: list[str]) -> list[dict]:
            return [v if isinstance(v, dict) else {"refused": bool(v), "reason": None, "violations": None} for v in call(texts)]

        return full

    passing = run_texts(decided.where("allowed"), column, "refused", VERDICT, verdicts)
    checked = materialize(passing, "checked")
    refused = F.coalesce("refused.refused", F.lit(False))
    named = F.slice(F.coalesce("refused.violations", F.array().cast("array<string>")), 1, MAX_VIOLATIONS)
    judged = (
        checked.withColumn("allowed", ~refused)
        .withColumn(
            "reason",
            F.when(F.col("refused_error").isNotNull(), F.lit(SEMANTIC_UNAVAILABLE_REASON))
            .when(refused, F.coalesce("refused.reason", F.lit(rules.BLOCKED_VIOLATION)))
            .otherwise(F.col("reason")),
        )
        .withColumn(
            "violations",
            F.when(refused & (F.size(named) > 0), named)
            .when(refused, F.array(F.lit(rules.BLOCKED_VIOLATION)))
            .otherwise(F.col("violations")),
        )
        .drop("refused", "refused_error")
    )
    return judged.unionByName(decided.where(~F.col("allowed")))


def guardrail_enforce(decided: DataFrame, key: str = "question_id", column: str = "question") -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejects)``: accepted texts are stripped; rejects carry 422 and the reason."""
    accepted = decided.where("allowed").withColumn(column, strip(F.col(column))).drop("allowed", "reason", "violations")
    rejects = decided.where(~F.col("allowed")).select(
        F.col(key).cast("string").alias("id"),
        F.lit(422).alias("status_code"),
        F.concat(F.lit("Entrada rejeitada: "), F.col("reason"), F.lit(".")).alias("detail"),
    )
    return accepted, rejects


def known_collections(questions: DataFrame, collections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(answerable, rejects)``: questions whose collection exists, and the others with 404."""
    known = collections.select("collection_id").distinct()
    missing = questions.join(known, "collection_id", "left_anti")
    return questions.join(known, "collection_id", "left_semi"), missing.select(
        F.col("question_id").cast("string").alias("id"),
        F.lit(UNKNOWN_COLLECTION[0]).alias("status_code"),
        F.lit(UNKNOWN_COLLECTION[1]).alias("detail"),
    )
