"""Bounded research rounds over a table of questions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from evispan.constants import (
    MAX_ROUNDS,
    MAX_SUBQUESTIONS,
    SEARCH_FAILED_ANSWER,
    SEARCH_FAILED_ERROR,
    UNDETAILED_GAP,
)
from evispan.functions.text import short_summary
from evispan.operators import findings as ops
from evispan.plans.quick_answer import Corpus, Models, answer
from evispan.plugins import Factory, run_texts
from evispan.schema import FINDING_COLUMNS, FINDINGS, SOURCE_STRUCT
from evispan.session import materialize

JUDGED = "question_id string, is_sufficient boolean, reason string, missing_information array<string>, rounds_completed int"
JUDGEMENT = "struct<is_sufficient: boolean, reason: string, missing_information: array<string>>"


@dataclass(frozen=True)
class Agents:
    """Plug-ins of the rounds; each ``None`` means its deterministic fallback."""

    plan: Factory | None = None
    judge: Factory | None = None
    refine: Factory | None = None
    write: Factory | None = None
    models: Models = field(default_factory=Models)


def search_plan(questions: DataFrame, plan: Factory | None) -> DataFrame | None:
    """Planned sub-questions from a text generator; questions whose plan failed have none."""
    if plan is None:
        return None
    outputs = materialize(run_texts(questions.select("question_id", "question"), "question", "output", "string", plan), "plans")
    return ops.parse_subquestions(outputs.where(F.col("output_error").isNull()))


def search(corpus: Corpus, searches: DataFrame, models: Models = Models()) -> DataFrame:
    """Findings of ``(question_id, collection_id, round, ord, query)``. Equal queries on one collection are
    answered once. A search that fails is a finding with an error."""
    distinct = searches.select("collection_id", "query").distinct().withColumn(
        "query_id", F.sha2(F.concat_ws("\n", "collection_id", "query"), 256)
    )
    answers = answer(corpus, materialize(distinct, "queries"), models)
    none = F.array().cast(f"array<{SOURCE_STRUCT}>")
    failed = F.col("error").isNotNull() | F.col("answer").isNull()
    return searches.join(
        answers.select("collection_id", "query", "answer", "sources", "error"), ["collection_id", "query"], "left"
    ).select(
        "question_id",
        "round",
        "ord",
        F.col("query").alias("subquestion"),
        F.when(failed, F.lit(SEARCH_FAILED_ANSWER)).otherwise(F.col("answer")).alias("answer"),
        F.when(failed, none).otherwise(F.col("sources")).alias("sources"),
        F.when(failed, F.lit(0)).otherwise(F.size("sources")).alias("evidence_count"),
        F.when(failed, F.lit(SEARCH_FAILED_ERROR)).alias("error"),
    )


def judge_sufficiency(questions: DataFrame, findings: DataFrame, judge: Factory | None) -> DataFrame:
    fallback = ops.sufficiency(questions, findings)
    if judge is None:
        return fallback
    prompts = ops.format_findings(questions, findings).join(questions.select("question_id", "question"), "question_id").select(
        "question_id",
        F.concat(F.lit("question:\n"), "question", F.lit("\nfindings:\n"), "findings_text").alias("prompt"),
    )
    judged = materialize(run_texts(prompts, "prompt", "verdict", JUDGEMENT, judge), "verdicts")
    return fallback.join(judged.select("question_id", "verdict"), "question_id", "left").select(
        "question_id",
        F.coalesce("verdict.is_sufficient", "is_sufficient").alias("is_sufficient"),
        F.coalesce("verdict.reason", "reason").alias("reason"),
        F.when(F.col("verdict").isNotNull(), F.slice("verdict.missing_information", 1, MAX_SUBQUESTIONS))
        .otherwise(F.col("missing_information"))
        .alias("missing_information"),
    )


def refinement(questions: DataFrame, findings: DataFrame, judged: DataFrame, refine: Factory | None) -> DataFrame:
    """``(question_id, ord, query)`` for the next round; a plan that fails or comes out empty is replaced by
    one query per gap."""
    fallback = ops.refinement_fallback(judged, questions).select("question_id", "ord", "query")
    if refine is None:
        return fallback
    missing = F.coalesce(
        F.nullif(F.array_join(F.transform("missing_information", lambda gap: F.concat(F.lit("- "), gap)), "\n"), F.lit("")),
        F.lit(UNDETAILED_GAP),
    )
    prompts = (
        judged.join(questions.select("question_id", "question"), "question_id")
        .join(ops.executed_queries(findings), "question_id", "left")
        .select(
            "question_id",
            F.concat(
                F.lit("question:\n"), "question", F.lit("\nreason:\n"), "reason", F.lit("\ngaps:\n"), missing,
                F.lit("\nsearched:\n"), F.coalesce("executed_text", F.lit("")),
            ).alias("prompt"),
        )
    )
    outputs = materialize(run_texts(prompts, "prompt", "output", "string", refine), "refinements")
    lines = outputs.where(F.col("output_error").isNull() & (F.trim("output") != "")).withColumn("question", F.lit(""))
    planned = ops.parse_subquestions(lines, limit=None).where(F.col("query") != "")
    executed = findings.select("question_id", F.col("subquestion").alias("query"))
    kept = ops.refinement_dedupe(planned, executed)
    return kept.unionByName(fallback.join(kept.select("question_id").distinct(), "question_id", "left_anti"))


@dataclass(frozen=True)
class Research:
    """``findings`` of all rounds and ``judged (question_id, is_sufficient, reason, missing_information,
    rounds_completed)``."""

    findings: DataFrame
    judged: DataFrame


def research_rounds(
    corpus: Corpus, questions: DataFrame, planned: DataFrame | None = None, agents: Agents = Agents()
) -> Research:
    """Search, judge and refine ``(question_id, collection_id, question, depth[, retrieval_question])``.

    At most three rounds, each a few jobs over all questions still open; a question leaves when it is
    sufficient, has reached its depth, or has nothing new to search. Every round's searches, findings and
    judgements are written, so later rounds start from tables and no lineage grows.
    """
    if "retrieval_question" not in questions.columns:
        questions = questions.withColumn("retrieval_question", F.col("question"))
    plan = planned if planned is not None else search_plan(questions, agents.plan)
    asked = questions.select("question_id", F.col("retrieval_question").alias("question"))
    pending = ops.initial_queue(asked, plan)
    open_ = questions
    found: DataFrame | None = None
    judgements: DataFrame | None = None
    for number in range(1, MAX_ROUNDS + 1):
        current = pending.join(open_.where(F.col("depth") >= number).select("question_id", "collection_id"), "question_id")
        if found is not None:
            current = ops.unseen(current, found.select("question_id", F.col("subquestion").alias("query")))
        current = materialize(
            current.select("question_id", "collection_id", F.lit(number).alias("round"), "ord", "query"), "searches"
        )
        if current.isEmpty():
            break
        latest = materialize(search(corpus, current, agents.models), "findings")
        found = latest if found is None else found.unionByName(latest)
        searched = open_.join(current.select("question_id").distinct(), "question_id", "left_semi")
        of_searched = found.join(searched.select("question_id"), "question_id", "left_semi")
        judged = materialize(
            judge_sufficiency(searched, of_searched, agents.judge).withColumn("rounds_completed", F.lit(number)), "judged"
        )
        judgements = judged if judgements is None else judgements.unionByName(judged)
        open_ = searched.join(judged.where(~F.col("is_sufficient")).select("question_id"), "question_id", "left_semi").where(
            F.col("depth") > number
        )
        if number == MAX_ROUNDS or open_.isEmpty():
            break
        still = judged.join(open_.select("question_id"), "question_id", "left_semi")
        pending = refinement(open_, of_searched, still, agents.refine)
    if found is None:  # nothing was asked, or nothing within its depth
        spark = questions.sparkSession
        none = spark.createDataFrame([], FINDINGS).select(*FINDING_COLUMNS)
        return Research(none, spark.createDataFrame([], JUDGED))
    last = Window.partitionBy("question_id").orderBy(F.col("rounds_completed").desc())
    final = judgements.withColumn("_last", F.row_number().over(last)).where(F.col("_last") == 1).drop("_last")
    return Research(found.select(*FINDING_COLUMNS), final)


def write_report(questions: DataFrame, research: Research, write: Factory | None = None) -> DataFrame:
    """``(question_id, report)``; without supported findings the fixed sentence, and no call to the writer."""
    fallback = ops.report_fallback(research.judged, research.findings)
    if write is None:
        return fallback
    missing = F.coalesce(F.array_join("missing_information", "\n"), F.lit(""))
    prompts = (
        ops.report_evidence(research.findings)
        .join(research.judged, "question_id")
        .join(questions.select("question_id", "question"), "question_id")
        .select(
            "question_id",
            F.concat(
                F.lit("question:\n"), "question", F.lit("\nevidence:\n"), "evidence", F.lit("\nsufficient: "),
                F.col("is_sufficient").cast("string"), F.lit("\nreason:\n"), "reason", F.lit("\ngaps:\n"), missing,
            ).alias("prompt"),
        )
    )
    written = materialize(run_texts(prompts, "prompt", "written", "string", write), "reports")
    return fallback.join(written.select("question_id", "written"), "question_id", "left").select(
        "question_id", F.coalesce("written", "report").alias("report")
    )


def research_report(questions: DataFrame, research: Research, write: Factory | None = None) -> DataFrame:
    """The response of every question: report, summary, review, deduplicated sources, rounds and judgement."""
    review = ops.review(research.findings)
    sources = ops.dedupe_sources(research.findings).groupBy("question_id").agg(
        F.sort_array(
            F.collect_list(F.struct("ord", F.struct("page", "row_start", "row_end", "excerpt").alias("source")))
        ).alias("kept")
    )
    none = F.array().cast(f"array<{SOURCE_STRUCT}>")
    return (
        questions.select("question_id")
        .join(write_report(questions, research, write), "question_id")
        .join(research.judged, "question_id")
        .join(review, "question_id")
        .join(sources, "question_id", "left")
        .select(
            "question_id",
            F.col("report").alias("answer"),
            short_summary(F.col("report")).alias("short_summary"),
            "unsupported_subquestions",
            "conflicting_subquestions",
            "follow_up_questions",
            F.coalesce(F.col("kept.source"), none).alias("sources"),
            "rounds_completed",
            "is_sufficient",
            "reason",
            "missing_information",
        )
    )
