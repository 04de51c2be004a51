"""Bookkeeping over findings, searches and plans.

A question has at most 13 findings (5 + 4 + 4 searches), so gathering one question's findings in order is
bounded. Everything else is joins, windows and partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evispan.constants import (
    FOLLOW_UP_PREFIX,
    INSUFFICIENT_REASON,
    LIMITATIONS_PREFIX,
    MAX_SUBQUESTIONS,
    NO_EVIDENCE_REPORT,
    NO_FINDINGS,
    NONE_FEMININE,
    NONE_MASCULINE,
    ORIGINAL_REASON,
    PLANNED_REASON,
    REFINEMENT_PREFIX,
    REFINEMENT_REASON,
    REPEATED_ANSWER_CHARS,
    SUFFICIENT_REASON,
)
from evispan.functions.labels import source_labels
from evispan.functions.text import answer_key, casefold, split_lines, strip
from evispan.operators.lexical import top_k

BULLET = (
    r"^[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"
    r"(?:[-*]|\p{Nd}+[.)])"
)


def has_error() -> Column:
    """A finding failed if its error is set; an empty text counts as not set."""
    return F.coalesce(F.col("error"), F.lit("")) != ""


def is_unsupported() -> Column:
    return has_error() | (F.coalesce(F.size("sources"), F.lit(0)) <= 0)


def in_order(*columns: Column | str) -> Column:
    """Array of structs ordered by (round, ord)."""
    return F.sort_array(F.collect_list(F.struct("round", "ord", *columns)))


def parse_subquestions(outputs: DataFrame, limit: int | None = MAX_SUBQUESTIONS) -> DataFrame:
    """``(question_id, ord, query)`` of plan texts ``(question_id, question, output)``: bullets and headings
    dropped, repeats dropped, the first ``limit`` kept (``None``: all); a text without any gives the question itself."""
    lines = outputs.select("question_id", F.posexplode_outer(split_lines(F.col("output"))).alias("pos", "line"))
    item = strip(F.regexp_replace("line", BULLET, ""))
    heading = F.lower("item").startswith("subperguntas") | F.lower("item").startswith("perguntas:")
    firsts = (
        lines.select("question_id", "pos", item.alias("item"))
        .where((F.col("item") != "") & ~heading)
        .groupBy("question_id", "item")
        .agg(F.min("pos").alias("pos"))
    )
    order = Window.partitionBy("question_id").orderBy("pos")
    kept = firsts.withColumn("ord", F.row_number().over(order))
    if limit is not None:
        kept = kept.where(F.col("ord") <= limit)
    return outputs.select("question_id", "question").join(kept, "question_id", "left").select(
        "question_id", F.coalesce("ord", F.lit(1)).alias("ord"), F.coalesce("item", "question").alias("query")
    )


def initial_queue(questions: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """``(question_id, ord, query, reason)``: the original question, then the planned queries that differ
    from it in more than case."""
    first = questions.select(
        "question_id", F.lit(0).alias("ord"), F.col("question").alias("query"), F.lit(ORIGINAL_REASON).alias("reason")
    )
    if planned is None:
        return first
    others = (
        planned.select("question_id", "ord", "query")
        .join(questions.select("question_id", "question"), "question_id")
        .where(casefold(F.col("query")) != casefold(F.col("question")))
        .select("question_id", "ord", "query", F.lit(PLANNED_REASON).alias("reason"))
    )
    return first.unionByName(others)


def unseen(searches: DataFrame, executed: DataFrame) -> DataFrame:
    """Searches whose exact text the question has not run before; repeats inside the batch stay."""
    return searches.join(executed.select("question_id", "query").distinct(), ["question_id", "query"], "left_anti")


def unsupported(findings: DataFrame) -> DataFrame:
    """``(question_id, round, ord, subquestion)`` of findings that failed or have no source."""
    return findings.where(is_unsupported()).select("question_id", "round", "ord", "subquestion")


def follow_ups(findings: DataFrame) -> DataFrame:
    return unsupported(findings).withColumn("follow_up", F.concat(F.lit(FOLLOW_UP_PREFIX), "subquestion"))


def repeated_answers(findings: DataFrame, longer_than: int = REPEATED_ANSWER_CHARS) -> DataFrame:
    """``(question_id, first_round, first_ord, subquestions)``: sub-questions of one question that got the same
    answer, joined in order; short answers do not count. Answers are compared by digest."""
    key = answer_key(F.col("answer"))
    groups = (
        findings.withColumn("key", key)
        .where(F.length("key") > longer_than)
        .groupBy("question_id", F.sha2("key", 256).alias("key"))
        .agg(in_order("subquestion").alias("same"))
        .where(F.size("same") > 1)
    )
    first = F.get("same", F.lit(0))
    return groups.select(
        "question_id",
        first["round"].alias("first_round"),
        first["ord"].alias("first_ord"),
        F.array_join(F.col("same.subquestion"), "; ").alias("subquestions"),
    )


def review(findings: DataFrame) -> DataFrame:
    """``(question_id, unsupported_subquestions, conflicting_subquestions, follow_up_questions)``."""
    base = findings.groupBy("question_id").agg(
        F.sort_array(F.collect_list(F.when(is_unsupported(), F.struct("round", "ord", "subquestion")))).alias("lacking")
    )
    conflicts = repeated_answers(findings).groupBy("question_id").agg(
        F.sort_array(F.collect_list(F.struct("first_round", "first_ord", "subquestions"))).alias("same")
    )
    none = F.array().cast("array<string>")
    return base.join(conflicts, "question_id", "left").select(
        "question_id",
        F.col("lacking.subquestion").alias("unsupported_subquestions"),
        F.coalesce(F.col("same.subquestions"), none).alias("conflicting_subquestions"),
        F.transform(F.col("lacking.subquestion"), lambda q: F.concat(F.lit(FOLLOW_UP_PREFIX), q)).alias("follow_up_questions"),
    )


def dedupe_sources(findings: DataFrame) -> DataFrame:
    """``(question_id, ord, page, row_start, row_end, excerpt)``: sources in order of findings, the first of
    equal ones (nulls equal nulls). Earlier copies are picked by a partial minimum before the shuffle."""
    found = findings.select(
        "question_id", "round", "ord", F.posexplode_outer("sources").alias("pos", "source")
    ).where(F.col("source").isNotNull())
    firsts = found.groupBy("question_id", "source.page", "source.row_start", "source.row_end", "source.excerpt").agg(
        F.min(F.struct("round", "ord", "pos")).alias("first")
    )
    order = Window.partitionBy("question_id").orderBy("first")
    return firsts.select(
        "question_id", F.row_number().over(order).alias("ord"), "page", "row_start", "row_end", "excerpt"
    )


def sufficiency(questions: DataFrame, findings: DataFrame, limit: int = MAX_SUBQUESTIONS) -> DataFrame:
    """``(question_id, is_sufficient, reason, missing_information)``: sufficient with at least one finding and
    none unsupported; the first ``limit`` unsupported sub-questions are missing."""
    counts = findings.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_unsupported()).alias("n_unsupported")
    )
    first = top_k(unsupported(findings), limit, F.col("round"), "ord", key="question_id", rank="nth")
    lacking = first.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("nth", "subquestion"))).alias("lacking"))
    enough = (F.coalesce("n", F.lit(0)) > 0) & (F.coalesce("n_unsupported", F.lit(0)) == 0)
    joined = questions.select("question_id").join(counts, "question_id", "left").join(lacking, "question_id", "left")
    return joined.select(
        "question_id",
        enough.alias("is_sufficient"),
        F.when(enough, F.lit(SUFFICIENT_REASON)).otherwise(F.lit(INSUFFICIENT_REASON)).alias("reason"),
        F.coalesce(F.col("lacking.subquestion"), F.array().cast("array<string>")).alias("missing_information"),
    )


def refinement_dedupe(planned: DataFrame, executed: DataFrame, limit: int = MAX_SUBQUESTIONS) -> DataFrame:
    """``(question_id, ord, query)`` of a refinement plan: without queries equal, but for case, to executed
    ones or to earlier ones of the plan; the first ``limit``."""
    folded = planned.withColumn("key", casefold(F.col("query")))
    done = executed.select("question_id", casefold(F.col("query")).alias("key")).distinct()
    same = Window.partitionBy("question_id", "key").orderBy("ord")
    order = Window.partitionBy("question_id").orderBy("plan_ord")
    return (
        folded.join(done, ["question_id", "key"], "left_anti")
        .withColumn("copy", F.row_number().over(same))
        .where(F.col("copy") == 1)
        .select("question_id", "query", F.col("ord").alias("plan_ord"))
        .withColumn("ord", F.row_number().over(order))
        .where(F.col("ord") <= limit)
        .select("question_id", "ord", "query")
    )


def refinement_fallback(judged: DataFrame, questions: DataFrame, limit: int = MAX_SUBQUESTIONS) -> DataFrame:
    """``(question_id, ord, query, reason)``: one query per gap, or for the question where no gap is named."""
    gaps = judged.join(questions.select("question_id", "question"), "question_id").select(
        "question_id",
        F.posexplode(
            F.slice(
                F.when(F.size("missing_information") > 0, F.col("missing_information")).otherwise(F.array("question")), 1, limit
            )
        ).alias("pos", "gap"),
    )
    return gaps.select(
        "question_id", (F.col("pos") + 1).alias("ord"), F.concat(F.lit(REFINEMENT_PREFIX), "gap").alias("query"),
        F.lit(REFINEMENT_REASON).alias("reason"),
    )


def format_findings(questions: DataFrame, findings: DataFrame) -> DataFrame:
    """``(question_id, findings_text)`` for the judge of sufficiency."""
    labels = F.coalesce(F.nullif(source_labels(F.col("sources")), F.lit("")), F.lit(NONE_FEMININE))
    block = F.concat(
        F.lit("Subpergunta: "), "subquestion", F.lit("\nResposta: "), "answer", F.lit("\nFontes: "), labels,
        F.lit("\nErro: "), F.when(has_error(), F.col("error")).otherwise(F.lit(NONE_MASCULINE)),
    )
    gathered = findings.groupBy("question_id").agg(in_order(block.alias("block")).alias("blocks"))
    return questions.select("question_id").join(gathered, "question_id", "left").select(
        "question_id", F.coalesce(F.array_join(F.col("blocks.block"), "\n\n"), F.lit(NO_FINDINGS)).alias("findings_text")
    )


def executed_queries(findings: DataFrame) -> DataFrame:
    """``(question_id, executed_text)``: a bullet per sub-question."""
    bullet = F.concat(F.lit("- "), F.col("subquestion"))
    return findings.groupBy("question_id").agg(in_order(bullet.alias("line")).alias("lines")).select(
        "question_id", F.array_join(F.col("lines.line"), "\n").alias("executed_text")
    )


def report_evidence(findings: DataFrame) -> DataFrame:
    """``(question_id, evidence)``: supported findings as text for a report writer."""
    block = F.concat(
        F.lit("Subpergunta: "), "subquestion", F.lit("\nConclusão: "), "answer", F.lit("\nFontes: "), source_labels(F.col("sources"))
    )
    return findings.where(F.size("sources") > 0).groupBy("question_id").agg(in_order(block.alias("block")).alias("blocks")).select(
        "question_id", F.array_join(F.col("blocks.block"), "\n\n").alias("evidence")
    )


def report_fallback(judged: DataFrame, findings: DataFrame) -> DataFrame:
    """``(question_id, report)``: supported findings one after the other, and the gaps if insufficient."""
    block = F.concat(F.col("subquestion"), F.lit(": "), F.col("answer"))
    supported = findings.where(F.size("sources") > 0).groupBy("question_id").agg(in_order(block.alias("block")).alias("blocks"))
    gaps = F.coalesce(F.nullif(F.array_join("missing_information", "; "), F.lit("")), F.col("reason"))
    body = F.array_join(F.col("blocks.block"), "\n\n")
    limits = F.when(F.col("is_sufficient"), F.lit("")).otherwise(F.concat(F.lit("\n\n" + LIMITATIONS_PREFIX), gaps))
    return judged.join(supported, "question_id", "left").select(
        "question_id",
        F.when(F.col("blocks").isNull(), F.lit(NO_EVIDENCE_REPORT)).otherwise(F.concat(body, limits)).alias("report"),
    )
