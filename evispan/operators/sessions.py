"""Clarification sessions as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evispan.constants import (
    CLARIFICATION_FIELD,
    CLARIFICATIONS_HEADER,
    DEFAULT_CLARIFICATIONS,
    MAX_CLARIFICATION_CHARS,
    SESSION_NOT_WAITING,
    UNKNOWN_SESSION,
)
from evispan.functions import guardrails as rules
from evispan.functions.text import strip
from evispan.operators.lexical import top_k
from evispan.plugins import Factory, run_texts
from evispan.session import materialize, salted_join

MAX_CLARIFICATIONS = 3


def triage(sessions: DataFrame, classify: Factory | None) -> DataFrame:
    """Add ``needs_clarification``; no classifier, or one that fails, means no."""
    if classify is None:
        return sessions.withColumn("needs_clarification", F.lit(False))
    judged = materialize(run_texts(sessions, "original_query", "flag", "boolean", classify), "triage")
    return judged.withColumn("needs_clarification", F.coalesce("flag", F.lit(False))).drop("flag", "flag_error")


def valid_clarifications(questions: Column) -> Column:
    return F.coalesce(F.size(questions).between(1, MAX_CLARIFICATIONS), F.lit(False))


def clarification_questions(sessions: DataFrame, generate: Factory | None = None) -> DataFrame:
    """Add ``clarification_questions``: from a generator of lists where it gives 1 to 3, else the three
    default ones; none where the session needs no clarification."""
    defaults = F.array(*[F.lit(question) for question in DEFAULT_CLARIFICATIONS])
    none = F.array().cast("array<string>")
    if generate is None:
        asked = defaults
        base = sessions
    else:
        wanted = run_texts(sessions.where("needs_clarification"), "original_query", "generated", "array<string>", generate)
        made = materialize(wanted, "clarifications").drop("generated_error")
        skipped = sessions.where(~F.col("needs_clarification")).withColumn("generated", F.lit(None).cast("array<string>"))
        base = made.unionByName(skipped)
        asked = F.when(valid_clarifications(F.col("generated")), F.col("generated")).otherwise(defaults)
    out = base.withColumn("clarification_questions", F.when(F.col("needs_clarification"), asked).otherwise(none))
    return out.drop("generated")


def answer_outcomes(sessions: DataFrame, answers: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Outcome of every answer event ``(session_id, seq, text)``.

    Adds ``status_code`` (null where the answer was taken), ``detail`` and ``answer_no``. Checks run in
    order: unknown session 404, session not waiting 409, guardrail 422. The accepted answers of a session are
    its first n valid ones; they are found by a top-n that is cut before the shuffle, and met by the events
    in a join that spreads a session with very many events.
    """
    found = rules.violations(F.col("text"), CLARIFICATION_FIELD, MAX_CLARIFICATION_CHARS, terms or [])
    events = materialize(answers.select("session_id", "seq", "text").withColumn("violations", found), "events")
    valid = events.where(F.size("violations") == 0).select("session_id", "seq")
    first = top_k(valid, MAX_CLARIFICATIONS, F.col("seq"), key="session_id", rank="answer_no")
    expected = sessions.select("session_id", F.size("clarification_questions").alias("n_questions"))
    taken = first.groupBy("session_id").agg(F.sort_array(F.collect_list("seq")).alias("taken"))
    state = materialize(expected.join(taken, "session_id", "left"), "expected")
    limit = F.get("taken", F.col("n_questions") - 1)
    position = F.array_position(F.coalesce("taken", F.array().cast("array<bigint>")), F.col("seq")).cast("int")
    known = F.col("n_questions").isNotNull()
    closed = (F.col("n_questions") == 0) | F.coalesce(F.col("seq") > limit, F.lit(False))
    rejected = F.size("violations") > 0
    reject_text = F.concat(F.lit("Entrada rejeitada: "), F.array_join("violations", "; "), F.lit("."))
    joined = salted_join(events, state, ["session_id"], F.col("seq"), "left")
    return joined.select(
        "session_id",
        "seq",
        F.when(~known, F.lit(UNKNOWN_SESSION[0])).when(closed, F.lit(SESSION_NOT_WAITING[0])).when(rejected, F.lit(422)).alias("status_code"),
        F.when(~known, F.lit(UNKNOWN_SESSION[1])).when(closed, F.lit(SESSION_NOT_WAITING[1])).when(rejected, reject_text).alias("detail"),
        F.when(known & ~closed & ~rejected, position).alias("answer_no"),
        strip(F.col("text")).alias("answer"),
    )


def session_states(sessions: DataFrame, outcomes: DataFrame, completed: DataFrame | None = None) -> DataFrame:
    """Sessions with ``clarification_responses`` and ``status``. A session without open questions is being
    researched, and completed once it is in ``completed``."""
    taken = outcomes.where(F.col("answer_no").isNotNull()).groupBy("session_id").agg(
        F.sort_array(F.collect_list(F.struct("answer_no", "answer"))).alias("taken")
    )
    responses = F.coalesce(F.col("taken.answer"), F.array().cast("array<string>"))
    joined = sessions.join(taken, "session_id", "left").withColumn("clarification_responses", responses).drop("taken")
    waiting = F.size("clarification_responses") < F.size("clarification_questions")
    if completed is None:
        return joined.withColumn(
            "status", F.when(waiting, F.lit("awaiting_clarification")).otherwise(F.lit("researching"))
        )
    done = completed.select("session_id").distinct().withColumn("_done", F.lit(True))
    return joined.join(done, "session_id", "left").withColumn(
        "status",
        F.when(waiting, F.lit("awaiting_clarification")).when(F.col("_done"), F.lit("completed")).otherwise(F.lit("researching")),
    ).drop("_done")


def enriched_query(original: Column, questions: Column, responses: Column) -> Column:
    """The original query, with a line per answered clarification if there is any."""
    pairs = F.slice(F.arrays_zip(questions.alias("q"), responses.alias("a")), 1, F.least(F.size(questions), F.size(responses)))
    lines = F.transform(pairs, lambda pair: F.concat(F.lit("- "), pair["q"], F.lit(": "), pair["a"]))
    return F.when(F.size(questions) == 0, original).otherwise(
        F.concat(original, F.lit(f"\n\n{CLARIFICATIONS_HEADER}\n"), F.array_join(lines, "\n"))
    )


def session_lookup(states: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(found, rejects)``: the latest state ``(session_id, seq, ...)`` of every requested id, 404 for the
    others. The latest is a partial maximum, so long histories are cut before the shuffle."""
    rest = [name for name in states.columns if name != "session_id"]
    latest = states.groupBy("session_id").agg(F.max_by(F.struct(*rest), "seq").alias("state")).select("session_id", "state.*")
    ids = requested.select("session_id").distinct()
    missing = ids.join(latest, "session_id", "left_anti")
    return latest.join(ids, "session_id", "left_semi"), missing.select(
        F.col("session_id").cast("string").alias("id"),
        F.lit(UNKNOWN_SESSION[0]).alias("status_code"),
        F.lit(UNKNOWN_SESSION[1]).alias("detail"),
    )
