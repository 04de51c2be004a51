"""From sessions to research and back: what the session stream holds ready is researched, and its end goes back as events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from evispan.operators.sessions import enriched_query
from evispan.plans.quick_answer import Corpus
from evispan.plans.research import Agents, Research, research_report, research_rounds
from evispan.session import materialize

SESSION = ("status", "original_query", "clarification_questions", "clarification_responses")


@dataclass(frozen=True)
class SessionResearch:
    """``reports``: the response of every researched session (``research_report`` with ``session_id``). ``done``: the events
    ``(session_id, seq, kind, text, questions, at)`` that complete them, for the session stream's input."""

    research: Research
    reports: DataFrame
    done: DataFrame


def latest_states(changes: DataFrame) -> DataFrame:
    """The last state ``(session_id, seq, status, ...)`` of every opened session out of its state changes. Changes of equal
    ``seq`` in a session (a repeated event) count by status: a completed session stays completed. A partial maximum,
    so long histories are cut before the shuffle."""
    order = F.struct("seq", F.array_position(F.array(*[F.lit(s) for s in ("awaiting_clarification", "researching", "completed")]), F.col("status")))
    last = changes.where("status IS NOT NULL").groupBy("session_id").agg(F.max_by(F.struct("seq", *SESSION), order).alias("last"))
    return last.select("session_id", "last.*")


def research_sessions(corpus: Corpus, changes: DataFrame, requests: DataFrame, agents: Agents = Agents(), at: Column | None = None) -> SessionResearch:
    """Research all sessions that are ``researching`` according to their state ``changes`` (the output of ``session_stream``).

    ``requests (session_id, collection_id, depth)`` says where and how deep; a session without a request stays as it is.
    The original query is searched as it is, the plan is made from the query enriched with the clarifications. The
    events in ``done`` come after the session's last one, at ``at`` (by default now), and only for sessions whose report has been
    written: one whose research failed stays ``researching`` and is researched again by the next call.
    """
    ready = latest_states(changes).where("status = 'researching'").join(requests.select("session_id", "collection_id", "depth"), "session_id")
    enriched = enriched_query(F.col("original_query"), F.col("clarification_questions"), F.col("clarification_responses"))
    questions = materialize(
        ready.select(
            F.col("session_id").alias("question_id"), "collection_id", "depth", enriched.alias("question"),
            F.col("original_query").alias("retrieval_question"), "seq",
        ),
        "session-questions",
    )
    research = research_rounds(corpus, questions.drop("seq"), agents=agents)
    reports = materialize(research_report(questions, research, agents.write), "session-reports")
    done = reports.select("question_id").join(questions.select("question_id", "seq"), "question_id").select(
        F.col("question_id").alias("session_id"),
        (F.col("seq") + 1).alias("seq"),
        F.lit("done").alias("kind"),
        F.lit("").alias("text"),
        F.array().cast("array<string>").alias("questions"),
        (F.current_timestamp() if at is None else at).alias("at"),
    )
    return SessionResearch(research, reports.withColumnRenamed("question_id", "session_id"), done)
