"""Streaming jobs: session state, incremental ingestion, questions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evispan.constants import CLARIFICATION_FIELD, MAX_CLARIFICATION_CHARS, SESSION_NOT_WAITING, UNKNOWN_SESSION
from evispan.functions import guardrails as rules
from evispan.functions.text import strip
from evispan.plans.quick_answer import Corpus, Models, answer
from evispan.plugins import Factory
from evispan.session import materialize
from evispan.sources.store import IndexStore
from evispan.sources.uploads import FILES, ingest_uploads

SESSION_OUTPUT = (
    "session_id string, seq bigint, status string, status_code int, detail string, original_query string, "
    "clarification_questions array<string>, clarification_responses array<string>"
)
SESSION_STATE = (
    "status string, original string, questions array<string>, answers array<string>, "
    "held_seq array<bigint>, held_kind array<string>, held_text array<string>, held_refused array<string>"
)
TIMED_STATE = SESSION_STATE + ", held_at array<bigint>, held_questions array<array<string>>, last_at bigint"
SESSION_COLUMNS = [part.split()[0] for part in SESSION_OUTPUT.split(", ")]
TICK = "tick"


@dataclass
class Session:
    """A session inside the state functions; without status it has not been opened."""

    status: str | None = None
    original: str | None = None
    questions: list[str] = field(default_factory=list)
    answers: list[str] = field(default_factory=list)

    def apply(self, key: str, seq: int, kind: str, text: str, asked: list[str] | None, refused: str | None) -> tuple:
        """Take one event; the row that tells what became of it."""
        code, detail = None, None
        if kind == "start":
            if self.status is None:
                self.original, self.questions = text, list(asked if asked is not None else [])
                self.status = "awaiting_clarification" if self.questions else "researching"
        elif self.status is None:
            code, detail = UNKNOWN_SESSION
        elif kind == "done":
            self.status = "completed" if self.status == "researching" else self.status
        elif self.status != "awaiting_clarification":
            code, detail = SESSION_NOT_WAITING
        elif refused is not None:
            code, detail = 422, f"Entrada rejeitada: {refused}."
        else:
            self.answers.append(text)
            if len(self.answers) >= len(self.questions):
                self.status = "researching"
        return key, seq, self.status, code, detail, self.original, list(self.questions), list(self.answers)


def _output(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=SESSION_COLUMNS, dtype=object)  # a frame per session: no types are looked for


def _prepared(events: DataFrame, terms: list[str] | None, *more: str) -> DataFrame:
    """Events with their text stripped and the reason why a guardrail refuses it, if one does."""
    found = rules.violations(F.col("text"), CLARIFICATION_FIELD, MAX_CLARIFICATION_CHARS, terms or [])
    reason = F.when(F.size(found) > 0, F.array_join(found, "; "))
    return events.select("session_id", "seq", "kind", strip(F.col("text")).alias("text"), "questions", reason.alias("refused"), *more)


def session_stream(
    events: DataFrame,
    terms: list[str] | None = None,
    keep_ms: int | None = None,
    patience_ms: int | None = None,
    delay: str = "10 minutes",
) -> DataFrame:
    """State changes of sessions from a stream ``(session_id, seq, kind, text, questions[, at])``.

    ``start`` opens a session (with the clarification questions triage decided on), ``answer`` answers the
    next one, ``done`` reports that its research ended. Guardrail rules are evaluated as columns before the
    state function, which only counts. ``answer_outcomes`` gives the same results over tables of any skew.

    **With an event time** ``at`` (timestamp) the result doesn't depend on how the input falls into micro-batches: an event
    waits in the state until the watermark (largest ``at`` seen, less ``delay``) has passed it, and a session's events are
    applied in the order ``(at, seq)``. What comes later than ``delay`` is late and left out, as is an event without a time.
    The state holds a session's events of one ``delay``. The stream ends under ``availableNow``; the events of the last
    ``delay`` then wait for the next run, or for an event of kind ``tick``, which only moves the time on. ``keep_ms`` forgets a session
    to which nothing came for that long in event time.

    **Without one** events are applied in ``seq`` order inside a micro-batch. With ``patience_ms`` those that
    come before their session's start are kept, and answered as of an unknown session when it stays away that long; without it they
    are answered at once. ``keep_ms`` forgets sessions without events for that long; by default they stay. Both are
    processing-time limits, for which Spark goes on with empty micro-batches, so such a stream is stopped and doesn't end
    under ``availableNow``.
    """
    if "at" in events.columns:
        if patience_ms is not None:
            raise ValueError("patience_ms is for events without a time; use delay")
        return _timed_sessions(events, terms, keep_ms, delay)

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh = (None, None, [], [], [], [], [], [])
        status, original, questions, answers, *held = state.get if state.exists else fresh
        session = Session(status, original, list(questions), list(answers))
        waiting = list(zip(*held))
        if state.hasTimedOut:
            out = [session.apply(key[0], seq, kind, text, None, refused) for seq, kind, text, refused in waiting]
            state.remove()
            if out:
                yield _output(out)
            return
        batch = [(e.seq, e.kind, e.text, e.questions, e.refused) for frame in frames for e in frame.itertuples()]
        known = status is not None or any(kind == "start" for _, kind, *_ in batch)
        out = []
        if known or patience_ms is None:
            batch += [(seq, kind, text, None, refused) for seq, kind, text, refused in waiting]
            waiting = []
            out = [session.apply(key[0], *event) for event in sorted(batch, key=lambda e: e[0])]
        else:
            waiting += [(seq, kind, text, refused) for seq, kind, text, _, refused in batch]
        if session.status is not None or waiting:
            held = [list(part) for part in zip(*waiting)] if waiting else [[], [], [], []]
            state.update((session.status, session.original, session.questions, session.answers, *held))
            if session.status is None:
                state.setTimeoutDuration(patience_ms)
            elif keep_ms is not None:
                state.setTimeoutDuration(keep_ms)
        if out:
            yield _output(out)

    timed = keep_ms is not None or patience_ms is not None
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timed else GroupStateTimeout.NoTimeout
    grouped = _prepared(events, terms).groupBy("session_id")
    return grouped.applyInPandasWithState(advance, SESSION_OUTPUT, SESSION_STATE, "append", timeout)


def _timed_sessions(events: DataFrame, terms: list[str] | None, keep_ms: int | None, delay: str) -> DataFrame:
    """Sessions on event time: every event is held until the watermark has passed it. Spark converts every column of every
    session to pandas by itself, so an event's fields travel as one text."""
    dated = events.where("at IS NOT NULL").withWatermark("at", delay).withColumn("at_us", F.unix_micros("at"))

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh = (None, None, [], [], [], [], [], [], [], [], None)
        status, original, questions, answers, *kept, last = state.get if state.exists else fresh
        session = Session(status, original, list(questions), list(answers))
        seqs, kinds, texts, refusals, times, asked = kept
        held = list(zip(times, seqs, kinds, texts, asked, refusals))
        if not state.hasTimedOut:
            arrived = (json.loads(event) for frame in frames for event in frame["event"])
            held += [
                (e["at_us"], e["seq"], e.get("kind"), e.get("text"), e.get("questions"), e.get("refused"))
                for e in arrived
                if e.get("kind") != TICK
            ]
        passed_ms = state.getCurrentWatermarkMs()
        held.sort(key=lambda e: e[:2])
        out = []
        while held and held[0][0] < passed_ms * 1000:
            at, *event = held.pop(0)
            if keep_ms is not None and last is not None and at > last + keep_ms * 1000:
                session = Session()
            out.append(session.apply(key[0], *event))
            last = at
        gone = keep_ms is not None and last is not None and last + keep_ms * 1000 < passed_ms * 1000
        if held or (session.status is not None and not gone):
            times, seqs, kinds, texts, asked, refusals = [list(part) for part in zip(*held)] if held else [[] for _ in range(6)]
            state.update(
                (session.status, session.original, session.questions, session.answers, seqs, kinds, texts, refusals, times, asked, last)
            )
            if held:
                state.setTimeoutTimestamp(max(held[0][0] // 1000, passed_ms, 1))
            elif keep_ms is not None:
                state.setTimeoutTimestamp(max(last // 1000 + keep_ms, passed_ms, 1))
        elif state.exists:
            state.remove()
        if out:
            yield _output(out)

    event = F.to_json(F.struct("seq", "kind", "text", "questions", "refused", "at_us")).alias("event")
    grouped = _prepared(dated, terms, "at", "at_us").select("session_id", "at", event).groupBy("session_id")
    return grouped.applyInPandasWithState(advance, SESSION_OUTPUT, TIMED_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_ingest(
    arrivals: DataFrame,
    store: IndexStore,
    to_chunks: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    models: Models = Models(),
    with_vectors: bool = True,
) -> StreamingQuery:
    """Index what arrives. Each micro-batch is one ingestion of the store, named by its batch id: a batch
    replayed after a failure replaces its own partition."""

    def load(batch: DataFrame, batch_id: int) -> None:
        store.add(to_chunks(batch), f"batch-{batch_id:09d}", models, with_vectors)

    return arrivals.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_uploads(
    spark: SparkSession,
    folder: str,
    store: IndexStore,
    output: str,
    parser: Factory,
    checkpoint: str,
    models: Models = Models(),
    tokenizer: Factory | None = None,
    files_per_batch: int | None = None,
    with_vectors: bool = True,
) -> StreamingQuery:
    """Index the files that arrive below ``folder``: admission, dispatch by suffix, decoding or parsing, chunking, index. The
    store, ``output/profiles`` and ``output/rejects`` are written by batch id, so a replayed batch replaces what it wrote.
    Spark's file sources give no row for a file without bytes, so such a file is not among the rejects here, unlike in
    ``ingest_uploads`` over a table of files."""
    source = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)

    def load(batch: DataFrame, batch_id: int) -> None:
        made = ingest_uploads(batch, parser, tokenizer)
        if not made.chunks.isEmpty():
            store.add(made.chunks, f"upload-{batch_id:09d}", models, with_vectors)
        made.profiles.write.mode("overwrite").parquet(f"{output}/profiles/batch_id={batch_id}")
        made.rejects.write.mode("overwrite").parquet(f"{output}/rejects/batch_id={batch_id}")

    arrivals = source.load(folder)
    return arrivals.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_questions(
    questions: DataFrame, corpus: Callable[[], Corpus], output: str, checkpoint: str, models: Models = Models()
) -> StreamingQuery:
    """Answer questions ``(query_id, collection_id, query)`` as they arrive, against the index as it is at
    each micro-batch. Answers are written by batch id, so a replayed batch replaces its answers."""

    def reply(batch: DataFrame, batch_id: int) -> None:
        asked = materialize(batch.select("query_id", "collection_id", "query"), "questions")
        answer(corpus(), asked, models).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return questions.writeStream.foreachBatch(reply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
