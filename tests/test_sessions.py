import datetime
import re
import time

from pyspark.sql import functions as F

from evispan import constants as c
from evispan.operators import sessions as so
from evispan.plans import quick_answer as qa
from evispan.sources.store import IndexStore
from evispan.streaming import jobs

EVENTS = [
    ("s", 5, "third"), ("s", 1, " first "), ("s", 2, ""), ("s", 3, "bomba"), ("s", 4, "second"), ("s", 6, "late"), ("s", 7, ""),
    ("none", 1, "x"), ("ghost", 1, "y"), ("open", 1, "one"),
]


def made(spark):
    base = spark.createDataFrame([("s", "vague", True), ("none", "clear", False), ("open", "vague", True)], "session_id string, original_query string, needs_clarification boolean")
    return so.clarification_questions(base)


def outcomes(spark):
    return so.answer_outcomes(made(spark), spark.createDataFrame(EVENTS, "session_id string, seq bigint, text string"), ["bomba"])


EXPECTED = {
    ("s", 1): None, ("s", 2): 422, ("s", 3): 422, ("s", 4): None, ("s", 5): None, ("s", 6): 409, ("s", 7): 409,
    ("none", 1): 409, ("ghost", 1): 404, ("open", 1): None,
}


def test_outcomes_and_states(spark):
    assert {(r.session_id, r.seq): r.status_code for r in outcomes(spark).collect()} == EXPECTED
    states = so.session_states(made(spark), outcomes(spark), spark.createDataFrame([("none",)], "session_id string"))
    got = {r.session_id: (r.status, r.clarification_responses) for r in states.collect()}
    assert got == {"s": ("researching", ["first", "second", "third"]), "none": ("completed", []), "open": ("awaiting_clarification", ["one"])}
    query = so.enriched_query(F.col("original_query"), F.col("clarification_questions"), F.col("clarification_responses"))
    texts = {r[0]: r[1] for r in states.select("session_id", query).collect()}
    asked = c.DEFAULT_CLARIFICATIONS
    assert texts["none"] == "clear"
    assert texts["s"] == f"vague\n\nEsclarecimentos do usuário:\n- {asked[0]}: first\n- {asked[1]}: second\n- {asked[2]}: third"


def test_triage_and_generated_questions(spark):
    df = spark.createDataFrame([(q, q) for q in ("vague", "crash", "four", "clear")], "session_id string, original_query string").repartition(4, "session_id")

    def classify():
        def call(texts):
            if "crash" in texts:
                raise RuntimeError
            return [t != "clear" for t in texts]

        return call

    generate = lambda: lambda texts: [["a", "b"] if t == "vague" else list("abcd") for t in texts]
    got = {r.session_id: r.clarification_questions for r in so.clarification_questions(so.triage(df, classify), generate).collect()}
    assert got == {"vague": ["a", "b"], "four": list(c.DEFAULT_CLARIFICATIONS), "crash": [], "clear": []}
    assert so.triage(df, None).where("needs_clarification").count() == 0


def test_lookup(spark):
    states = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y")], "session_id string, seq bigint, status string")
    found, rejects = so.session_lookup(states, spark.createDataFrame([("a",), ("b",)], "session_id string"))
    assert [(r.seq, r.status) for r in found.collect()] == [(3, "z")]
    assert [(r.id, r.status_code) for r in rejects.collect()] == [("b", 404)]


SCHEMA = "session_id string, seq bigint, kind string, text string, questions array<string>"


def test_stream_gives_the_same_outcomes_over_batches(spark, tmp_path):
    starts = [(r.session_id, 0, "start", r.original_query, r.clarification_questions) for r in made(spark).collect()]
    answers = [(s, n, "answer", t, None) for s, n, t in EVENTS]
    done = [("s", 8, "done", "", None), ("open", 2, "done", "", None)]
    source = str(tmp_path / "events")

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.session_stream(spark.readStream.schema(SCHEMA).parquet(source), ["bomba"])
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    run(starts + [e for e in answers if e[1] < 3])
    run([e for e in answers if e[1] >= 3] + done)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.session_id, r.seq): r.status_code for r in out if 0 < r.seq and (r.session_id, r.seq) in EXPECTED} == EXPECTED
    last = {}
    for r in sorted(out, key=lambda r: r.seq):
        last[r.session_id] = (r.status, r.clarification_responses)
    assert last["s"] == ("completed", ["first", "second", "third"])
    assert last["open"] == ("awaiting_clarification", ["one"])


def test_early_events_wait_for_their_start(spark, tmp_path):
    source = str(tmp_path / "events")
    early = [("s", 1, "answer", "one", None), ("s", 2, "answer", "two", None)]
    start = [("s", 0, "start", "what", ["q1", "q2"])]
    for rows in (early, start):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    outcomes = []
    for files in (1, 64):
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(source)
        out = str(tmp_path / f"out{files}")
        stream = jobs.session_stream(events, [], patience_ms=3_600_000).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / f"cp{files}")
        ).start()
        found, deadline = [], time.time() + 90
        while len(found) < 3 and time.time() < deadline:
            time.sleep(1)
            if (tmp_path / f"out{files}" / "_spark_metadata").exists():
                found = spark.read.schema(jobs.SESSION_OUTPUT).parquet(out).collect()
        stream.stop()
        outcomes.append(sorted((r.seq, r.status, r.status_code, len(r.clarification_responses)) for r in found))
    assert outcomes[0] == outcomes[1] == [(0, "awaiting_clarification", None, 0), (1, "awaiting_clarification", None, 1), (2, "researching", None, 2)]


TIMED = SCHEMA + ", at timestamp"


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def timed_run(spark, tmp_path, name, source, files, delay="10 minutes", **options):
    """All rows of the stream over the files below ``source``; it ends by itself."""
    events = spark.readStream.schema(TIMED).option("maxFilesPerTrigger", files).parquet(source)
    out = str(tmp_path / f"out-{name}")
    stream = jobs.session_stream(events, ["bomba"], delay=delay, **options)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination()
    return sorted((r.session_id, r.seq, r.status, r.status_code, len(r.clarification_responses)) for r in spark.read.schema(jobs.SESSION_OUTPUT).parquet(out).collect())


def write_files(spark, source, files):
    for rows in files:
        spark.createDataFrame(rows, TIMED).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.02)


def test_event_time_gives_one_result_for_every_number_of_files(spark, tmp_path):
    """Answers in files before their session's start, an unknown session, equal times, an answer that precedes its start in time."""
    source = str(tmp_path / "events")
    write_files(spark, source, [
        [("s", 2, "answer", "two", None, at(20)), ("ghost", 1, "answer", "boo", None, at(5))],
        [("s", 1, "answer", "one", None, at(10)), ("t", 0, "start", "clear", [], at(1))],
        [("early", 1, "answer", "too soon", None, at(3)), ("t", 1, "done", "", None, at(2))],
        [("s", 0, "start", "what", ["q1", "q2"], at(0)), ("early", 2, "start", "later", ["q"], at(4)), ("early", 3, "answer", "bomba", None, at(4))],
        [("u", 0, "start", "u", ["q"], at(30)), ("u", 1, "answer", "a", None, at(30))],
        [("any", 0, "tick", None, None, at(7200))],
        [("u", 2, "answer", "not due yet", None, at(7000))],
    ])
    got = {files: timed_run(spark, tmp_path, str(files), source, files) for files in (1, 3, 64)}
    assert got[1] == got[3] == got[64] == sorted([
        ("ghost", 1, None, 404, 0), ("early", 1, None, 404, 0), ("early", 2, "awaiting_clarification", None, 0), ("early", 3, "awaiting_clarification", 422, 0),
        ("s", 0, "awaiting_clarification", None, 0), ("s", 1, "awaiting_clarification", None, 1), ("s", 2, "researching", None, 2),
        ("t", 0, "researching", None, 0), ("t", 1, "completed", None, 0),
        ("u", 0, "awaiting_clarification", None, 0), ("u", 1, "researching", None, 1),
    ], key=lambda r: (r[0], r[1]))
    # What was not due waits in the state for the next run over the same checkpoint.
    write_files(spark, source, [[("any", 1, "tick", None, None, at(90_000))]])
    assert ("u", 2, "researching", 409, 1) in timed_run(spark, tmp_path, "64", source, 64)


def test_event_time_forgets_sessions(spark, tmp_path):
    source = str(tmp_path / "events")
    write_files(spark, source, [
        [("s", 0, "start", "what", ["q1"], at(0)), ("kept", 0, "start", "what", ["q1"], at(0))],
        [("s", 1, "answer", "one", None, at(100)), ("kept", 1, "answer", "one", None, at(50))],
        [("any", 0, "tick", None, None, at(7200))],
    ])
    for files in (1, 64):
        got = timed_run(spark, tmp_path, f"keep{files}", source, files, keep_ms=60_000)
        assert got == [
            ("kept", 0, "awaiting_clarification", None, 0), ("kept", 1, "researching", None, 1),
            ("s", 0, "awaiting_clarification", None, 0), ("s", 1, None, 404, 0),
        ]


def test_ingest_and_question_streams(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    source = str(tmp_path / "in")
    schema = "collection_id string, chunk_id bigint, text string"

    def to_chunks(batch):
        return batch.selectExpr(
            "*", "'s' source", "'pdf' file_type", "'c' chunking", "0 page", "array(1) pages", "cast(null as bigint) row_start",
            "cast(null as bigint) row_end", "1 n_tokens",
        )

    for rows in ([("a", 0, "red fox")], [("b", 0, "blue whale"), ("b", 1, "red sun")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.stream_ingest(spark.readStream.schema(schema).parquet(source), store, to_chunks, str(tmp_path / "cp1")).awaitTermination()
    assert sorted((r.collection_id, r.n_chunks) for r in store.corpus().index.stats.collect()) == [("a", 1), ("b", 2)]
    asked = str(tmp_path / "asked")
    spark.createDataFrame([("1", "a", "red"), ("2", "b", "red")], "query_id string, collection_id string, query string").write.parquet(asked)
    stream = spark.readStream.schema("query_id string, collection_id string, query string").parquet(asked)
    jobs.stream_questions(stream, store.corpus, str(tmp_path / "answers"), str(tmp_path / "cp2")).awaitTermination()
    got = {r.query_id: r.answer for r in spark.read.parquet(str(tmp_path / "answers")).collect()}
    assert got == {"1": "[Página 1] red fox", "2": "[Página 1] red sun"}
    batch = qa.answer(store.corpus(), spark.read.parquet(asked))
    assert {r.query_id: r.answer for r in batch.collect()} == got


def test_timed_sessions_move_events_as_one_column(spark, tmp_path):
    """Of a session's events Spark converts three columns to pandas; odd texts come through."""
    path = str(tmp_path / "events")
    schema = "session_id string, seq bigint, kind string, text string, questions array<string>, at timestamp"
    odd = 'quote " back \\ line \n é 😀  '
    at = lambda second: datetime.datetime(2024, 1, 1, 0, 0, second)
    rows = [("s", 0, "start", odd, ["q", None], at(0)), ("s", 1, "answer", odd, None, at(1)), ("s", 2, "answer", None, [], at(2)), ("t", 0, "start", None, None, at(0)), ("c", 0, "tick", None, None, datetime.datetime(2024, 1, 3))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    stream = jobs.session_stream(spark.readStream.schema(schema).parquet(path), [], delay="1 minute")
    assert re.search(r"Project \[session_id#\d+, at#\d+[^,]*, to_json\(", stream._jdf.queryExecution().analyzed().toString())
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r.session_id, r.seq): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(got) == [("s", 0), ("s", 1), ("s", 2), ("t", 0)]
    assert got["s", 1].original_query == odd.strip() and got["s", 0].clarification_questions == ["q", None]
    assert got["s", 1].clarification_responses == [odd.strip()] and got["t", 0].status == "researching"
