from pyspark.sql import functions as F

from evispan import constants as c
from evispan.operators import findings as fo
from evispan.plans import quick_answer as qa
from evispan.plans import research
from evispan.schema import FINDINGS

S = lambda page=None, a=None, b=None, text="e": (page, a, b, text)
LONG = "This answer is long enough to count"


def findings(spark):
    rows = [
        ("q", 1, 0, "one", LONG, [S(1), S(None, 2, 3)], 2, None),
        ("q", 1, 1, "two", f"  {LONG.upper()} ", [S(1), S(None, None, None)], 2, ""),
        ("q", 1, 2, "three", "short", [S(None, None, None), S(1, text="f")], 2, None),
        ("q", 2, 1, "four", "short", [], 0, None),
        ("q", 2, 2, "five", "x", [S(9)], 1, "boom"),
        ("p", 1, 0, "solo", LONG, [S(2)], 1, None),
    ]
    return spark.createDataFrame(rows, FINDINGS)


def questions(spark):
    return spark.createDataFrame([("q", "Question q"), ("p", "Question p"), ("r", "Question r")], "question_id string, question string")


def test_review(spark):
    got = {r.question_id: r for r in fo.review(findings(spark)).collect()}
    assert got["q"].unsupported_subquestions == ["four", "five"]
    assert got["q"].conflicting_subquestions == ["one; two"]
    assert got["q"].follow_up_questions == [c.FOLLOW_UP_PREFIX + "four", c.FOLLOW_UP_PREFIX + "five"]
    assert (got["p"].unsupported_subquestions, got["p"].conflicting_subquestions) == ([], [])


def test_sources_are_unique_in_order_with_equal_nulls(spark):
    got = [tuple(r)[1:] for r in fo.dedupe_sources(findings(spark)).where("question_id = 'q'").orderBy("ord").collect()]
    assert got == [(1, *S(1)), (2, *S(None, 2, 3)), (3, *S()), (4, *S(1, text="f")), (5, *S(9))]


def test_sufficiency_and_fallback_queries(spark):
    judged = fo.sufficiency(questions(spark), findings(spark))
    got = {r.question_id: tuple(r)[1:] for r in judged.collect()}
    assert got == {
        "q": (False, c.INSUFFICIENT_REASON, ["four", "five"]),
        "p": (True, c.SUFFICIENT_REASON, []),
        "r": (False, c.INSUFFICIENT_REASON, []),
    }
    queries = {(r.question_id, r.ord): r.query for r in fo.refinement_fallback(judged, questions(spark)).collect()}
    assert queries[("q", 2)] == c.REFINEMENT_PREFIX + "five" and queries[("r", 1)] == c.REFINEMENT_PREFIX + "Question r"


def test_plan_parsing(spark):
    outputs = [
        "Subperguntas:\n- one\n* two\n1. three\n2) one\n\n  - four\n5. five",
        "PERGUNTAS: x\n perguntas gerais",
        "   \n-\n",
        "plain\r\n3.14 is pi",
    ]
    df = spark.createDataFrame([(str(i), f"Q{i}", o) for i, o in enumerate(outputs)], "question_id string, question string, output string")
    got = {}
    for r in fo.parse_subquestions(df).orderBy("question_id", "ord").collect():
        got.setdefault(r.question_id, []).append(r["query"])
    assert got == {"0": ["one", "two", "three", "four"], "1": ["perguntas gerais"], "2": ["Q2"], "3": ["plain", "14 is pi"]}


def test_queue_unseen_and_refinement(spark):
    plan = spark.createDataFrame([("q", 1, "QUESTION Q"), ("q", 2, "b"), ("q", 3, "b")], "question_id string, ord int, query string")
    queue = fo.initial_queue(questions(spark).where("question_id = 'q'"), plan)
    assert [(r.ord, r["query"]) for r in queue.orderBy("ord").collect()] == [(0, "Question q"), (2, "b"), (3, "b")]
    done = spark.createDataFrame([("q", "b"), ("p", "B"), ("q", "Strasse")], "question_id string, query string")
    fresh = spark.createDataFrame([("q", 1, "B"), ("q", 2, "b"), ("q", 3, "new"), ("q", 4, "new")], "question_id string, ord int, query string")
    assert [r.ord for r in fo.unseen(fresh, done).orderBy("ord").collect()] == [1, 3, 4]
    many = spark.createDataFrame(
        [("q", i, t) for i, t in enumerate(["B", "x", "X", "STRAßE", "y", "z", "w", "v"])], "question_id string, ord int, query string"
    )
    assert [r["query"] for r in fo.refinement_dedupe(many, done).orderBy("ord").collect()] == ["x", "y", "z", "w"]


def test_texts_for_models_and_report(spark):
    text = {r.question_id: r.findings_text for r in fo.format_findings(questions(spark), findings(spark)).collect()}
    assert text["r"] == c.NO_FINDINGS
    assert text["p"] == f"Subpergunta: solo\nResposta: {LONG}\nFontes: página 2\nErro: nenhum"
    assert "Fontes: nenhuma\nErro: nenhum" in text["q"] and text["q"].endswith("Erro: boom")
    judged = fo.sufficiency(questions(spark), findings(spark))
    report = {r.question_id: r.report for r in fo.report_fallback(judged, findings(spark)).collect()}
    assert report["p"] == f"solo: {LONG}"
    assert report["r"] == c.NO_EVIDENCE_REPORT
    assert report["q"].endswith("five: x\n\nLimitações da pesquisa: four; five")


def corpus(spark):
    rows = [("c", i, t) for i, t in enumerate(["red fox", "blue whale", "green tree"])]
    chunks = spark.createDataFrame(rows, "collection_id string, chunk_id bigint, text string").selectExpr(
        "*", "'s' source", "'csv' file_type", "'csv_rows' chunking", "cast(null as int) page", "cast(null as array<int>) pages",
        "cast(chunk_id + 2 as bigint) row_start", "cast(chunk_id + 2 as bigint) row_end",
    )
    return qa.build_corpus(chunks, with_vectors=False)


def asked(spark):
    rows = [("1", "c", "red whale", 3), ("2", "c", "nothing", 1), ("3", "c", "nothing", 2), ("4", "c", "nothing", 3)]
    return spark.createDataFrame(rows, "question_id string, collection_id string, question string, depth int")


def test_rounds_stop_as_they_should(spark):
    result = research.research_rounds(corpus(spark), asked(spark))
    judged = {r.question_id: (r.is_sufficient, r.rounds_completed) for r in result.judged.collect()}
    assert judged == {"1": (True, 1), "2": (False, 1), "3": (False, 2), "4": (False, 3)}
    found = sorted((r.question_id, r.round, r.subquestion) for r in result.findings.collect())
    once, twice = c.REFINEMENT_PREFIX + "nothing", c.REFINEMENT_PREFIX * 2 + "nothing"
    assert [f for f in found if f[0] == "4"] == [("4", 1, "nothing"), ("4", 2, once), ("4", 3, twice)]
    response = {r.question_id: r for r in research.research_report(asked(spark), result).collect()}
    assert response["1"].answer.startswith("red whale: [Linha ") and response["1"].sources[0].row_start == 2
    assert response["4"].answer == c.NO_EVIDENCE_REPORT and response["4"].missing_information == ["nothing", once, twice]


def test_rounds_with_plugins(spark):
    plan = lambda: lambda prompts: ["- red\n- tree" for _ in prompts]
    refine = lambda: lambda prompts: ["- RED\n- blue" if "red whale" in p else "" for p in prompts]
    judge = lambda: lambda prompts: [
        {"is_sufficient": "blue" in p.split("findings")[1], "reason": "r", "missing_information": list("abcde")} for p in prompts
    ]

    def write():
        def call(prompts):
            raise RuntimeError

        return call

    questions_ = asked(spark).where("question_id in ('1', '3')")
    agents = research.Agents(plan, judge, refine, write)
    result = research.research_rounds(corpus(spark), questions_, agents=agents)
    by_round = {}
    for r in result.findings.collect():
        by_round.setdefault((r.question_id, r.round), []).append(r.subquestion)
    assert sorted(by_round[("1", 1)]) == ["red", "red whale", "tree"] and by_round[("1", 2)] == ["blue"]
    assert sorted(by_round[("3", 2)]) == [c.REFINEMENT_PREFIX + gap for gap in "abcd"]
    judged = {r.question_id: r for r in result.judged.collect()}
    assert judged["1"].is_sufficient and judged["1"].missing_information == list("abcd")
    report = {r.question_id: r.report for r in research.write_report(questions_, result, write).collect()}
    assert report["1"].startswith("red whale: ")


def test_failed_search_is_a_finding(spark):
    def score():
        def call(query, texts, top_n):
            if query == "red":
                raise ConnectionError
            return [{"index": 0, "relevance_score": 1.0}]

        return call

    searches = spark.createDataFrame([("1", "c", 1, 0, "red"), ("1", "c", 1, 1, "tree"), ("1", "c", 1, 2, "tree")], "question_id string, collection_id string, round int, ord int, query string")
    got = research.search(corpus(spark), searches, qa.Models(score=score)).orderBy("ord").collect()
    assert [(r.evidence_count, r.error) for r in got] == [(0, c.SEARCH_FAILED_ERROR), (1, None), (1, None)]
    assert got[0].answer == c.SEARCH_FAILED_ANSWER and got[1].answer == "[Linha 4] green tree"


def test_no_question_gives_empty_tables(spark):
    none = spark.createDataFrame([], "question_id string, collection_id string, question string, depth int")
    result = research.research_rounds(corpus(spark), none)
    assert result.findings.count() == 0 and result.judged.count() == 0
    assert research.research_report(none, result).count() == 0
