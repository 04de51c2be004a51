from pyspark.sql import functions as F

from evispan import constants as c
from evispan.functions import guardrails as rules
from evispan.functions.text import compat_casefold
from evispan.operators import guardrail

TERMS = ["Bomba", "café", "c++", "a b"]
TEXTS = [
    "uma BOMBA aqui", "bombardeio", "cafe", "café.", "ＢＯＭＢＡ", "xcafé", "uso c++ sim", "a b", "a  b", "_bomba", "bomba2", "", "   ", "ok",
]


def frame(spark, values):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "question_id string, question string")


# The terms found in each text, written by hand.
FOUND = [["Bomba"], [], [], ["café"], ["Bomba"], [], ["c++"], ["a b"], [], [], [], [], [], []]


def test_blocked_terms(spark):
    got = frame(spark, TEXTS).select("question_id", rules.blocked_terms(compat_casefold(F.col("question")), TERMS).alias("b")).collect()
    assert [r.b for r in sorted(got, key=lambda r: int(r.question_id))] == FOUND


def test_decision_and_enforcement(spark):
    texts = ["  fine  ", "", "x" * 2000, "x" * 2001, "x" + " " * 2000, "bomba " + "y" * 2000]
    decided = guardrail.guardrail_decision(frame(spark, texts), terms=TERMS)
    accepted, rejects = guardrail.guardrail_enforce(decided)
    assert {r.question_id: r.question for r in accepted.collect()} == {"0": "fine", "2": "x" * 2000}
    too_long = "pergunta excede o limite de 2000 caracteres"
    assert {r.id: r.detail for r in rejects.collect()} == {
        "1": "Entrada rejeitada: pergunta não pode estar vazio.",
        "3": f"Entrada rejeitada: {too_long}.",
        "4": f"Entrada rejeitada: {too_long}.",
        "5": f"Entrada rejeitada: {too_long}; o texto contém conteúdo não permitido.",
    }


def test_semantic_check_asks_only_about_allowed_texts_and_fails_open(spark):
    def factory():
        def call(texts):
            assert not any("bomba" in t for t in texts)
            if "crash" in texts:
                raise RuntimeError
            return ["b0mba" in t for t in texts]

        return call

    decided = guardrail.guardrail_decision(frame(spark, ["bomba", "b0mba", "crash", "ok"]).repartition(4, "question_id"), terms=TERMS)
    got = {r.question_id: (r.allowed, r.reason) for r in guardrail.semantic_check(decided, "question", factory, TERMS).collect()}
    assert got["0"] == (False, c.BLOCKED_VIOLATION) and got["1"] == (False, c.BLOCKED_VIOLATION)
    assert got["2"] == (True, c.SEMANTIC_UNAVAILABLE_REASON)
    assert guardrail.semantic_check(decided, "question", factory, []) is decided


def test_semantic_check_keeps_the_verdict(spark):
    def factory():
        return lambda texts: [{"refused": t == "bad", "reason": "why", "violations": list("abcdefg")} for t in texts]

    decided = guardrail.guardrail_decision(frame(spark, ["bad", "ok"]), terms=TERMS)
    got = {r.question: (r.allowed, r.reason, r.violations) for r in guardrail.semantic_check(decided, "question", factory, TERMS).collect()}
    assert got["bad"] == (False, "why", list("abcde")) and got["ok"][0] and got["ok"][2] == []


def test_term_list(spark):
    raws = ['["a", " b ", ""]', "a, b ,,c", "", "  ", "[]", "[1]", '["a", 1]', '{"a": 1}', "12", '"text"', "not json", "null"]
    got = frame(spark, raws).select("question_id", rules.blocked_term_list(F.col("question")).alias("t")).collect()
    want = [["a", "b"], ["a", "b", "c"], [], [], [], None, None, None, None, None, ["not json"], None]
    assert [r.t for r in sorted(got, key=lambda r: int(r.question_id))] == want


def test_request_validation(spark):
    df = spark.createDataFrame(
        [("1", "abc", None), ("2", "ab", 1), ("3", "abc", 4), ("4", "abc", 0), ("5", None, 2)], "question_id string, question string, depth int"
    )
    valid, rejects = guardrail.validate_requests(df)
    assert [(r.question_id, r.depth) for r in valid.collect()] == [("1", 2)]
    assert sorted((r.id, r.detail) for r in rejects.collect()) == [("2", "question"), ("3", "depth"), ("4", "depth"), ("5", "question")]
