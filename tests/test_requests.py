"""Requests: the first check that fails decides, and models see only what passed all of them."""

import pytest

from evispan.constants import QUESTION_FIELD, EMPTY_VIOLATION, SEARCH_FAILED_ANSWER
from evispan.plans import quick_answer as qa
from evispan.plans.requests import request_outcomes

REQUESTS = "question_id bigint, collection_id string, question string, depth int"


@pytest.fixture(scope="module")
def built(spark):
    chunks = spark.createDataFrame([("a", 0, "red fox"), ("a", 1, "blue whale")], "collection_id string, chunk_id bigint, text string").selectExpr(
        "*", "'s' source", "'pdf' file_type", "'c' chunking", "0 page", "array(1) pages", "cast(null as bigint) row_start", "cast(null as bigint) row_end", "1 n_tokens"
    )
    return qa.build_corpus(chunks, with_vectors=False)


def test_the_first_failing_check_decides(spark, built):
    rows = [
        (1, "a", "  red  ", None), (2, "zz", "red", None), (3, "zz", "a bomba", None), (4, "zz", "xx", None), (5, "a", "red", 9), (6, None, "red", 1),
        (7, "a", None, 1), (8, "a", "    ", 2), (9, "a", "no such word", 3), (10, "a", "x" * 2001, 1),
    ]
    asked = spark.createDataFrame(rows, REQUESTS).repartition(3)
    got = {r.id: r for r in request_outcomes(built, asked, built.index.stats, ["bomba"]).collect()}
    codes = {1: 200, 2: 404, 3: 422, 4: 422, 5: 422, 6: 404, 7: 422, 8: 422, 9: 200, 10: 422}
    assert {int(i): r.status_code for i, r in got.items()} == codes
    assert (got["4"].detail, got["5"].detail, got["7"].detail) == ("question", "depth", "question")
    assert got["8"].detail == f"Entrada rejeitada: {QUESTION_FIELD}{EMPTY_VIOLATION}."
    assert got["1"].answer == "[Página 1] red fox" and got["9"].sources == []
    assert all(r.answer is None and r.sources == [] for r in got.values() if r.status_code != 200)
    assert request_outcomes(built, asked.limit(0), built.index.stats).collect() == []


def test_models_see_only_what_passed(spark, built, tmp_path):
    seen = str(tmp_path)

    def note(name):
        def factory():
            def call(texts):
                with open(f"{seen}/{name}", "a") as out:
                    out.writelines(text.replace("\n", " ") + "\n" for text in texts)
                if name == "classify":
                    return [text.startswith("sly") for text in texts]
                if any("crash" in text for text in texts):
                    raise RuntimeError("model down")
                return ["said"] * len(texts)

            return call

        return factory

    rows = [(1, "a", "red fox", None), (2, "zz", "lost red", None), (3, "a", "a bomba", None), (4, "a", "sly red", None), (5, "a", "crash red", None)]
    asked = spark.createDataFrame(rows, REQUESTS)
    models = qa.Models(generate=note("generate"))
    got = {r.id: r for r in request_outcomes(built, asked, built.index.stats, ["bomba"], note("classify"), models).collect()}
    assert {i: r.status_code for i, r in got.items()} == {"1": 200, "2": 404, "3": 422, "4": 422, "5": 200}
    assert got["1"].answer == "said" and got["1"].error is None
    assert got["5"].answer == SEARCH_FAILED_ANSWER and got["5"].error
    classified = open(f"{seen}/classify").read()
    generated = open(f"{seen}/generate").read()
    assert "bomba" not in classified and "lost" in classified
    assert not any(word in generated for word in ("bomba", "lost", "sly")) and "red fox" in generated
