import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from evispan.functions import labels, text as tx
from evispan.functions.stopwords import stopwords

SAMPLES = [
    "", " ", "ASCII Only", "Ação é não", "Straße ẞ ﬁne", "ÅÉÎÕÜ ñ Ç", "½ cup² x₃", "한국어 텍스트", "ΑΣΣ ς Ωμέγα",
    "İstanbul ı", "é combining", "ǅ Ĳ ŉ …", "हिन्दी", "ｆｕｌｌ　ｗｉｄｔｈ", "µm ¨", "a_b-c d'e", "Ж й ё", "𝔘nicode 𝟙",
]


def frame(spark, values, name="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def column(spark, values, expression):
    return [r[1] for r in sorted(frame(spark, values).select("i", expression.alias("o")).collect())]


# What each sample becomes, written by hand; Korean syllables come apart into their letters.
FOLDED = [
    "", " ", "ascii only", "acao e nao", "strasse ss fine", "aeiou n c", "1\u20442 cup2 x3",
    "\u1112\u1161\u11ab\u1100\u116e\u11a8\u110b\u1165 \u1110\u1166\u11a8\u1109\u1173\u1110\u1173", "ασσ σ ωμεγα",
    "istanbul ı", "e combining", "dz ij \u02bcn ...", "\u0939\u093f\u0928\u0926\u0940", "full width", "μm  ", "a_b-c d'e", "ж и е", "Unicode 1",
]
WORDS = [
    [], [], ["ascii", "only"], ["acao", "e", "nao"], ["strasse", "ss", "fine"], ["aeiou", "n", "c"], ["1", "2", "cup2", "x3"],
    FOLDED[7].split(" "), ["ασσ", "σ", "ωμεγα"], ["istanbul", "ı"], ["e", "combining"], ["dz", "ij", "\u02bcn"],
    ["\u0939", "\u0928\u0926"], ["full", "width"], ["μm"], ["a", "b", "c", "d", "e"], ["ж", "и", "е"], ["Unicode", "1"],
]


def test_normalize_exact(spark):
    assert column(spark, SAMPLES, tx.normalize_text(F.col("t"))) == FOLDED


def test_normalize_native_equals_exact_in_its_ranges(spark):
    chars = [chr(code) for low, high in tx.NATIVE_RANGES for code in range(max(low, 1), high + 1)]
    assert column(spark, chars, tx.normalize_text(F.col("t"), exact=False)) == column(spark, chars, tx.normalize_text(F.col("t")))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\0"), max_size=12), min_size=40, max_size=80))
def test_normalize_and_tokenize_random(spark, texts):
    got = column(spark, texts, tx.normalize_text(F.col("t")))
    assert not any(unicodedata.combining(ch) for text in got for ch in text)
    assert [g for g, t in zip(got, texts) if t.isascii()] == [t.lower() for t in texts if t.isascii()]
    # A text is folded letter by letter.
    letters = sorted({ch for t in texts for ch in t})
    alone = dict(zip(letters, column(spark, letters, tx.normalize_text(F.col("t")))))
    joined = ["".join(alone[ch] for ch in t) for t in texts]
    assert [sorted(g) for g in got] == [sorted(j) for j in joined]


def test_tokenize(spark):
    got = column(spark, SAMPLES, tx.tokenize(tx.normalize_text(F.col("t"))))
    assert got == WORDS


def test_stopwords_keep_repeats_and_accented_entries_never_match(spark):
    assert "não" in stopwords() and "nao" in stopwords(fold=True)
    tokens = tx.tokenize(tx.normalize_text(F.col("t")))
    value = ["não sim de sim de casa casa"]
    assert column(spark, value, tx.remove_stopwords(tokens, stopwords())) == [["nao", "sim", "sim", "casa", "casa"]]
    assert column(spark, value, tx.remove_stopwords(tokens, stopwords(fold=True))) == [["sim", "sim", "casa", "casa"]]
    assert column(spark, value, tx.remove_stopwords(tokens, [])) == [["nao", "sim", "de", "sim", "de", "casa", "casa"]]


def test_term_counts(spark):
    texts = ["b a b c a b", "", "x", "z z z"]
    got = column(spark, texts, tx.term_counts(tx.tokenize(F.col("t"))))
    assert [[tuple(r) for r in row] for row in got] == [sorted(Counter(t.split()).items()) for t in texts]


def test_whitespace_rules_equal_python(spark):
    every = "".join(chr(code) for code in range(1, 0x3001) if chr(code).isspace())
    assert set(every) == set(tx.WHITESPACE)
    texts = [f"{every}a{every}b{every}", every, "a", "  lead and trail  "]
    assert column(spark, texts, tx.strip(F.col("t"))) == [t.strip() for t in texts]
    assert column(spark, texts, tx.collapse_whitespace(F.col("t"))) == [" ".join(t.split()) for t in texts]


def test_excerpt_and_summary(spark):
    texts = ["é " * 400, "one\n\ntwo\n\nthree", "x" * 700, "\n\nlate"]
    assert column(spark, texts, tx.excerpt(F.col("t"))) == [" ".join(t.split())[:300] for t in texts]
    assert column(spark, texts, tx.short_summary(F.col("t"))) == [t.split("\n\n", maxsplit=1)[0][:500] for t in texts]


def test_casefold(spark):
    assert column(spark, SAMPLES, tx.casefold(F.col("t"))) == [t.casefold() for t in SAMPLES]
    assert column(spark, SAMPLES, tx.compat_casefold(F.col("t"))) == [unicodedata.normalize("NFKC", t).casefold() for t in SAMPLES]


def test_split_lines(spark):
    texts = ["a\nb\r\nc\rd\x0be f", "one"]
    assert column(spark, texts, tx.split_lines(F.col("t"))) == [t.splitlines() for t in texts]


@pytest.mark.parametrize(
    "page, start, end, chunk, source",
    [
        (0, None, None, "Página 1", "página 0"),
        (4, 2, 2, "Linha 2", "linha 2"),
        (None, 2, 5, "Linhas 2-5", "linhas 2-5"),
        (None, 3, None, "Linha 3", "linha 3"),
        (None, 3, 0, "Linhas 3-0", "linha 3"),
        (None, None, None, None, "página none"),
    ],
)
def test_location_labels(spark, page, start, end, chunk, source):
    row = spark.createDataFrame([(page, start, end)], "page int, a int, b int").select(
        labels.document_location(F.col("page"), F.col("a"), F.col("b")), labels.source_location(F.col("page"), F.col("a"), F.col("b"))
    ).first()
    assert tuple(row) == (chunk, source)
