"""Cross-tokenizer alignment: the operator and its query against brute force over token occurrences."""

import hashlib
from collections import Counter

import pytest

from evispan.llm import alignment
from evispan.llm.alignment import ByteLevel, Pieces, cross_tokenizer_alignment
from evispan.llm.queries import LLM_QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def sha(groups):
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def test_fast_encoder_splits_like_the_file(spark):
    """Every code point between letters, digits, signs and spaces; a sixteenth of them here (all agreed)."""
    own = ByteLevel(A)
    for c in [*range(0x3400), *range(0x3400, 0x110000, 16)]:
        if not 0xD800 <= c <= 0xDFFF:
            text = "a{0}a 1{0}1 .{0}. {0} {0}{0}'s <|endoftext|>".format(chr(c))
            assert own.encode([text])[0] == own.encode_slowly(text), hex(c)


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    sides = [ByteLevel(A), Pieces(B)]
    sides[0].encode = lambda texts: [sides[0].encode_slowly(t) for t in texts]
    spelled = [s.token_bytes() for s in sides]
    facts = []
    for text in texts:
        ids = [s.encode([text])[0] if text else [] for s in sides]
        joined = [b"".join(map(t.__getitem__, i)) for t, i in zip(spelled, ids)]
        if not text or joined[0] != b" " + text.encode() or joined[1] != joined[0]:
            facts.append(([], [], [], ""))
            continue
        spans = []
        for t, own in zip(spelled, ids):
            at, out = 0, []
            for i in own:
                out.append((at, at + len(t[i]), i))
                at += len(t[i])
            spans.append(out)
        links, first = [], 0
        for start, stop, a in spans[0]:
            while spans[1][first][1] <= start:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][0] < stop:
                links.append((a, spans[1][k][2]))
                k += 1
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        ends = [{e: n for n, (_, e, _) in enumerate(s)} for s in spans]
        last = [0, 0]
        for e in both:
            now = [x[e] + 1 for x in ends]
            groups.append("|".join(",".join(str(i) for _, _, i in s[f:n]) for s, f, n in zip(spans, last, now)))
            last = now
        facts.append((ids[0], ids[1], links, ";".join(groups)))
    count = Counter(p for f in facts for p in set(f[2]))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    return [
        (len(a), len(b), g.count(";") + 1 if g else 0, len(l), sum(count[p] == top[p[0]] for p in l), sum(count[p] for p in l), g)
        for a, b, l, g in facts
    ]


ROWS = [
    (1, None), (2, ""), (3, " "), (4, "plain words, twice: plain words"), (4, "plain words, twice: plain words"),
    (5, "Überraschung naïve 日本語 😀 é"), (6, "<|endoftext|> and <s> <unk> </s> <0x41>"), (7, "▁ low line"), (None, "plain words"),
    (None, None), (8, "\n\n\t  tabs \r\n and spaces   "), (9, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40), (10, "word " * 30_000), (11, "x"), (12, "\x00\x01"),
]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("held", [alignment.HELD_PAIRS, 3])
def test_operator_equals_brute_force(make, held, monkeypatch):
    """Also with texts aligned one by one, partial counts handed on early and counts that don't fit."""
    if held == 3:
        monkeypatch.setattr(alignment, "PART_BYTES", 1)
        monkeypatch.setattr(alignment, "TASK_PAIRS", 4)
    docs = make(ROWS).selectExpr("*", "'x' AS links", "1 AS row", "2 AS n_a")
    got = cross_tokenizer_alignment(docs, A, B, spelled=True, held=held).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = [(i, *facts) for (i, _), facts in zip(ROWS, brute([t for _, t in ROWS]))]
    assert sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in got), key=key) == sorted(want, key=key)
    assert all(r.groups_sha256 == sha(r.groups) for r in got)
    assert {r.doc_id for r in got if r.n_a} >= {4, 5, 6, 8, 9, 10, 11}


def test_empty_table(make):
    assert cross_tokenizer_alignment(make([]), A, B).collect() == []


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in LLM_QUERIES["op13_alignment"](spark, SF).collect()}
    assert len(got) == len(docs)
    for doc, (*numbers, groups) in zip(docs, brute([d.text for d in docs])):
        row = got[doc.doc_id]
        assert [row[c] for c in COLUMNS[:-1]] == numbers
        assert row.groups_sha256 == sha(groups)
