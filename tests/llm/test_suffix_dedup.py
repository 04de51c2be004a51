"""Repeated byte strings: the suffix array, the operator and its query against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from evispan.llm.queries import LLM_QUERIES
from evispan.llm.suffix_array import big_words, repeated_starts, small_suffixes, suffix_array
from evispan.llm.suffix_dedup import Cutter, merged, suffix_dedup

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    """(bytes kept, maximal removed runs) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        edges = np.flatnonzero(np.diff(np.r_[0, np.frombuffer(bytes(gone), np.uint8), 0].astype(np.int8))).tolist()
        out.append((bytes(b for b, g in zip(r, gone) if not g), list(zip(edges[::2], edges[1::2]))))
    return out


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=80).map(lambda b: bytes(1 + x % 3 for x in b)))
def test_suffix_array_is_sorted(text):
    data = np.frombuffer(text, np.uint8)
    assert small_suffixes(data).tolist() == [i + 1 < len(text) and text[i:] < text[i + 1 :] for i in range(len(text))]
    assert suffix_array(data, big_words(data, 100), 88).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab\0", min_size=12, max_size=60), min_size=1, max_size=6), st.integers(8, 12))
def test_repeated_starts_equal_brute_force(texts, length):
    raw = [t.encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    want = [i <= len(r) - length and seen[r[i : i + length]] > 1 for r in raw for i in range(len(r))]
    assert repeated_starts(raw, [len(r) - length + 1 for r in raw], length).tolist() == want


def test_equal_windows_share_a_key():
    rng = random.Random(3)
    shared = bytes(rng.randrange(97, 123) for _ in range(300))
    texts = [bytes(rng.randrange(97, 123) for _ in range(rng.randrange(100))) + shared + bytes([c]) * 250 for c in b"xyx"]
    cutter, keys, windows = Cutter(200, 50), {}, 0
    for text, start, n, key, _ in zip(*(a.tolist() for a in cutter.cut(texts))):
        assert 0 < n <= cutter.width
        windows += n
        for i in range(start, start + n):
            assert keys.setdefault(texts[text][i : i + 200], key) == key
    assert windows == sum(len(t) - 199 for t in texts)


def test_merged_runs():
    assert merged(np.array([5, 0, 7, 20]), np.array([9, 2, 12, 21])) == [(0, 2), (5, 12), (20, 21)]
    assert merged(np.array([2, 0]), np.array([4, 2])) == [(0, 4)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "é", "日本", "x"]) + str(rng.randrange(10**6)) for _ in range(n))
    passage, copy = words(40), words(200)
    out = [(i, f"{words(rng.randrange(30))} {passage} {words(5)}") for i in range(60)]  # a hot passage, other neighbours
    out += [(100 + i, copy) for i in range(40)] + [(200 + i, copy.replace("alpha", "omega", i + 1)) for i in range(20)]
    out += [(300, None), (301, ""), (302, "short"), (303, "z" * 3_000), (None, words(60)), (None, None), (304, "ab" * 400)]
    out += [(305, words(60))] * 2 + [(306, words(8_000))]
    out += [(400 + i, f"{words(40)} {(words(2) + ' ') * (200 // (8 + i) + 8)} {words(40)}") for i in range(12)]  # repeats in themselves
    return out


@pytest.mark.parametrize("key_bytes", [1 << 21, 1_000])
def test_operator_equals_brute_force(make, rows, key_bytes, monkeypatch):
    """Also where keys are too crowded for a task, and with extra columns."""
    docs = make([(i, t) for i, t in rows]).selectExpr("*", "1 AS key", "'x' AS spans", "2 AS k1")
    got = suffix_dedup(docs, key_bytes=key_bytes).collect()
    want = brute([t for _, t in rows], 200)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = [(i, len((t or "").encode()), len(spans), spans, kept) for (i, t), (kept, spans) in zip(rows, want)]
    got = [(r.doc_id, r.n_bytes, r.n_spans, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in got]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_table(make):
    assert suffix_dedup(make([])).collect() == []


def test_query_equals_brute_force(spark):
    got = LLM_QUERIES["op11_suffix_dedup"](spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc, (kept, spans) in zip(docs, brute([d.text for d in docs], 200)):
        row, n = got.loc[doc.doc_id], len((doc.text or "").encode())
        assert (row.n_bytes, row.n_removed, row.n_spans) == (n, n - len(kept), len(spans))
        assert row.kept_sha256 == hashlib.sha256(kept).hexdigest()
