"""Operators on small tables: edge cases, brute force, and what layout and size must not change."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispan.llm import lattice, quality, sharding, toxicity
from evispan.llm.decontaminate import WuManber, contamination, decontaminate, item_words, windows_of
from evispan.llm.exact_dedup import chunk_pattern, exact_dedup
from evispan.llm.line_dedup import host_of, line_dedup
from evispan.llm.linear import training_rows
from evispan.llm.lm_score import lattice_scores
from evispan.llm.minhash import block_links, components, linked, near_duplicates
from evispan.llm.packing import pack, pack_sizes
from evispan.llm.queries import tokenizer_path
from evispan.llm.sharding import fill_level, shard
from evispan.llm.warc_store import read_records, record_bytes, write_archive

PIECES = tokenizer_path("piece_bpe_32k.model")


def random_text(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# exact dedup


def brute_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    return groups


def test_exact_dedup(make, odd_rows):
    rows = exact_dedup(make(odd_rows).withColumn("recipe", F.lit(1)).withColumn("id", F.lit(2))).collect()
    groups = brute_exact(odd_rows)
    assert len(rows) == len(odd_rows)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): sorted(v) for k, v in groups.items()}
    for r in rows:
        own = by_hash[r.text_sha256]
        assert r.keep_id == own[0][3] and r.group_size == len(own)
    assert [r.kept for r in rows if r.doc_id == 4] == [True, True] and not any(r.kept for r in rows if r.doc_id is None)
    assert exact_dedup(make(odd_rows).limit(0)).collect() == []


def test_exact_dedup_of_columns_with_dots(make):
    docs = make([(1, "a b"), (2, "ab")]).withColumnsRenamed({"text": "page.text", "doc_id": "page.id"})
    rows = exact_dedup(docs, "page.id", "page.text").collect()
    assert sorted((r["page.id"], r.keep_id, r.kept) for r in rows) == [(1, 1, True), (2, 1, False)]


def test_chunks_cover_text_and_resume_after_an_insertion():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40_000))
    cut = lambda t: [m.group(0) for m in re.finditer(chunk_pattern().replace("(?s)", ""), t, re.S)]
    chunks = cut(text)
    assert "".join(chunks) == text and max(map(len, chunks)) <= 4096
    later = cut(text[:5000] + "inserted" + text[5000:])
    assert len(set(chunks) & set(later)) > 0.7 * len(chunks)


# decontamination


def test_decontamination_against_brute_force(spark, make):
    rng = random.Random(5)
    items = [(1, random_text(rng, 30)), (2, random_text(rng, 13)), (3, "only four words here"), (4, ""), (5, None), (6, "x y"), (2, "w1 w2")]
    docs = [(i, random_text(rng, rng.randrange(60), 12)) for i in range(40)]
    docs += [(50, "Pre " + items[0][1].upper().replace(" ", "-- ") + " post"), (51, items[1][1] + " " + items[1][1]), (52, "ONLY four, words here! x y x y"), (53, None), (54, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    windows = [(i, tuple(w)) for i, t in items for w in brute_windows(item_words((t or "").encode()))]
    for limit in (10, 100_000):  # several blocks and one
        found = contamination(decontaminate(make(docs), bench, block_words=limit)).collect()
        assert len(found) == len(docs)
        for r in found:
            seq = item_words((dict(docs)[r.doc_id] or "").encode())
            hit, who = set(), set()
            for i, w in windows:
                for at in range(len(seq) - len(w) + 1):
                    if tuple(seq[at : at + len(w)]) == w:
                        hit.update(range(at, at + len(w)))
                        who.add(i)
            assert (r.n_words, r.n_hit, r.n_items) == (len(seq), len(hit), len(who)), r.doc_id
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, who))).encode()).hexdigest()
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(seq))


def brute_windows(seq):
    m = min(13, len(seq))
    return [seq[i : i + m] for i in range(len(seq) - m + 1)] if m else []


def test_decontamination_edges(spark, make, odd_rows):
    none = spark.createDataFrame([], "item_id bigint, text string")
    rows = contamination(decontaminate(make(odd_rows).withColumn("items", F.lit("mine")), none)).collect()
    assert len(rows) == len(odd_rows) and not any(r.contaminated for r in rows)
    assert decontaminate(make(odd_rows).limit(0), none).count() == 0


def test_items_may_have_ids_of_any_type(spark, make):
    passage = random_text(random.Random(2), 20)
    items = spark.createDataFrame([("b-2", passage), ("a-1", passage), (None, passage)], "item_id string, text string")
    docs = make([(1, f"before {passage} after"), (2, "clean")]).withColumns({"items": F.lit("mine"), "n_hit": F.lit("mine")})
    got = {r.doc_id: r for r in contamination(decontaminate(docs, items)).collect()}
    assert got[1]["items"] == ["a-1", "b-2"] and (got[1].n_hit, got[1].n_items, got[1].contaminated) == (20, 2, True)
    assert got[1].items_sha256 == hashlib.sha256(b"a-1,b-2").hexdigest() and got[2]["items"] == []


def test_search_skips_no_occurrence():
    rng = random.Random(2)
    for _ in range(200):
        m = rng.randrange(1, 6)
        seq = [b"%d" % rng.randrange(3) for _ in range(50)]
        windows = {tuple(b"%d" % rng.randrange(3) for _ in range(m)): [k] for k in range(4)}
        want = {(i, k) for w, (k,) in windows.items() for i in range(50 - m + 1) if tuple(seq[i : i + m]) == w}
        assert {(i, k) for i, (k,) in WuManber(windows, m).search(seq)} == want
    assert windows_of([(1, b"!!"), (2, b"a B")]) == {2: {(b"a", b"b"): [2]}}


# packing


def test_pack_sizes_against_the_rule():
    rng, sequence = np.random.default_rng(4), 32
    sizes = rng.integers(1, sequence, 400)
    window, offset = pack_sizes(sizes, sequence)
    fill = {}
    for s, w, o in zip(sizes, window, offset):
        levels = {}
        for x in fill.values():
            if 0 < x < sequence:
                levels[x] = levels.get(x, 0) + 1

        def squares(h):
            after = dict(levels)
            if h:
                after[h] -= 1
            if h + s < sequence:
                after[h + s] = after.get(h + s, 0) + 1
            return sum(n * n for n in after.values())

        choices = [0, *(h for h, n in levels.items() if n and h + s <= sequence)]
        least = min(map(squares, choices))
        assert fill.get(w, 0) == o and o == max(h for h in choices if squares(h) == least)
        fill[w] = o + s
    assert max(fill.values()) <= sequence


def test_packing_edges(make, odd_rows):
    rows = pack(make(odd_rows).withColumn("start", F.lit("clash")), tokenizer_path(), group_pieces=7).collect()
    assert sum(r.start == 0 for r in rows) == len(odd_rows)
    assert {r.doc_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    for r in rows:
        if r.doc_id == 1:
            assert r.ids_crc32 == zlib.crc32((2).to_bytes(4, "little"))
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 4096
    assert pack(make(odd_rows).limit(0), tokenizer_path()).collect() == []


# near-duplicates


def brute_near(rows, size, percent=80):
    sets = []
    for _, t in rows:
        seq = (t or "").encode().lower().split()
        n = min(size, len(seq))
        sets.append({tuple(seq[i : i + n]) for i in range(len(seq) - n + 1)} if n else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = rows[i][1] is not None and both and both == len(sets[i]) == len(sets[j])
            ids = rows[i][0] is not None and rows[j][0] is not None
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and (ids or same):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    smallest = {}
    for x, (d, _) in zip(label, rows):
        if d is not None:
            smallest[x] = min(d, smallest.get(x, d))
    return sorted(((d, len(s), smallest.get(x, d) if s else d) for (d, _), s, x in zip(rows, sets, label)), key=repr)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_brute_force(make, size):
    rng = random.Random(size)
    rows = []
    for g in range(6):
        base = random_text(rng, 60, 500).split()
        for k in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            rows.append((100 * g + k, " ".join(copy)))
    rng.shuffle(rows)
    for block_bytes in (5_000, 1 << 24):
        got = near_duplicates(make(rows), size=size, block_bytes=block_bytes).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_near(rows, size)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicate_edges(make, odd_rows):
    got = near_duplicates(make(odd_rows).withColumn("node", F.lit(1)).withColumn("digest", F.lit("d")), size=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_near(odd_rows, 2)
    assert near_duplicates(make(odd_rows).limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    n = 60
    edges = [(i, i + 1) for i in range(0, n)] + [(200, 201), (7, 7)]
    random.Random(1).shuffle(edges)
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(n + 1)}, 200: 200, 201: 200}


def test_block_links_compare_all_pairs_of_different_labels():
    sets = [np.arange(i, i + 100, dtype=np.uint64) for i in (0, 5, 10, 15, 500)]
    nodes = np.arange(5)
    assert linked(sets[0], sets[1], 80) and not linked(sets[0], sets[3], 80)
    found = block_links(nodes, nodes, sets, 80, np.array([0, 1, 1, 1, 1], bool))
    reached = {0}
    for _ in range(5):
        reached |= {y for a, b in found for x, y in ((a, b), (b, a)) if x in reached}
    assert reached == {0, 1, 2, 3} and len(found) == 3


# sharding


def test_shards_with_a_hot_text(make):
    rows = [(i, "hot text") for i in range(300)] + [(1000 + i, f"text {i} " * (1 + i % 7)) for i in range(600)] + [(None, None), (5000, None), (5001, "")]
    for max_rows in (5, 1_000_000):
        got = shard(make(rows).withColumn("key", F.lit("clash")), 8, max_cell_rows=max_rows).toPandas()
        load = got.groupby("shard")["size"].sum()
        assert len(got) == len(rows) and load.max() - load.min() < 0.15 * load.mean()
        for _, own in got.groupby("shard"):
            assert sorted(own.slot) == list(range(len(own)))
    # A text with half of all bytes can't stay in one shard.
    got = shard(make([(i, "y" * 50) for i in range(400)] + [(1000 + i, f"z{i}") for i in range(100)]), 4).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 4 and load.max() < 1.2 * load.mean()
    assert shard(make(rows).limit(0)).collect() == []
    assert shard(make([(1, "a")])).collect()[0].slot == 0


def test_fill_level():
    assert fill_level([0.0, 0.0], 10) == 5 and fill_level([8.0, 0.0], 4) == 4 and fill_level([8.0, 0.0], 12) == 10


# lines


def test_line_dedup(make):
    rows = [(i, f"own {i}\n  Footer here \nnext {i % 3}\n\nFooter here", "a") for i in range(20)]
    rows += [(100 + i, f"own {i}\nFooter here", "b") for i in range(4)]  # too few pages
    rows += [(200, None, "a"), (201, "Footer here", None), (202, "", "a"), (203, "Footer here", "a")]
    got = {r.doc_id: r for r in line_dedup(make(rows), F.col("source"), ratio=0.5).collect()}
    assert len(got) == len(rows)
    assert got[3].text == "own 3\nnext 0\n" and got[3].n_dropped == 2
    assert got[101].text == "own 1\nFooter here" and got[201].text == "Footer here" and got[200].text is None
    assert (got[202].text, got[203].text, got[203].n_dropped) == ("", "", 1)
    assert line_dedup(make(rows).limit(0), F.col("source")).collect() == []


def test_line_dedup_repeated_rows_long_text_and_clashing_names(make):
    long_text = "Footer here\n" + "\n".join(f"line {i}" for i in range(50_000))
    docs = make([(1, "x\nFooter here", "a")] * 6 + [(2, long_text, "a")])
    helpers = ("host_of_page", "lines_of_host", "Kept_Lines", "_kept_lines", "_host_of_page", "host", "lines", "line", "pages", "n")
    got = line_dedup(docs.withColumns({c: F.lit(f"own {c}") for c in helpers}), F.col("source"), ratio=0.5)
    assert got.columns == [*docs.columns, *helpers, "n_dropped"]
    rows = got.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in helpers)
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, "")] * 6 + [(2, long_text[len("Footer here\n") :])]


def test_host(spark):
    df = spark.createDataFrame([("https://U@Ex.org:8080/a?b",), ("nonsense",), (None,), ("http:///x",)], "u string")
    assert [r[0] for r in df.select(host_of(F.col("u"))).collect()] == ["ex.org", None, None, None]


# language model


def test_lattice_sums_all_segmentations():
    pieces = lattice.Pieces([b" ", b" a", b"a", b"ab", b"b", b"aba"], np.arange(6.0))
    p = np.array([0.1, 0.2, 0.2, 0.2, 0.2, 0.1])

    def brute(text, at=0):
        if at == len(text):
            return 1.0
        return sum(p[i] * brute(text, at + len(x)) for i, x in enumerate(pieces.pieces) if text.startswith(x, at))

    words = [b"a", b"ab", b"abab", b"bbb", b"aba" * 4]
    got = np.exp(lattice.word_scores(words, pieces, np.log(p)))
    assert np.allclose(got, [brute(b" " + w) for w in words])
    counts = lattice.expected_counts(words, np.array([2.0, 1, 1, 3, 1]), pieces, np.log(p))
    covered = counts @ np.array([len(x) for x in pieces.pieces])
    assert np.isclose(covered, sum(n * (len(w) + 1) for n, w in zip([2, 1, 1, 3, 1], words)))


def test_every_piece_of_the_vocabulary_is_in_the_lattice():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    named = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    wanted = {n.replace("\u2581", " ").encode() for n in named}
    pieces = lattice.load_pieces(PIECES)
    assert {w for w in wanted if b" " not in w[1:]} <= set(pieces.pieces) and pieces.longest == max(map(len, pieces.pieces))
    long = max(pieces.pieces, key=len)
    logp = np.where(np.array([p == long for p in pieces.pieces]), np.log(0.5), -np.inf)
    assert np.isclose(lattice.word_scores([long[1:]], pieces, logp)[0], np.log(0.5)) == (long[:1] == b" ")


def test_lattice_scores_do_not_depend_on_what_tasks_hold(make, odd_rows):
    docs = make(odd_rows).withColumn("word", F.lit("clash"))
    held = F.col("doc_id").isin(4, 9)
    few = {(r.doc_id, r.n_tokens): r for r in lattice_scores(docs, held, PIECES, held=0).collect()}
    many = lattice_scores(docs, held, PIECES).collect()
    assert len(many) == len(odd_rows)
    for r in many:
        o = few[r.doc_id, r.n_tokens]
        assert (r.n_known, r.train_tokens, r.held_out) == (o.n_known, o.train_tokens, o.held_out)
        assert np.isclose(r.score, o.score) and np.isclose(r.base_score, o.base_score) and np.isfinite(r.score)
    assert {r.n_tokens for r in many if r.doc_id in (1, 2, 3)} == {1}
    nothing = lattice_scores(docs, F.lit(True), PIECES).collect()
    assert {(r.n_known, r.train_tokens) for r in nothing} == {(0, 0)}
    assert lattice_scores(docs.limit(0), held, PIECES).collect() == []


# classifiers


def labelled(spark, make):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, random_text(rng, 40) + (" vile awful" if bad else " mild")))
        marks.append((i, int(bad)))
    return make(rows), spark.createDataFrame(marks + [(None, 1), (7, None), (99999, 1)], "doc_id bigint, mark int")


@pytest.mark.parametrize("train,score", [(quality.train, quality.quality_scores), (toxicity.train, toxicity.toxicity_scores)])
def test_classifiers_learn_and_score(spark, make, odd_rows, train, score):
    docs, marks = labelled(spark, make)
    model = train(training_rows(docs, marks, "mark", F.col("doc_id") % 5 != 1))
    rows = score(docs.withColumn("score", F.lit("clash")), model).join(marks.where("mark is not null"), "doc_id").where("doc_id % 5 = 1").collect()
    assert len(rows) == 60 and sum((r.score >= 0.5) == (r.mark == 1) for r in rows) >= 57
    odd = score(make(odd_rows), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.score <= 1 for r in odd)
    nothing = train(training_rows(docs, marks.limit(0), "mark", F.lit(True)))
    assert {r.score for r in score(make(odd_rows), nothing).collect()} == {0.5}


def test_quality_weights_do_not_depend_on_the_partitions(spark, make):
    docs, _ = labelled(spark, make)
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.col("text").contains("vile").cast("int").alias("label"))
    rows = rows.union(rows.where("id < 9"))
    one, other = (quality.train(rows.repartition(n, *by), bits=12, epochs=3) for n, by in ((2, ()), (8, ("text",))))
    assert one.any() and np.array_equal(one, other)


def test_one_shard_equals_updates_by_the_book(spark, make):
    """One epoch over one shard, against the update rule written out per coordinate."""
    docs, _ = labelled(spark, make)
    rows = docs.where("doc_id < 40").select(F.col("doc_id").alias("id"), "text", F.col("text").contains("vile").cast("int").alias("label"))
    got = quality.train(rows, bits=10, epochs=1, shards=1)
    listed = rows.orderBy(F.xxhash64("id", F.lit(1))).collect()
    features, z, n = quality.Features(10), [0.0] * 1025, [0.0] * 1025

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for k in np.random.default_rng(0).permutation(len(listed)):
        at, value = features.of(listed[k].text)
        pairs = [*zip(at.tolist(), value.tolist()), (1024, 1.0)]
        error = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in pairs))) - listed[k].label
        for i, v in pairs:
            g, w = error * v, weight(i)
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA * w
            n[i] += g * g
    assert np.allclose(got, [weight(i) for i in range(1025)], atol=1e-4)


def test_toxicity_features_are_code_point_grams():
    text = " ÄÄ Жук\t日本語\n\U0001f600A "
    plain = " ÄÄ Жук 日本語 \U0001f600a "
    grams = {plain[i : i + n] for n in (3, 4, 5) for i in range(len(plain) - n + 1)}
    found = toxicity.Grams(bits=24).of(text)
    assert len(found) == len(grams)
    whole = set(found.tolist())
    assert all(set(toxicity.Grams(bits=24).of(w).tolist()) <= whole for w in ("Жук", "жук"[:0], "日本語"))


def test_toxicity_ratios_and_fit_by_brute_force(spark, make):
    """Ratios and the fit's steps against dense arrays of all features of at least the least number of texts."""
    docs, _ = labelled(spark, make)
    rows = docs.where("doc_id < 60").select("text", F.col("text").contains("vile").cast("int").alias("label"))
    got, listed = toxicity.train(rows, bits=14, steps=5), rows.collect()
    x, y = np.zeros((len(listed), 1 << 14)), np.array([r.label for r in listed])
    for i, r in enumerate(listed):
        x[i, toxicity.Grams(14).of(r.text)] = 1
    used = x.sum(0) >= toxicity.LEAST_TEXTS
    x = x[:, used]
    ratio = np.log((x[y == 1].sum(0) + 1) / (y.sum() + 2)) - np.log((x[y == 0].sum(0) + 1) / ((1 - y).sum() + 2))
    x = x * ratio * toxicity.SCALE / np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))
    w, bias, move, move_bias = np.zeros(x.shape[1]), 0.0, 0.0, 0.0
    for _ in range(5):
        error = 1 / (1 + np.exp(-(x @ w + bias))) - y
        move = toxicity.MOMENTUM * move - toxicity.RATE * (x.T @ error / len(y) + toxicity.PENALTY * w)
        move_bias = toxicity.MOMENTUM * move_bias - toxicity.RATE * error.mean()
        w, bias = w + move, bias + move_bias
    assert np.array_equal(got.used, used)
    assert np.allclose(got.weights[used], w * ratio, atol=1e-3) and np.isclose(got.bias, bias, atol=1e-3)


def test_training_rows_are_bounded_and_layout_free(spark, make):
    docs, marks = labelled(spark, make)
    some = {r.id for r in training_rows(docs, marks, "mark", F.lit(True), most=50).collect()}
    again = {r.id for r in training_rows(docs.repartition(7), marks.repartition(5), "mark", F.lit(True), most=50).collect()}
    assert len(some) == 50 and some == again


# archive


def test_archive_round_trip(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/\r\nX-Evil: 2", "same"), (3, None, ""), (4, "u", None), (5, "http://a/5", "é\r\n\r\nWARC/1.1"), (5, "http://a/5", "é\r\n\r\nWARC/1.1"), (None, "n", "same"), (None, "n", "lone")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    records = read_records(spark, write_archive(pages))
    got = records.withColumn("record", record_bytes(records)).collect()
    assert len(got) == len(rows)
    seen = sorted((r.page_id or 0, r.record_type, r.refers_to or "", bytes(r.payload).decode()) for r in got)
    odd = rows[4][2]
    assert seen == sorted(
        [(1, "revisit", "2", "same"), (2, "response", "", "same"), (3, "revisit", "4", ""), (4, "response", "", "")]
        + [(5, "response", "", odd)] * 2
        + [(0, "revisit", "2", "same"), (0, "response", "", "lone")]
    )
    for r in got:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert body == bytes(r.payload)[:length] + b"\r\n\r\n" and (length == len(r.payload)) == (r.record_type == "response" or not r.payload)
        assert b"\r\nX-Evil" not in head
    small = read_records(spark, write_archive(pages, least=5)).collect()
    assert sum(r.record_type == "revisit" for r in small) == 0
    assert read_records(spark, write_archive(pages.limit(0))).collect() == []


def test_payloads_with_one_stated_digest_stay_apart(spark, monkeypatch):
    monkeypatch.setattr("evispan.llm.warc_store.base32_sha1", lambda payload: F.lit("A" * 32))
    rows = [(1, "u", "one"), (2, "u", "one"), (3, "u", "two"), (4, "u", "x" * 1_000_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = read_records(spark, write_archive(pages, date="2026-01-31T23:59:59Z")).orderBy("page_id").collect()
    assert [(bytes(r.payload).decode(), r.record_type, r.refers_to) for r in got] == [
        ("one", "revisit", "2"), ("one", "response", None), ("two", "response", None), ("x" * 1_000_000, "response", None)
    ]
    assert all(b"\r\nWARC-Date: 2026-01-31T23:59:59Z\r\n" in bytes(r.header) for r in got)


def test_shard_cuts_a_key_of_many_short_rows(make, monkeypatch):
    rows = [(i, None) for i in range(400)] + [(1000 + i, f"{i} " * 200) for i in range(800)]
    cells = []
    layout = sharding.layout
    monkeypatch.setattr(sharding, "layout", lambda found, shards: cells.extend(found) or layout(found, shards))
    got = sharding.shard(make(rows), 4).collect()
    assert sum(c.rows for c in cells) == len(got) == len(rows) and max(c.rows for c in cells) < 40
    assert len({r.shard for r in got if r.doc_id < 1000}) == 1
    for s in range(4):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))


def test_word_ids_equal_the_tokenizer_on_every_kind_of_text():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from evispan.llm.packing import WordIds, ids_of_texts

    rng = random.Random(5)
    signs = "abcXYZ019'`-_.,!?()<>|/\\\"#@\x00\x1c\x1f\x7f\t\n\x0b\x0c\r    éÉßİ日本😀  \u0085é'"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3_000)]
    texts += [f"a{c}B{c}'s 1{c}2 .{c}. {c} {c}{c} {c}\u0301" for c in map(chr, [*range(0x3000), *range(0x3000, 0x20000, 7)]) if not "\ud800" <= c <= "\udfff"]
    texts += [None, "", " ", "don't'sx 'sx -'s 12,345 it's we'LL <|endoftext|> a<|startoftext|>b", "x" * 5_000, "'" * 50]
    plain = Tokenizer.from_file(tokenizer_path())
    ids, offsets = ids_of_texts(pa.array(texts, pa.string()), WordIds(tokenizer_path(), limit=100), 2)
    assert len(offsets) == len(texts) + 1
    for text, a, b in zip(texts, offsets, offsets[1:]):
        assert ids[a:b].tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 2], text


def test_packing_does_not_depend_on_the_partitions(spark, make, odd_rows):
    from evispan.llm.packing import pack

    rows = odd_rows + [(None, "alpha beta gamma")] * 50
    runs = [sorted(map(repr, pack(make(rows, n), tokenizer_path(), group_pieces=10).collect())) for n in (2, 8)]
    assert runs[0] == runs[1] and len(runs[0]) >= len(rows)


def test_packing_encodes_whole_units_together():
    """Few calls for many words, with the ids of each word alone; odd ones among them are encoded as they are."""
    import pyarrow as pa

    from evispan.llm.packing import WordIds, pack_ids

    plain = [f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyzäñя" for b in ("", "x", "quo", "zzyq")] + ["'s", "''", "7", "…", "</"]
    odd = ["a_b", "<|endoftext|>", "é", "汉字", "\x1c", "İx", "12"]
    known = WordIds(tokenizer_path())
    inner, calls = known.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return inner.encode_batch_fast(texts, **options)

    known.tokenizer = Counted()
    flat, sizes = known.ids_of(plain + odd)
    assert sum(calls) <= 1 + len(odd)
    at = 0
    for word, n in zip(plain + odd, sizes.tolist()):
        assert flat[at : at + n].tobytes() == pack_ids(inner.encode(word, add_special_tokens=False).ids), word
        at += n
    known = WordIds(tokenizer_path())
    known.ends = None  # a vocabulary without word ends
    assert known.encode(pa.array(plain))[0].tolist() == flat[: sizes[: len(plain)].sum()].tolist()
