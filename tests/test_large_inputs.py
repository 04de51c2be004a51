"""Long collections, long term lists, other tokenizers, streams of files: equal to the plain way."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evispan.functions import guardrails as rules
from evispan.functions.terms import TermSearch
from evispan.functions.text import compat_casefold
from evispan.functions.tokenizers import _held, counted, fixed_pieces, longest_pieces
from evispan.sources import blocks
from evispan.sources.packing import pack_large
from evispan.sources.store import IndexStore
from evispan.sources.uploads import FILES, ingest_uploads
from evispan.streaming.jobs import stream_uploads

BLOCK = "collection_id string, source string, page_no int, block_no bigint, heading string, text string"


def block_rows(seed, collections=3, most=400):
    rng, rows = random.Random(seed), []
    for c in range(collections):
        heading = None
        for i in range(most if c == 1 else rng.randrange(1, 40)):
            if rng.random() < (0.02 if c == 1 else 0.3):
                heading = rng.choice([None, "one two", "three", "a heading of far more words than the budget"])
            text = " ".join(rng.choice(["alpha", "beta.", "gamma"]) for _ in range(rng.choice([0, 1, 2, 3, 9, 30])))
            rows.append((f"c{c}", f"f{i * 2 // most}", rng.choice([None, 1 + i // 7]) if c else 1 + i // 7, i, heading, text))
    return rows


def chunk_rows(df):
    return sorted((r.collection_id, r.chunk_id, r.text, r.source, r.page, tuple(r.pages), r.n_tokens) for r in df.collect())


@pytest.mark.parametrize("seed,bits", [(1, 2), (2, 4), (3, 3)])
def test_many_tasks_pack_as_one_does(spark, seed, bits):
    table = spark.createDataFrame(block_rows(seed), BLOCK).repartition(5)
    one = chunk_rows(blocks.chunk_blocks(table, budget=12))
    assert len({r[0] for r in one}) == 3
    assert chunk_rows(blocks.chunk_blocks(table, budget=12, large=0, group_bits=bits)) == one
    assert chunk_rows(blocks.chunk_blocks(table, budget=12, large=100, group_bits=bits)) == one


def test_a_hot_collection_without_headings_lies_in_many_groups(spark):
    rows = [("hot", "f", 1 + i // 50, i, None, "word " * (1 + i % 5)) for i in range(3000)]
    table = spark.createDataFrame(rows, BLOCK)
    one = chunk_rows(blocks.chunk_blocks(table, budget=64))
    assert chunk_rows(blocks.chunk_blocks(table, budget=64, large=10, group_bits=5)) == one
    pieces = table.select("collection_id", "source", F.lit("").alias("head"), "page_no", "text", F.lit(1).alias("n"), F.lit(0).alias("head_n"), "block_no")
    parts = pack_large(pieces, [F.col("collection_id"), F.col("block_no")], 64, 5)
    assert parts.count() == -(-3000 // 64)


def test_automaton_finds_what_patterns_find(spark):
    rng = random.Random(5)
    alphabet = ["a", "b", "é", "Ä", " ", "-", "_", "ß", "9", "+"]
    made = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 5))) for _ in range(300)}
    terms = sorted(t for t in made if t.strip())
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, text string")
    folded = rows.select("id", compat_casefold(F.col("text")).alias("text"))
    assert len(terms) > rules.PATTERN_TERMS
    got = {r.id: r.found for r in folded.select("id", rules.blocked_terms(F.col("text"), terms).alias("found")).collect()}
    one = {r.id: [] for r in folded.collect()}
    for at in range(0, len(terms), rules.PATTERN_TERMS):
        part = rules.blocked_terms(F.col("text"), terms[at : at + rules.PATTERN_TERMS])
        for r in folded.select("id", part.alias("found")).collect():
            one[r.id] += r.found
    assert got == one and any(got.values()) and got[300] == []


def test_ten_thousand_terms_leave_the_plan_short(spark):
    def plan(n):
        terms = [f"term{i}" for i in range(n)]
        df = spark.createDataFrame([("a TERM77 b",), ("term7x",), ("",)], "text string").withColumn("v", rules.violations(F.col("text"), "f", 100, terms))
        return df, len(df._jdf.queryExecution().toString())

    (df, long), (_, short) = plan(10_000), plan(100)
    assert [len(r.v) for r in df.collect()] == [1, 0, 1] and abs(long - short) < 200
    assert TermSearch(["b", "a b", "a"]).of("a b") == [0, 1, 2]
    with pytest.raises(ValueError):
        rules.blocked_terms(F.col("text"), [f"t{i}" for i in range(99)] + [""])


def test_tokenizers(spark):
    vocabulary = ["un", "##believ", "##able", "##ab", "believ", "a", "##b", "."]
    call = longest_pieces(vocabulary)()
    assert call(["unbelievable a. xyz", "", "ab unb"]) == [[2, 8, 12, 14, 15, 19], [], [1, 2, 5, 6]]
    assert fixed_pieces(2)()(["abcde f"]) == [[2, 4, 5, 7]]


def test_tokens_are_held_for_some_texts_at_a_time(spark):
    texts = ["a" * 600_000] * 3 + ["b", "", "c"]
    assert [len(some) for some in _held(texts)] == [1, 1, 4] and [t for some in _held(texts) for t in some] == texts
    df = spark.createDataFrame([("abcdefgh ij",), ("",), (None,)], "text string")
    made = df.select(counted(F.col("text"), fixed_pieces(4)))
    assert [row[0] for row in made.collect()] == [3, 0, 0]
    assert "size(" not in made._jdf.queryExecution().analyzed().toString()  # numbers leave the task, no arrays of ends


def test_counts_and_chunks_share_a_tokenizer(spark):
    rows = [("c", "f", 1, i, "head" if i % 7 else None, " ".join(f"wórd{j * i}" for j in range(1 + i * 5 % 60))) for i in range(40)]
    made = blocks.chunk_blocks(spark.createDataFrame(rows, BLOCK), budget=20, tokenizer=fixed_pieces(2))
    recount = made.select("n_tokens", "text", counted(F.col("text"), fixed_pieces(2)).alias("again")).collect()
    assert all(r.n_tokens == r.again and r.n_tokens <= 20 for r in recount)
    letters = lambda texts: re.sub(r"\s", "", "".join(texts))
    body = letters(r.text.removeprefix("head\n") for r in made.orderBy("chunk_id").collect())
    assert body == letters(r[5] for r in rows)


def line_parser():
    def parse(content):
        if b"broken" in content:
            raise ValueError
        return [(1, None, line) for line in content.decode().split("\n")]

    return lambda: parse


def write_files(folder, files):
    folder.mkdir(exist_ok=True)
    for name, content in files.items():
        (folder / name).write_bytes(content)


FIRST = {"a.csv": b"x;y\n1;2\n3;4\n", "b.pdf": b"one two\nthree", "copy of b.PDF": b"one two\nthree", "c.txt": b"t", "empty.csv": b"", "d.pdf": b"broken", "e.pdf": b" "}
STATUS = {"c.txt": 415, "empty.csv": 422, "d.pdf": 400, "e.pdf": 422}


def statuses(rejects):
    return {r.id.rsplit("/", 1)[-1]: r.status_code for r in rejects.collect()}


def test_uploads_as_one_plan(spark):
    rows = [(f"/in/{name}", len(content), bytearray(content)) for name, content in FIRST.items()] + [("/in/big.pdf", 21 << 20, None)]
    made = ingest_uploads(spark.createDataFrame(rows, "path string, length bigint, content binary"), line_parser())
    assert statuses(made.rejects) == {**STATUS, "big.pdf": 413}
    assert sorted((r.source, r.chunks, r.rows) for r in made.profiles.collect()) == [("a.csv", 2, 2), ("b.pdf", 1, None)]
    assert {r.text for r in made.chunks.collect()} == {"Linha 2\nx: 1\ny: 2", "Linha 3\nx: 3\ny: 4", "one two\nthree"}
    nothing = ingest_uploads(spark.createDataFrame([], FILES), line_parser())
    assert [df.count() for df in (nothing.chunks, nothing.profiles, nothing.rejects)] == [0, 0, 0]


def test_stream_of_files(spark, tmp_path):
    write_files(tmp_path / "in", FIRST)
    store = IndexStore(spark, str(tmp_path / "store"))

    def go():
        stream_uploads(spark, str(tmp_path / "in"), store, str(tmp_path / "out"), line_parser(), str(tmp_path / "checkpoint"), with_vectors=False).awaitTermination()
        chunks = sorted((r.source, r.chunk_id, r.text) for r in store.chunks().collect())
        return chunks, statuses(spark.read.parquet(str(tmp_path / "out" / "rejects"))), spark.read.parquet(str(tmp_path / "out" / "profiles")).count()

    chunks, rejects, profiles = go()
    seen = {name: status for name, status in STATUS.items() if FIRST[name]}  # a file source has no row for a file without bytes
    assert len(chunks) == 3 and rejects == seen and profiles == 2
    # The batch runs again as if its commit had been lost.
    (tmp_path / "checkpoint" / "commits" / "0").rename(tmp_path / "lost")
    (tmp_path / "checkpoint" / "commits" / ".0.crc").rename(tmp_path / "lost.crc")
    assert go() == (chunks, rejects, profiles)
    write_files(tmp_path / "in", {"later.csv": b"k\nv\n"})
    assert go()[0] == sorted([*chunks, ("later.csv", 2, "Linha 2\nk: v")])
