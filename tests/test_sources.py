import os
import uuid

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evispan import constants as c
from evispan.operators import lexical
from evispan.plans.quick_answer import Models, answer
from evispan.schema import CHUNKS
from evispan.sources import blocks, files, rows, store


def test_admission(spark):
    uploads = spark.createDataFrame(
        [("/a/x.PDF", 10), ("/a/y.Csv", c.MAX_FILE_BYTES), ("/a/z.csv", c.MAX_FILE_BYTES + 1), ("/a/n.txt", c.MAX_FILE_BYTES + 1), ("/a/", 1)],
        "path string, length bigint",
    )
    accepted, rejects = files.admission_filter(uploads)
    assert sorted(r.path for r in accepted.collect()) == ["/a/", "/a/x.PDF", "/a/y.Csv"]
    assert sorted((r.id, r.status_code) for r in rejects.collect()) == [("/a/n.txt", 415), ("/a/z.csv", 413)]


def ingest(spark, *contents):
    uploads = spark.createDataFrame([(f"/in/{i}.csv", bytearray(b)) for i, b in enumerate(contents)], "path string, content binary")
    chunks, rejects = files.csv_chunks(files.csv_records(uploads))
    return chunks.orderBy("source", "chunk_id").collect(), rejects.collect()


@pytest.mark.parametrize(
    "content, status",
    [
        (b"", 422), (b"  \n ", 422), (b"a\x00b,c\n1,2", 422), (b"\x81\xff", 400), (b" , \n1,2\n", 422), (b"a,b\n", 422), (b"a,b\n,\n\n", 422),
        (b'a,b\n"unclosed\x0d' + b"x" * 140_000 + b'",2\n', 400),
    ],
)
def test_csv_rejects(spark, content, status):
    chunks, rejects = ingest(spark, content)
    assert not chunks and [r.status_code for r in rejects] == [status]


def test_csv_chunks(spark):
    chunks, rejects = ingest(
        spark,
        "﻿a,a,a_2,\n1, 2 ,3\n\n,,,\n\"x\ny\",5,6,7,8\n".encode(),
        "é;b\n1;2\n".encode("cp1252"),
        b"only\nvalue\n",
        b"p|q\n1|2\n3|4\n",
        b"t\tu\n1\t2\n3\t4\n",
    )
    assert not rejects
    assert [(r.source, r.row_start, r.text) for r in chunks] == [
        ("0.csv", 2, "Linha 2\na: 1\na_2: 2\na_2: 3\ncoluna_4: "),
        ("0.csv", 5, "Linha 5\na: x\ny\na_2: 5\na_2: 6\ncoluna_4: 7\ncoluna_extra_1: 8"),
        ("1.csv", 2, "Linha 2\né: 1\nb: 2"),
        ("2.csv", 2, "Linha 2\nonly: value"),
        ("3.csv", 2, "Linha 2\np: 1\nq: 2"), ("3.csv", 3, "Linha 3\np: 3\nq: 4"),
        ("4.csv", 2, "Linha 2\nt: 1\nu: 2"), ("4.csv", 3, "Linha 3\nt: 3\nu: 4"),
    ]
    assert {(r.file_type, r.chunking) for r in chunks} == {("csv", "csv_rows")}


def test_read_uploads(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"h\n1\n")
    (tmp_path / "b.txt").write_bytes(b"no")
    accepted, rejects = files.admission_filter(files.read_uploads(spark, str(tmp_path)))
    chunks, _ = files.csv_chunks(files.csv_records(accepted), store.collection_id(F.col("path")))
    assert [r.text for r in chunks.collect()] == ["Linha 2\nh: 1"]
    assert [r.status_code for r in rejects.collect()] == [415]


def test_row_ordinals_with_one_hot_group(spark):
    df = spark.range(5000).select((F.col("id") % 10 == 0).alias("rare"), (F.col("id") * 7919 % 5003).alias("key"))
    numbered = rows.ordinals(df, "rare", "key", "n", start=2).collect()
    for flag in (True, False):
        part = sorted((r.key, r.n) for r in numbered if r.rare == flag)
        assert [n for _, n in part] == list(range(2, len(part) + 2))


def blocks_frame(spark, *entries):
    return spark.createDataFrame(
        [("d", "s.pdf", page, i, heading, text) for i, (page, heading, text) in enumerate(entries)],
        "collection_id string, source string, page_no int, block_no int, heading string, text string",
    )


def test_blocks_merge_and_split(spark):
    long = " ".join(f"w{i}" for i in range(1200))
    made = blocks.chunk_blocks(
        blocks_frame(spark, (2, None, "one two"), (2, None, "   "), (3, None, "three"), (3, None, long), (4, None, "tail"))
    ).orderBy("chunk_id").collect()
    assert sum(r.n_tokens for r in made) == 1204 and max(r.n_tokens for r in made) <= c.CHUNK_TOKENS
    assert (made[0].page, made[0].pages, made[0].text) == (1, [2, 3], "one two\nthree")
    assert (made[-1].pages, made[-1].text.split("\n")[-1]) == ([3, 4], "tail")
    assert " ".join(r.text for r in made).split() == ["one", "two", "three", *long.split(), "tail"]
    unknown = blocks.chunk_blocks(blocks_frame(spark, (None, None, "no page"))).first()
    assert (unknown.page, unknown.pages) == (0, [])


def test_blocks_heading_leads_and_counts(spark):
    made = blocks.chunk_blocks(blocks_frame(spark, (1, "Intro", "a b"), (1, "Intro", "c d"), (1, "Next", "e")), budget=3).collect()
    assert sorted(r.text for r in made) == ["Intro\na b", "Intro\nc d", "Next\ne"]
    assert max(r.n_tokens for r in made) == 3


def test_blocks_do_not_depend_on_page_numbers_or_size(spark):
    def texts(shift):
        return [
            (r.chunk_id, r.text) for r in blocks.chunk_blocks(
                blocks_frame(spark, (63 + shift, None, "a"), (64 + shift, None, "b"), (65 + shift, "M", "x"), (65 + shift, None, "c"))
            ).orderBy("chunk_id").collect()
        ]

    assert texts(0) == [(0, "a\nb"), (1, "M\nx"), (2, "c")] == texts(1) == texts(1000)
    wide = spark.createDataFrame([("d", "s", 1, 1_048_576, None, "late"), ("d", "s", 1, 0, None, "first " * 600)], "collection_id string, source string, page_no int, block_no int, heading string, text string")
    made = blocks.chunk_blocks(wide).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in made] == [0, 1] and made[-1].text.endswith("late")


def test_documents_pack_like_a_plain_loop(spark):
    def plain(text, budget):
        import regex

        sizes = [(line, len(regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\p{M}\p{Z}\p{C}]", line))) for line in text.split("\n") if line.strip()]
        out, used = [], 0
        for line, n in sizes:
            if not out or used + n > budget:
                out.append([])
                used = 0
            out[-1].append(line.strip())
            used += n
        return ["\n".join(part) for part in out]

    texts = ["a b c\nd e\n\nf\ng h i j", "x", "", "p, q.\nr\ns t u v\n w "]
    df = spark.createDataFrame([(str(i), "s", t) for i, t in enumerate(texts)], "collection_id string, source string, text string")
    made = blocks.chunk_documents(df, budget=5).orderBy("collection_id", "chunk_id").collect()
    assert [(r.collection_id, r.text) for r in made] == [(str(i), part) for i, t in enumerate(texts) for part in plain(t, 5)]


def test_parse_files(spark):
    uploads = spark.createDataFrame(
        [("ok", "a.pdf", bytearray(b"one|two")), ("bad", "b.pdf", bytearray(b"!")), ("none", "c.pdf", bytearray(b" "))],
        "collection_id string, source string, content binary",
    )

    def parser():
        def parse(content):
            if content == b"!":
                raise ValueError
            return [(i, None, part) for i, part in enumerate(content.decode().split("|"), start=1)]

        return parse

    found, rejects = blocks.parse_files(uploads, parser)
    assert [(r.page_no, r.text) for r in found.orderBy("block_no").collect()] == [(1, "one"), (2, "two")]
    assert sorted((r.id, r.status_code) for r in rejects.collect()) == [("bad", 400), ("none", 422)]


def test_profile_rounds_half_to_even(spark):
    df = spark.createDataFrame(
        [("a", "s", "csv", "csv_rows", None, "x" * n, t) for n, t in ((1, 2), (2, 3))] + [("b", "p", "pdf", "docling_hybrid", [2, 7], "xyz", 9)],
        "collection_id string, source string, file_type string, chunking string, pages array<int>, text string, n_tokens int",
    )
    got = {r.collection_id: r for r in store.document_profile(df).collect()}
    a, b = got["a"], got["b"]
    assert (a.rows, a.pages, a.chunks, a.average_chunk_tokens, a.average_chunk_characters) == (2, None, 2, 2, 2)
    assert (b.rows, b.pages, b.minimum_chunk_tokens, b.max_tokens_per_chunk) == (None, 7, 9, 512)


def test_store_replaces_an_ingestion_and_keeps_the_others(spark, tmp_path):
    kept = store.IndexStore(spark, str(tmp_path / "index"))

    def chunk(collection, texts):
        df = spark.createDataFrame([(collection, i, t) for i, t in enumerate(texts)], "collection_id string, chunk_id bigint, text string")
        return df.selectExpr(
            "collection_id", "chunk_id", "text", "'s' source", "'pdf' file_type", "'docling_hybrid' chunking", "0 page", "array(1) pages",
            "cast(null as bigint) row_start", "cast(null as bigint) row_end", "1 n_tokens",
        )

    kept.add(chunk("one", ["alpha beta", "gamma"]), "first")
    kept.add(chunk("two", ["delta alpha"]), "second")
    kept.add(chunk("one", ["alpha only"]), "first")
    corpus = kept.corpus()
    assert sorted((r.collection_id, r.n_chunks) for r in corpus.index.stats.collect()) == [("one", 1), ("two", 1)]
    assert corpus.vectors.count() == 2
    asked = spark.createDataFrame([("q1", "one", "Alpha?"), ("q2", "two", "nothing shared")], "query_id string, collection_id string, query string")
    got = {r.query_id: r for r in answer(corpus, asked).collect()}
    assert got["q1"].answer == "[Página 1] alpha only" and got["q1"].sources[0].page == 1
    assert len(got["q2"].sources) == 1  # the vector path always finds the nearest chunk


def test_store_counts_a_repeated_upload_once(spark, tmp_path):
    kept = store.IndexStore(spark, str(tmp_path / "index"))
    assert kept.chunks().count() == 0 and kept.collections().count() == 0
    rows = spark.createDataFrame([("one", 0, "alpha beta"), ("one", 1, "alpha")], "collection_id string, chunk_id bigint, text string").selectExpr(
        "*", "'s' source", "'pdf' file_type", "'docling_hybrid' chunking", "0 page", "array(1) pages",
        "cast(null as bigint) row_start", "cast(null as bigint) row_end", "1 n_tokens",
    )
    kept.add(rows, "a")
    kept.add(rows, "b")
    for _ in range(2):
        corpus = kept.corpus()
        assert [(r.collection_id, r.n_chunks) for r in corpus.index.stats.collect()] == [("one", 2)]
        assert (corpus.chunks.count(), corpus.vectors.count(), kept.collections().count()) == (2, 2, 1)
        kept.compact("c")


def uploaded(spark, collection, texts):
    df = spark.createDataFrame([(collection, i, t) for i, t in enumerate(texts)], "collection_id string, chunk_id bigint, text string")
    return df.selectExpr(
        "*", "'s' source", "'pdf' file_type", "'docling_hybrid' chunking", "0 page", "array(1) pages",
        "cast(null as bigint) row_start", "cast(null as bigint) row_end", "1 n_tokens",
    )


def test_upload_during_a_compaction_stays_visible(spark, tmp_path):
    root = str(tmp_path / "index")
    other = store.IndexStore(spark, root)

    class Slow(store.IndexStore):
        def _derive(self, ingest_id):
            super()._derive(ingest_id)
            other.add(uploaded(spark, "one", ["new text"]), "late", with_vectors=False)

    other.add(uploaded(spark, "one", ["old text", "old tail"]), "early", with_vectors=False)
    other.add(uploaded(spark, "two", ["two text"]), "more", with_vectors=False)
    Slow(spark, root).compact("together", with_vectors=False)
    seen = lambda: sorted((r.collection_id, r.text) for r in other.chunks().collect())
    assert seen() == [("one", "new text"), ("two", "two text")]
    assert sorted(r.ingest_id for r in other.commits().collect()) == ["late", "together"]
    assert other.vacuum() == ["early", "more"]
    assert sorted(p.name for p in (tmp_path / "index" / "chunks").iterdir() if p.name.startswith("ingest")) == ["ingest_id=late", "ingest_id=together"]
    assert seen() == [("one", "new text"), ("two", "two text")]
    other.add(uploaded(spark, "two", ["two again"]), "more", with_vectors=False)  # the name of a replaced ingestion
    other.compact("together", with_vectors=False)
    assert seen() == [("one", "new text"), ("two", "two again")]
    assert {(r.collection_id, r.term) for r in other.corpus(with_vectors=False).index.postings.collect()} == {("one", "new"), ("one", "text"), ("two", "two"), ("two", "again")}


def test_store_embeds_every_text_once(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def factory():
        import os
        import uuid

        os.makedirs(asked, exist_ok=True)

        def call(texts):
            for _ in texts:
                open(f"{asked}/{uuid.uuid4().hex}", "w").close()
            return [[1.0, 0.0] for _ in texts]

        return call

    rows = [("c", i, f"text {i}", "s", "pdf", "docling_hybrid", 0, [1], None, None, None) for i in range(40)]
    made = spark.createDataFrame(rows, CHUNKS.replace(", ingest_id STRING", ""))
    kept = store.IndexStore(spark, str(tmp_path / "index"))
    kept.add(made, "one", Models(embed=factory))
    assert kept.corpus().vectors.count() == 40 and len(list((tmp_path / "asked").iterdir())) == 40
    stored = kept.corpus().index
    assert sorted(stored.blocks.collect()) == sorted(lexical.posting_blocks(stored.postings).collect())


def test_store_keeps_small_tables_and_no_shuffle(spark, tmp_path):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {f"{at}/{name}" for top in folders for at, _, names in os.walk(top) for name in names if name.startswith("shuffle_")}
    rows = [("c", i, " ".join(uuid.uuid4().hex for _ in range(100)), "s", "pdf", "docling_hybrid", 0, [1], None, None, None) for i in range(40)]
    made = spark.createDataFrame(rows, CHUNKS.replace(", ingest_id STRING", ""))
    kept = store.IndexStore(spark, str(tmp_path / "index"))
    before = shuffled()
    kept.add(made, "one")
    kept.compact("two")
    assert sum(os.path.getsize(name) for name in shuffled() - before) < 5_000  # of sums and counts; the texts are 132,000 bytes
    parts = [p for name in ("chunks", "forward", "postings", "blocks", "vectors") for p in (tmp_path / "index" / name).rglob("part-*.parquet")]
    codecs = {pq.read_metadata(p).row_group(0).column(0).compression for p in parts if pq.read_metadata(p).num_row_groups}
    assert codecs == {"ZSTD"} and kept.chunks().count() == 40


def test_two_writers_never_share_a_commit_number(spark, tmp_path, monkeypatch):
    kept = store.IndexStore(spark, str(tmp_path / "index"))
    kept._commit("a")
    seen = iter([0, 1])  # the first look misses the commit of another writer
    monkeypatch.setattr(store.IndexStore, "last_commit", lambda self: next(seen))
    kept._commit("b")
    assert sorted((r.ingest_id, r.sequence) for r in kept.commits().collect()) == [("a", 1), ("b", 2)]


def test_small_files_share_a_frame():
    """As many frames as the blocks ask for, not one per file."""

    class Made(Exception):
        pass

    class Files:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            contents = [b"a\nb" if i % 10 else b"" for i in range(3_000)]
            frame = pd.DataFrame({"collection_id": [str(i) for i in range(3_000)], "source": "s", "content": contents})
            raise Made(list(run(iter([frame[:1_000], frame[1_000:]]))))

    with pytest.raises(Made) as made:
        blocks.parse_files(Files(), lambda: lambda content: [(None, None, line) for line in content.decode().split("\n")])
    frames = made.value.args[0]
    assert len(frames) == 2
    rows = pd.concat(frames)
    assert len(rows) == 2_700 * 2 + 300 and rows["collection_id"].nunique() == 3_000
    assert rows["status_code"].notna().sum() == 300 and rows["page_no"].isna().all()
