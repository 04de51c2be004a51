"""Registered queries of the operators: against their SQL, or against brute force, over whole small tables."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from checks.compare import database, rows_of
from evispan.llm.queries import LLM_ORACLES, LLM_QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return database(SF)


@pytest.fixture(scope="module")
def texts(connection):
    return dict(connection.execute("SELECT doc_id, text FROM documents").fetchall())


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def test_all_are_registered():
    numbers = {name.split("_")[0] for name in LLM_QUERIES if name != "pipeline"}
    assert numbers == {f"op{n}" for n in range(1, 14)}
    assert contract.queries()["pipeline"] is corpus_pipeline.run
    assert set(LLM_ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_equals_sql(spark, connection, name):
    df = LLM_QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    cursor = connection.execute(LLM_ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cursor.fetchall())


def test_shards(spark, texts):
    rows = LLM_QUERIES["op1_sharding"](spark, SF).toPandas()
    assert len(rows) == len(texts) and set(rows.law) == {"bytes"} and rows.grown_shard.isna().all()
    for row in rows.itertuples():
        raw = texts[row.doc_id].encode()
        assert (row.size, row.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    load = rows.groupby("shard")["size"].sum()
    assert sorted(load.index) == list(range(8)) and load.max() - load.min() <= 0.1 * load.mean()
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert rows.assign(text=rows.doc_id.map(texts)).groupby("text").shard.nunique().max() == 1


def test_lattice_scores(spark, texts):
    rows = LLM_QUERIES["op3_lattice_lm"](spark, SF).toPandas()
    train = [t.encode().lower().split() for d, t in texts.items() if fold(d, 5) != 1]
    counts = {}
    for words in train:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    assert len(rows) == len(texts)
    for row in rows.itertuples():
        c = np.array([counts.get(w, 0) for w in texts[row.doc_id].encode().lower().split()] + [len(train)])
        assert row.held_out == (fold(row.doc_id, 5) == 1)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(c), (c > 0).sum(), n)
        assert abs(row.base_score - np.log10((c + 0.5) / (n + 0.5 * (v + 1))).sum()) < 1e-6
        assert np.isfinite(row.score) and row.score < 0


@pytest.mark.parametrize("name,label,folds,held,least", [("op4_toxicity", "toxic", 3, 1, 0.7), ("op7_quality", "quality", 5, 0, 0.3)])
def test_classifiers(spark, connection, texts, name, label, folds, held, least):
    rows = LLM_QUERIES[name](spark, SF).toPandas()
    marks = dict(connection.execute(f"SELECT doc_id, {label} FROM labels").fetchall())
    assert sorted(rows.doc_id) == sorted(texts) and rows.score.between(0, 1).all()
    assert (rows.held_out == [fold(d, folds) == held for d in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= least)).all()
    learned = rows[~rows.held_out & rows.doc_id.isin(list(marks))]
    assert (learned.predicted == learned.doc_id.map(marks)).mean() > 0.85


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = LLM_QUERIES["op5_pack"](spark, SF).toPandas()
    assert set(rows.doc_id) == set(texts)
    for doc, own in rows.groupby("doc_id"):
        ids = np.array(tokenizer.encode(texts[doc], add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for piece in own.sort_values("start").itertuples():
            assert piece.start == at and piece.doc_tokens == len(ids)
            assert piece.ids_crc32 == zlib.crc32(ids[at : at + piece.length].tobytes())
            at += piece.length
        assert at == len(ids)
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 4096
    assert rows.length.sum() >= 0.9 * 4096 * rows.sequence_id.nunique()


def test_archive_digest(spark, connection):
    rows = LLM_QUERIES["op8_warc_archive"](spark, SF).toPandas()
    pages = dict(connection.execute("SELECT page_id, html FROM pages").fetchall())
    assert len(rows) == len(pages)
    for row in rows.itertuples():
        raw = (pages[row.page_id] or "").encode()
        assert row.payload_bytes == len(raw)
        assert row.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
