"""Merkle manifest: the operator at every shape of tree, and its query against brute force."""

import hashlib
import zlib

import pytest

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evispan.llm.merkle import digest_of, fold, manifest, merkle_proofs, siblings_digest
from evispan.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"
NODES = StructType([StructField("doc_id", LongType()), StructField("source", StringType()), StructField("leaf", StringType())])


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """Root, and per node its siblings level by level as (before, after)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, path in enumerate(paths):
            first = at[i] - at[i] % 3
            path.append(("".join(level[first : at[i]]), "".join(level[at[i] + 1 : first + 3])))
            at[i] //= 3
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def brute(rows):
    """{row: (subroot, root, path)} of distinct (id, source, leaf) rows."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, r[2])) for s in sources}
    trees = {s: tree([r[2] for r in own[s]]) for s in sources}
    root, top = tree([trees[s][0] for s in sources])
    return {r: (trees[s][0], root, p + up) for s, up in zip(sources, top) for r, p in zip(own[s], trees[s][1])}


@pytest.mark.parametrize("levels", [0, 1, 2, 7])
def test_every_size_of_tree(spark, levels):
    """Trees of 1 to 40 leaves, so that every ragged end meets every round."""
    rows = [(i, f"s{n}", h(f"{n}/{i}")) for n in [1, 2, 3, 4, 5, 9, 10, 13, 19, 28, 40] for i in range(n)]
    rows += [(None, None, h("x")), (3, None, h("y")), (7, "é", h("z")), (7, "", h("w"))]
    nodes = spark.createDataFrame(rows, NODES).repartition(3).withColumn("path", F.lit("mine")).withColumn("tree", F.col("doc_id"))
    got = merkle_proofs(nodes, "source", ["doc_id"], "leaf", levels=levels)
    got = got.withColumn("folded", fold(F.col("leaf"), F.col("path"))).withColumn("named", siblings_digest(F.col("path"))).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        subroot, root, path = want[(r.doc_id, r.source, r.leaf)]
        assert (r.subroot, r.root, [tuple(p) for p in r.path]) == (subroot, root, path)
        assert r.folded == r.root and r.named == h("".join(b + a for b, a in path)) and r.tree == r.doc_id


def test_repeated_rows_nulls_and_empty(make):
    rows = [(1, "a"), (1, "a"), (1, "a"), (1, "a"), (None, None), (None, None), (2, ""), (3, "long " * 100_000)]
    docs = make(rows).withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text")).withColumn("part", F.lit("x"))
    got = manifest(docs, levels=1).withColumn("folded", fold(F.col("leaf"), F.col("path"))).collect()
    assert len(got) == 8 and len({r.root for r in got}) == 1 and all(r.folded == r.root for r in got)
    leaves = sorted(h(field(i), field("s"), "-", field(None if t is None else len(t)), field(t)) for i, t in rows)
    assert sorted(r.leaf for r in got) == leaves
    assert manifest(docs.limit(0)).collect() == []


def test_digest_of(spark):
    row = spark.sql("SELECT 12L AS a, CAST(NULL AS STRING) AS b, 'é:' AS c, '' AS d").select(digest_of(*map(F.col, "abcd")).alias("x")).first()
    assert row.x == h("2:12", "-", "3:é:", "0:")


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    leaf = lambda d, text: h(*map(field, (d.doc_id, d.source, d.lang, d.n_chars, text)))
    want = brute([(d.doc_id, d.source, leaf(d, d.text)) for d in docs])
    got = {r.doc_id: r for r in LLM_QUERIES["op12_merkle_manifest"](spark, SF).collect()}
    assert len(got) == len(docs) and not all(r.verified for r in got.values())
    for d in docs:
        r, own = got[d.doc_id], leaf(d, d.text)
        subroot, root, path = want[(d.doc_id, d.source, own)]
        even = zlib.crc32(str(d.doc_id).encode()) % 2 == 0
        now = leaf(d, d.text.replace("\n", "") if even and d.text is not None else d.text)
        for before, after in path:
            now = h(before, now, after)
        assert (r.leaf, r.subroot, r.root, r.folded_root, r.verified) == (own, subroot, root, now, now == root)
        assert r.proof_sha256 == h("".join(b + a for b, a in path))
