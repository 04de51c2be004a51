"""Near-duplicates by circulant MinHash, banding and exact verification (Li and Li, C-MinHash, 2022).

Two permutations make all coordinates of a signature: the first scatters the shingles over a ring, the second orders
the ring, and coordinate k uses the second one shifted by k places. Bands of coordinates name buckets. Texts with the same
words are one class from the start; only class representatives are compared. In each bucket all members are compared
with its leader; where a bucket still holds several components after that, its members outside the largest one are compared
with all others inside a task, so no list of pairs is ever made and no link between different texts is lost in a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from evispan.llm.common import arrow_pass, forget, HashCache, mix64, only, parts, utf8, words
from evispan.session import fits, materialize_plain as materialize

# 32 bands of 4: two texts at similarity 0.8 share no band with probability 5e-8.
BANDS, ROWS = 32, 4
# Candidates up to which their ids travel to the texts, and not the texts to them.
HELD_CANDIDATES = 200_000
# Bytes of sets that meet as many others inside one task at a time.
BLOCK_BYTES = 1 << 24

_FIRST, _SECOND = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def shingles(seq: list[bytes], size: int, cache: HashCache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence if it is shorter, nothing if empty."""
    if not seq:
        return np.zeros(0, np.uint64)
    one = cache.of(seq)
    n = min(size, len(one))
    key = np.full(len(one) - n + 1, n, np.uint64)
    for k in range(n):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + one[k : len(one) - n + 1 + k])
    return np.unique(key)


def mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit ring."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signature(keys: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant signature: place = first permutation; coordinate k = least value of the second one, shifted by k."""
    place = mix32((keys ^ (keys >> np.uint64(32))).astype(np.uint32) * _FIRST)
    out = np.full(coordinates, np.uint32(0xFFFFFFFF))
    for start in range(0, len(place), 4096):  # bounded memory for very long texts
        part = place[start : start + 4096]
        ring = part[None, :] - np.arange(coordinates, dtype=np.uint32)[:, None]
        np.minimum(out, mix32(ring * _SECOND).min(axis=1), out=out)
    return out


def signed(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """``row_id, id, digest, n, buckets``: a strong digest of the word sequence and one bucket name per band."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        cache, number = HashCache(), np.arange(bands, dtype=np.uint64)
        for batch in parts(batches, 1_000):
            row, ids = batch.column(0), batch.column(1)
            digests, counts, buckets = [], [], []
            for text in utf8(batch.column(2)):
                seq = words(text)
                keys = shingles(seq, size, cache)
                digests.append(sequence_digest(seq))
                counts.append(len(keys))
                if not len(keys):
                    buckets.append(None)
                    continue
                band = signature(keys, bands * rows).reshape(bands, rows)
                name = number
                for k in range(rows):
                    name = mix64(name * np.uint64(0x9E3779B97F4A7C15) + band[:, k])
                buckets.append(name.view(np.int64))
            yield {"row_id": row, "id": ids, "digest": digests, "n": counts, "buckets": buckets}

    plain = only(docs, id_col, text_col).select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long"), F.col(text_col)
    )
    return arrow_pass(plain, task, "row_id bigint, id bigint, digest binary, n bigint, buckets array<bigint>")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def sequence_digest(seq: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(seq)) + len(seq).to_bytes(8, "little")


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``node, set`` (sorted hashes as bytes) of the wanted classes (``id, digest, node``); documents are read again, so
    that only the sets of candidates are ever written."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        cache = HashCache()
        for batch in parts(batches, 1_000):
            nodes, sets = [], []
            for node, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                seq = words(text)
                if sequence_digest(seq) == digest:  # another row may have the same id
                    nodes.append(node)
                    sets.append(shingles(seq, size, cache).tobytes())
            yield {"node": nodes, "set": sets}

    texts = only(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    if fits(wanted, HELD_CANDIDATES):  # counted: some 100 bytes each; more of them meet the texts in a shuffle
        wanted = F.broadcast(wanted)
    found = materialize(arrow_pass(texts.join(wanted, "id").select("node", "digest", "text"), task, "node bigint, set binary"), "sets")
    repeated = found.groupBy("node").count().where("count > 1").limit(1).count()
    return found.dropDuplicates(["node"]) if repeated else found


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in parts(batches, 500):
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            good = [linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y)]
            yield {"a": [i for i, g in zip(a, good) if g], "b": [i for i, g in zip(b, good) if g]}

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return arrow_pass(both, task, "a bigint, b bigint")


class Forest:
    """Union-find over positions; the root of a set is its smallest position."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def block_links(
    nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int, probes: np.ndarray
) -> list[tuple[int, int]]:
    """Links that join different labels among the members of a block: the ``probes`` (flags) are compared with all of another
    label on their full sets, and links that would join what is joined already are left out."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    number = np.unique(every, return_inverse=True)[1]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    names, group = np.unique(labels, return_inverse=True)
    forest, out = Forest(len(names)), []
    mark = np.zeros(number.max() + 1, bool)
    for i in np.flatnonzero(probes).tolist():
        own = number[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        both = np.add.reduceat(mark[number], starts)
        mark[own] = False
        for j in np.flatnonzero(100 * both >= percent * (sizes + sizes[i] - both)).tolist():
            if forest.join(int(group[i]), int(group[j])):
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def mixed_groups(members: DataFrame, labels: DataFrame, sizes: DataFrame, block_bytes: int) -> DataFrame:
    """``key, i, j, node, label, probe``: members of buckets that can still join different components. Written once.

    The members outside a bucket's largest component (probes) meet all others of the bucket in a task. A bucket with more
    than ``block_bytes`` of sets is cut by a hash of the node, its probes into parts ``i``, all members into parts ``j``: a
    member goes to its own ``j`` with every ``i``, a probe besides to every ``j`` with its own ``i``. So rows stay in proportion
    to members while the probes of a bucket fit a block; alike but unlinked texts beyond that meet block by block.
    """
    labelled = materialize(
        members.where("n > 2").select("key", "node").join(sizes, "node").join(labels, "node", "left")
        .select("key", "node", "size", F.coalesce("label", "node").alias("label")),
        "labelled-buckets",
    )
    by_label = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    held = by_label.groupBy("key").agg(
        F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label", "bytes")).alias("most"), F.sum("bytes").alias("bytes")
    )
    parts = lambda items: F.greatest(F.lit(1), F.ceil(8 * items / block_bytes)).cast("int")
    mixed = held.where("labels > 1").select(
        "key", F.col("most.label").alias("main"), parts(F.col("bytes")).alias("parts"),
        parts(F.col("bytes") - F.col("most.bytes")).alias("probe_parts"),
    )
    dealt = labelled.join(mixed, "key").select(
        "key", "node", "label", (F.col("label") != F.col("main")).alias("minor"), "parts", "probe_parts",
        F.pmod(F.xxhash64("node"), F.col("probe_parts")).cast("int").alias("own_i"),
        F.pmod(F.xxhash64(F.lit(1), "node"), F.col("parts")).cast("int").alias("own_j"),
    )
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    seat = lambda i, j, probe: F.struct(i.alias("i"), j.alias("j"), probe.alias("probe"))
    as_member = F.transform(upto("probe_parts"), lambda i: seat(i, F.col("own_j"), F.col("minor") & (i == F.col("own_i"))))
    elsewhere = F.filter(upto("parts"), lambda j: F.col("minor") & (j != F.col("own_j")))
    as_probe = F.transform(elsewhere, lambda j: seat(F.col("own_i"), j, F.lit(True)))
    return materialize(dealt.select("key", "node", "label", F.inline(F.concat(as_member, as_probe))), "mixed-groups")


def mixed_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components inside the groups, on full sets; the pairs are compared inside a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(s, np.uint64) for s in pdf.set]
        found = block_links(pdf.node.to_numpy(), pdf.label.to_numpy(), own, percent, pdf.probe.to_numpy())
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return groups.join(sets, "node").groupBy("key", "i", "j").applyInPandas(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every linked node; label is the smallest node of its component. Alternates large-star and
    small-star steps (Kiveris et al. 2014) on written tables until nothing changes."""
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        state = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialize(large, "edges")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u")
        small = small.select("v", "m").union(small.select("u", "m")).toDF("u", "v").where("u <> v").distinct()
        edges = materialize(small, "edges")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, kept``.

    Words are cut at ASCII white space after A-Z became lower case; a text's set is its distinct shingles of ``size``
    words, or the whole sequence if it has fewer. Null, empty and blank texts have an empty set and link with nothing.
    Two texts link when 100 * intersection >= ``percent`` * union. ``component_id`` is the smallest id reachable over links,
    ``kept`` whether that is the row's own; rows that repeat an id are kept together. A row without id is only
    joined with texts of the same words; if none of them has an id, ``component_id`` is null and it is kept. Other columns
    are ignored; an empty table gives an empty result.
    """
    base = materialize(signed(docs, id_col, text_col, size, bands, rows), "signed")
    full = base.where("n > 0")
    classes = materialize(
        full.groupBy("digest").agg(F.min("row_id").alias("node"), F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes"
    )
    known = classes.where("id IS NOT NULL")
    members = (
        full.select(F.col("row_id").alias("node"), "buckets").join(known.select("node"), "node", "left_semi")
        .select("node", F.explode("buckets").alias("key"))
    )
    leaders = members.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    leaders = materialize(leaders, "leaders")  # written, so that the join deals a hot bucket's members anew
    members = materialize(members.join(leaders, "key"), "buckets")
    sizes = full.select(F.col("row_id").alias("node"), F.col("n").alias("size"))
    star = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    small, large = F.least("x", "y"), F.greatest("x", "y")
    pairs = star.join(sizes.toDF("a", "x"), "a").join(sizes.toDF("b", "y"), "b").where(100 * small >= percent * large)
    pairs = materialize(pairs.select("a", "b"), "pairs")  # other sizes can't be similar enough

    def sets_for(nodes: DataFrame) -> DataFrame:
        wanted = materialize(known.join(nodes.distinct(), "node").select("id", "digest", "node"), "candidates")
        return sets_of(docs, wanted, id_col, text_col, size)

    sets = sets_for(pairs.select("a").union(pairs.select("b")).toDF("node"))
    links = materialize(verified(pairs, sets, percent), "links")
    labels = components(links)
    groups = mixed_groups(members, labels, sizes, block_bytes)
    if groups.limit(1).count():
        forget(sets, pairs)
        more = materialize(mixed_links(groups, sets_for(groups.select("node")), percent), "links")
        labels = components(labels.toDF("a", "b").union(more))
    # Only classes with copies or links need a label; all other rows are alone.
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"), F.sum("copies").alias("members"))
    shared = materialize(
        named.join(least.where("members > 1"), "label").select("digest", "component_id"), "components"
    )
    return (
        base.join(shared, "digest", "left")
        .withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")))
        .withColumn("component_id", F.coalesce("component_id", "id"))
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            "component_id",
            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )
