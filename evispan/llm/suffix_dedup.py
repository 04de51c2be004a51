"""Removal of byte strings that occur more than once, by two-stage suffix sorting and adjacent common prefixes.

Every position where ``length`` bytes start (a window) goes to the key of the smallest hash of the grams inside that window, so
equal windows share a key and neighbouring windows mostly do; a run of them travels as one *piece* of text. A
key whose gram occurs once in the corpus can't hold a repeat, so only pieces of keys that occur again are moved. Tasks
sort the suffixes of the pieces of whole keys, a bounded number of bytes at a time, and compare neighbours. Equal pieces are
one piece with a count. A key with more distinct pieces than a task may hold is compared window by window in a
grouping of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evispan.llm.common import arrow_pass, mix64, only, parts
from evispan.llm.suffix_array import repeated_starts
from evispan.session import materialize_plain as materialize

LENGTH = 200
# Bytes of a gram: longer grams repeat by chance less often, shorter ones make longer runs.
GRAM = 50
# Bytes that are hashed, or suffix-sorted, at a time; the second bounds what one key may bring into a task.
CHUNK, BLOCK, KEY_BYTES = 1 << 19, 1 << 19, 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    base = int(_BASE)
    inverse = np.uint64(pow(base, -1, 1 << 64))
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (_BASE, inverse))


class Cutter:
    """Cuts texts into runs of windows that share the smallest gram hash."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        self.power, self.inverse = _powers(0)

    def gram_hashes(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.power) <= n:
            self.power, self.inverse = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(data * self.power[:n], out=sums[1:])
        return mix64((sums[self.gram :] - sums[: -self.gram]) * self.inverse[: n - self.gram + 1])

    def smallest(self, hashes: np.ndarray) -> np.ndarray:
        """Least value of every ``width`` neighbours: from prefix and suffix minima of blocks of that width."""
        n, width = len(hashes), self.width
        padded = np.full(-(-n // width) * width, ~np.uint64(0))
        padded[:n] = hashes
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(back[: n - width + 1], ahead[width - 1 : n])

    def cut(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Text number, first window, number of windows and key of every run, and whether its smallest gram stands at
        several places there; all texts hold a window at least."""
        ends = np.cumsum([len(t) for t in texts])
        begins = np.r_[0, ends[:-1]]
        hashes = self.gram_hashes(np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64))
        keys = self.smallest(hashes)
        edge = np.r_[True, keys[1:] != keys[:-1]]
        edge[begins] = True
        beyond = ends - self.length + 1  # the first position of a text where no window starts
        edge[beyond[:-1]] = True
        at = np.flatnonzero(edge)
        stop = np.r_[at[1:], len(keys)]
        text = np.searchsorted(ends, at, side="right")
        inside = at < beyond[text]
        at, stop, text = at[inside], stop[inside], text[inside]
        # A run of a repetitive text may be long: cut it to the width of any other.
        pieces = -(-(stop - at) // self.width)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at, stop, text = np.repeat(at, pieces) + nth * self.width, np.repeat(stop, pieces), np.repeat(text, pieces)
        windows, key = np.minimum(stop - at, self.width), keys[at]
        near = np.arange(self.width)
        first = at + (hashes[at[:, None] + near] == key[:, None]).argmax(axis=1)
        last = at + windows - 1 + self.width - 1
        last -= (hashes[last[:, None] - near] == key[:, None]).argmax(axis=1)
        return text, at - begins[text], windows, key, first < last


def row_key(rid: Column, text: Column) -> list[Column]:
    """128 bits that name a row's content; never null."""
    return [F.xxhash64(rid, text).alias("k1"), F.xxhash64(F.lit(1), text, rid).alias("k2")]


def runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """``k1, k2, row, key, start, windows, again`` of every run of every text; one pass without shuffle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        cutter = Cutter(length, gram)

        def flush(names: list[tuple], texts: list[bytes]) -> dict:
            text, start, windows, key, again = cutter.cut(texts)
            k1, k2, row, shift = (np.array(c, np.int64)[text] for c in zip(*names))
            place = {"key": key.view(np.int64), "start": start + shift, "windows": windows, "again": again}
            return {"k1": k1, "k2": k2, "row": row, **place}

        names, texts, held = [], [], 0
        for batch in parts(batches, 1_000):
            for k1, k2, row, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for shift in range(0, len(text or b"") - length + 1, CHUNK):  # windows of a long text, chunk by chunk
                    texts.append(text[shift : shift + CHUNK + length - 1])
                    names.append((k1, k2, row, shift))
                    held += len(texts[-1])
                    if held >= CHUNK:
                        yield flush(names, texts)
                        names, texts, held = [], [], 0
        if texts:
            yield flush(names, texts)

    numbered = rows.select("k1", "k2", F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary"))
    return arrow_pass(numbered, task, "k1 bigint, k2 bigint, row bigint, key bigint, start bigint, windows int, again boolean")


def wanted_runs(cut: DataFrame) -> DataFrame:
    """``k1, k2, runs``: for every distinct row its runs whose key stands at several places."""
    repeated = cut.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).where("n > 1 OR again").select("key")
    once = cut.groupBy("k1", "k2").agg(F.min("row").alias("row"))  # equal rows need one list
    found = (
        cut.select("key", "row", "start", "windows").join(repeated, "key")
        .groupBy("row").agg(F.collect_list(F.struct("key", "start", "windows")).alias("runs"))
    )
    return found.join(once, "row").select("k1", "k2", "runs")


def digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def _runs_of(batch: pa.RecordBatch, text_col: int, runs_col: int):
    """Row number in the batch and (key, start, windows) arrays of each row, with its text."""
    lists = batch.column(runs_col)
    flat, offsets = lists.flatten(), (np.asarray(lists.offsets) - lists.offsets[0].as_py()).tolist()
    columns = [flat.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("key", "start", "windows")]
    for i, text in enumerate(batch.column(text_col).to_pylist()):
        yield i, text, *(c[offsets[i] : offsets[i + 1]] for c in columns)


def pieces(rows: DataFrame, length: int) -> DataFrame:
    """``key, digest, piece, n``: text of every wanted run; copies inside a part of a task are counted, not repeated."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in parts(batches, 500):
            seen: dict[tuple, int] = {}
            for _, text, keys, starts, windows in _runs_of(batch, 0, 1):
                for key, start, n in zip(keys, starts, windows):
                    name = (key, text[start : start + n + length - 1])
                    seen[name] = seen.get(name, 0) + 1
            yield {
                "key": [k for k, _ in seen], "digest": [digest(p) for _, p in seen],
                "piece": [p for _, p in seen], "n": list(seen.values()),
            }

    return arrow_pass(rows.select(F.col("text").cast("binary"), "runs"), task, "key bigint, digest binary, piece binary, n bigint")


def spots(rows: DataFrame, length: int) -> DataFrame:
    """``k1, k2, start, digest``: where the wanted runs stand."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in parts(batches, 500):
            row, start_of, names = [], [], []
            for i, text, _, starts, windows in _runs_of(batch, 0, 1):
                row += [i] * len(starts)
                start_of += starts
                names += [digest(text[s : s + n + length - 1]) for s, n in zip(starts, windows)]
            at = pa.array(row, pa.int64())
            yield {"k1": batch.column(2).take(at), "k2": batch.column(3).take(at), "start": start_of, "digest": names}

    plain = rows.select(F.col("text").cast("binary"), "runs", "k1", "k2")
    return arrow_pass(plain, task, "k1 bigint, k2 bigint, start bigint, digest binary")


def marks_of(found: list[tuple[bytes, bytes, int]], length: int) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """``digest``, first windows and numbers of windows of the repeated runs in each of the distinct pieces."""
    if not found:
        return
    flags = repeated_starts([p for _, p, _ in found], [len(p) - length + 1 for _, p, _ in found], length)
    at = 0
    for name, piece, n in found:
        own = flags[at : at + len(piece) - length + 1]
        at += len(piece)
        if n > 1:  # every suffix stands for n of them, its next neighbours
            yield name, [0], [len(own)]
        elif own.any():
            edges = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
            yield name, edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist()


MARKS = "digest binary, at array<int>, windows array<int>, piece binary, n bigint"


def marks(piece_rows: DataFrame, length: int, block: int, key_bytes: int) -> DataFrame:
    """Repeated runs inside the distinct pieces, from the suffix arrays of whole keys. ``piece`` is null, but in rows of keys
    with more than ``key_bytes`` of distinct pieces: those come back as they are."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple[bytes, bytes, int]] = []  # whole keys
        own: list[tuple[bytes, bytes, int]] = []  # the key that is being read
        size = own_size = 0
        key = None
        over = False

        def rows(found) -> dict:
            names, at, windows = ([*c] for c in zip(*found)) if found else ([], [], [])
            empty = [None] * len(names)
            return {"digest": names, "at": at, "windows": windows, "piece": empty, "n": empty}

        def as_is(found) -> dict:
            names, texts, counts = ([*c] for c in zip(*found))
            return {"digest": names, "at": [None] * len(names), "windows": [None] * len(names), "piece": texts, "n": counts}

        for batch in parts(batches, 1_000):
            for k, name, piece, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if k != key:
                    if over:
                        yield as_is(own)
                    else:
                        held.extend(own)
                        size += own_size
                    if size >= block:
                        yield rows(list(marks_of(held, length)))
                        held, size = [], 0
                    own, own_size, key, over = [], 0, k, False
                if own and own[-1][0] == name:  # copies follow each other
                    own[-1] = (name, piece, own[-1][2] + n)
                    continue
                if own_size + len(piece) > key_bytes and own:
                    over = True
                    yield as_is(own[:-1])
                    own, own_size = own[-1:], len(own[-1][1])
                own.append((name, piece, n))
                own_size += len(piece)
        if over:
            yield as_is(own)
        else:
            held.extend(own)
        yield rows(list(marks_of(held, length)))

    dealt = piece_rows.repartition("key").sortWithinPartitions("key", "digest")
    return arrow_pass(dealt.select("key", "digest", "piece", "n"), task, MARKS)


def marks_by_window(crowded: DataFrame, length: int) -> DataFrame:
    """The same for pieces of crowded keys: their windows are grouped by their bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in parts(batches, 200):
            out: list[tuple] = []
            for name, piece, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                out += ((name, i, piece[i : i + length], n) for i in range(len(piece) - length + 1))
            yield dict(zip(("digest", "at", "window", "n"), zip(*out)))

    each = arrow_pass(crowded.select("digest", "piece", "n"), task, "digest binary, at int, window binary, n bigint")
    often = each.groupBy("window").agg(F.sum("n").alias("total")).where("total > 1").select("window")
    found = each.select("digest", "at", "window").join(often, "window").groupBy("digest").agg(F.collect_set("at").alias("at"))
    return found.select("digest", "at", F.transform("at", lambda _: F.lit(1)).alias("windows"))


def repeated_spans(
    rows: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, key_bytes: int = KEY_BYTES
) -> DataFrame:
    """``k1, k2, spans`` (``array<struct<start, stop>>``, unordered, overlapping) of rows ``k1, k2, text`` in which a string of
    ``length`` bytes occurs that also starts elsewhere."""
    cut = materialize(runs(rows, length, gram), "suffix-runs")
    wanted = materialize(wanted_runs(cut), "suffix-wanted")
    texts = rows.join(wanted, ["k1", "k2"])
    found = materialize(marks(pieces(texts, length), length, block, key_bytes), "suffix-marks")
    known = found.where("piece IS NULL").select("digest", "at", "windows")
    crowded = found.where("piece IS NOT NULL")
    if crowded.limit(1).count():
        known = known.union(materialize(marks_by_window(crowded, length), "suffix-window-marks"))
    placed = spots(texts, length).join(known, "digest")
    span = F.transform(
        F.arrays_zip("at", "windows"),
        lambda m: F.struct(
            (F.col("start") + m["at"]).alias("start"), (F.col("start") + m["at"] + m["windows"] + length - 1).alias("stop")
        ),
    )
    each = placed.select("k1", "k2", F.explode(span).alias("span"))
    return each.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))  # equal rows say the same


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    first = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return list(zip(starts[first].tolist(), reach[np.r_[first[1:] - 1, len(reach) - 1]].tolist()))


def suffix_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    block: int = BLOCK,
    key_bytes: int = KEY_BYTES,
) -> DataFrame:
    """One row per input row: ``id, n_bytes, n_removed, n_spans, spans, kept``.

    Texts are UTF-8 bytes. Every byte inside a string of ``length`` bytes that also starts anywhere else in the table,
    in the same text or another, is removed; ``spans`` are the maximal removed runs (``[start, stop)``), ``kept`` the other bytes
    joined (binary: a cut may fall inside a character). All copies of a string go, the first one too, as strings are judged
    on the input. Null and empty texts have no bytes, shorter texts no string; ids may be null or repeat: every row is a text
    of its own, so equal rows repeat each other. Other columns are ignored; an empty table gives an empty result. ``length`` is
    at least 8 and greater than ``gram``.
    """
    rows = only(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    rows = rows.select("id", "text", *row_key(F.col("id"), F.col("text")))
    spans = repeated_spans(rows, length, gram, block, key_bytes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in parts(batches, 500):
            out: list[tuple] = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2)):
                text, runs_ = text or b"", []
                if own.is_valid:
                    runs_ = merged(*(own.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop")))
                edges = [0, *(e for run in runs_ for e in run), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(text), len(text) - len(kept), len(runs_), [{"start": a, "stop": b} for a, b in runs_], kept))
            columns = dict(zip(("n_bytes", "n_removed", "n_spans", "spans", "kept"), zip(*out)))
            yield {"id": batch.column(0), **columns}

    both = rows.join(spans, ["k1", "k2"], "left").select("id", F.col("text").cast("binary"), "spans")
    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary"
    return arrow_pass(both, task, schema).withColumnRenamed("id", id_col)
