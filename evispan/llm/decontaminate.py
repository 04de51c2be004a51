"""Benchmark decontamination by Wu-Manber search over words.

The symbols are words and a block is two of them. For the last block of a position a shift table says how far the
search may jump without passing an occurrence; where the shift is 0, the bucket of that suffix block lists the test
strings that end so, and comparing the words decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from evispan.llm.common import arrow_pass, only, utf8
from evispan.session import materialize_plain as materialize

WINDOW = 13
# Test strings searched in one pass (their tables take some 50 MB in a worker); more are searched in blocks.
BLOCK_WINDOWS = 100_000

# Bytes that end a word are ASCII but neither digits nor letters; A-Z become a-z.
_WORD_BYTES = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def item_words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class WuManber:
    """Search for windows (tuples of words) of one length ``m``."""

    def __init__(self, windows: dict[tuple, list[int]], m: int):
        self.m, self.block = m, min(2, m)
        self.most = m - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for window, items in windows.items():
            for end in range(self.block, m + 1):
                key = self._block(window, end)
                self.shift[key] = min(self.shift.get(key, self.most), m - end)
            self.bucket.setdefault(self._block(window, m), []).append((list(window), items))

    def _block(self, seq, end: int):
        return seq[end - 1] if self.block == 1 else (seq[end - 2], seq[end - 1])

    def search(self, seq: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Start of each occurrence with the items it belongs to."""
        m, most, shift, n, two = self.m, self.most, self.shift.get, len(seq), self.block == 2
        end = m
        while end <= n:
            key = (seq[end - 2], seq[end - 1]) if two else seq[end - 1]
            jump = shift(key, most)
            if jump:
                end += jump
                continue
            start = end - m
            for window, items in self.bucket[key]:
                if seq[start:end] == window:
                    yield start, items
            end += 1


def windows_of(items: Iterable[tuple[int, bytes]], size: int = WINDOW) -> dict[int, dict[tuple, list[int]]]:
    """Test strings by length: every ``size`` consecutive words of an item, or all words of a shorter one."""
    found: dict[int, dict[tuple, list[int]]] = {}
    for item, text in items:
        seq = item_words(text)
        m = min(size, len(seq))
        for start in range(len(seq) - m + 1 if m else 0):
            owners = found.setdefault(m, {}).setdefault(tuple(seq[start : start + m]), [])
            if item not in owners:
                owners.append(item)
    return found


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """The items in blocks of at most ``limit`` words (a longer item is a block of its own), read one partition at a
    time: the driver holds one block and one partition of a test set, not all of it."""
    block, held = [], 0
    for row in only(benchmark, item_col, text_col).where(f"`{item_col}` IS NOT NULL").toLocalIterator():
        text = (row[1] or "").encode()
        count = len(item_words(text))
        if not count:
            continue
        if block and held + count > limit:
            yield block
            block, held = [], 0
        block.append((row[0], text))
        held += count
    if block:
        yield block


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    size: int = WINDOW,
    block_words: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``docs`` with ``n_words long, spans array<array<int>>`` (maximal runs of hit words, start and end) and
    ``items`` (sorted, distinct ids, of the type they have in ``benchmark``).

    Every row is searched whole and kept. Null or wordless text has 0 words and no span; items that are null, without
    words or without id match nothing; repeated items count once per id, and repeated documents each get their row. An
    empty test set leaves all spans empty. The three added columns replace columns of the same name.
    """
    spark = docs.sparkSession
    ids = f"array<{benchmark.schema[item_col].dataType.simpleString()}>"
    found = docs.drop("n_words", "spans", "items").withColumns(
        {
            "n_words": F.lit(0).cast("long"),
            "spans": F.array().cast("array<array<int>>"),
            "items": F.array().cast(ids),
        }
    )
    blocks = 0
    for block in item_blocks(benchmark, item_col, "text", block_words):
        found = search_block(spark, materialize(found, "decontaminated") if blocks else found, block, text_col, size)
        blocks += 1
    return found if blocks else search_block(spark, found, [], text_col, size)


def search_block(spark: SparkSession, docs: DataFrame, block: list[tuple], text_col: str, size: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(windows_of(block, size))  # bounded by BLOCK_WINDOWS
    columns, at = docs.columns, {name: i for i, name in enumerate(docs.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [WuManber(windows, m) for m, windows in shared.value.items()]
        for batch in batches:
            n_words, spans, items = [], [], []
            before = zip(batch.column(at["spans"]).to_pylist(), batch.column(at["items"]).to_pylist())
            for text, (old_spans, old_items) in zip(utf8(batch.column(at[text_col])), before):
                seq = item_words(text)
                hits, owners = list(map(tuple, old_spans)), set(old_items)
                for searcher in searches:
                    for start, who in searcher.search(seq):
                        hits.append((start, start + searcher.m))
                        owners.update(who)
                n_words.append(len(seq))
                spans.append(merged(hits))
                items.append(sorted(owners))
            new = {
                "n_words": pa.array(n_words, pa.int64()),
                "spans": pa.array(spans, batch.schema.field("spans").type),
                "items": pa.array(items, batch.schema.field("items").type),
            }
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(at[c])) for c in columns], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def contamination(found: DataFrame, share: int = 20) -> DataFrame:
    """Columns ``n_hit, n_items, items_sha256, contaminated`` (hit words are 1/``share`` of all words or more); they replace
    columns of the same name."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s[1] - s[0]))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.withColumn("n_hit", n_hit).withColumns(
        {
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(ids, 256),
            "contaminated": (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")),
        }
    )
