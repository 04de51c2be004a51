"""Text blocks packed into token-bounded chunks, with page provenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from evispan.constants import BLOCK_CHUNKING, CHUNK_TOKENS, PDF_NO_CONTENT, PDF_TYPE, PDF_UNREADABLE
from evispan.functions.text import TOKEN, bind, strip, token_count
from evispan.functions.tokenizers import counted, cut_at_ends, token_ends
from evispan.plugins import Factory
from evispan.schema import CHUNK_COLUMNS
from evispan.session import materialize, salted_join, spread
from evispan.sources.packing import GROUP_BITS, pack_large

# A token and the separators after it, so that joining pieces gives back the text.
PIECE = rf"(?:{TOKEN})[\p{{M}}\p{{Z}}\p{{C}}]*"


def cut_block(text: Column, budget: Column) -> Column:
    """``array<struct<text, n>>`` of one block: the block itself, or slices of ``budget`` tokens."""

    def slices(pieces: Column) -> Column:
        count = F.ceil(F.size(pieces) / budget).cast("int")

        def one(i: Column) -> Column:
            part = F.slice(pieces, i * budget + 1, budget)
            return F.struct(strip(F.array_join(part, "")).alias("text"), F.size(part).alias("n"))

        return F.transform(F.sequence(F.lit(0), count - 1), one)

    def cut(size: Column) -> Column:
        whole = F.array(F.struct(strip(text).alias("text"), size.alias("n")))
        pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
        return F.when(size <= budget, whole).otherwise(bind(pieces, slices))

    return bind(token_count(text), cut)


def chunk_starts(sizes: Column, budget: Column) -> Column:
    """Positions (from 0) at which a new chunk starts when pieces are packed in order while they fit."""
    first = F.struct(
        F.array().cast("array<int>").alias("starts"), F.lit(0).alias("used"), F.lit(0).alias("at"), budget.alias("budget")
    )

    def step(state: Column, size: Column) -> Column:
        opens = (state["at"] == 0) | (state["used"] + size > state["budget"])
        return F.struct(
            F.when(opens, F.concat(state["starts"], F.array(state["at"]))).otherwise(state["starts"]).alias("starts"),
            F.when(opens, size).otherwise(state["used"] + size).alias("used"),
            (state["at"] + 1).alias("at"),
            state["budget"].alias("budget"),
        )

    return F.aggregate(sizes, first, step, lambda state: state["starts"])


def page_provenance(pages: Column) -> tuple[Column, Column]:
    """``(page, pages)``: sorted distinct page numbers, and the first of them counted from 0."""
    distinct = F.array_sort(F.array_distinct(F.array_compact(pages)))
    return F.greatest(F.coalesce(F.get(distinct, F.lit(0)), F.lit(1)) - 1, F.lit(0)), distinct


def _packed(df: DataFrame, budget: Column) -> DataFrame:
    """From rows with ``pieces array<struct<text, n, ...>>`` to one row per chunk."""
    started = df.withColumn("starts", chunk_starts(F.col("pieces.n"), budget))
    spans = F.transform(
        "starts",
        lambda at, i: F.struct(
            i.alias("chunk_no"), at.alias("at"), (F.coalesce(F.get("starts", i + 1), F.size("pieces")) - at).alias("length")
        ),
    )
    return (
        started.withColumn("span", F.explode_outer(spans))
        .where(F.col("span").isNotNull())
        .withColumn("part", F.slice("pieces", F.col("span.at") + 1, F.col("span.length")))
        .withColumn("text", F.array_join(F.col("part.text"), "\n"))
        .withColumn("n_tokens", F.aggregate(F.col("part.n"), F.lit(0), lambda total, n: total + n))
    )


def chunk_documents(documents: DataFrame, budget: int = CHUNK_TOKENS) -> DataFrame:
    """Chunks of documents ``(collection_id, source, text)``, one document per row, whose lines are the
    blocks. The row is cut and packed where it is: no shuffle. Documents without content give no chunk."""
    lines = F.filter(F.split("text", "\n"), lambda line: strip(line) != "")
    pieces = F.flatten(F.transform(lines, lambda line: cut_block(line, F.lit(budget))))
    packed = _packed(spread(documents).select("collection_id", "source", pieces.alias("pieces")), F.lit(budget))
    return packed.select(
        "collection_id",
        F.col("span.chunk_no").cast("bigint").alias("chunk_id"),
        "text",
        "source",
        F.lit(PDF_TYPE).alias("file_type"),
        F.lit(BLOCK_CHUNKING).alias("chunking"),
        F.lit(0).alias("page"),
        F.array(F.lit(1)).alias("pages"),
        F.lit(None).cast("bigint").alias("row_start"),
        F.lit(None).cast("bigint").alias("row_end"),
        "n_tokens",
    ).select(*CHUNK_COLUMNS)


PACKED_BLOCKS = (
    "collection_id string, chunk_id bigint, text string, source string, pages array<int>, n_tokens int"
)


def _pack_runs(budget: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Packs slices that come in reading order. Holds one chunk, whatever the length of a document or of a run of
    equal headings; a run goes on over frames."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        collection = source = head = None
        number, used, started = 0, 0, False
        texts: list[str] = []
        pages: set[int] = set()

        def chunk() -> tuple:
            body = "\n".join(texts)
            text = f"{head}\n{body}" if head else body
            return collection, number, text, source, sorted(pages), used

        for frame in frames:
            made = []
            for c, s, h, page, text, n, head_n in zip(
                *(frame[name] for name in ("collection_id", "source", "head", "page_no", "text", "n", "head_n"))
            ):
                new_collection = not started or c != collection
                new_run = new_collection or s != source or h != head
                if new_run or used + n > budget:
                    if texts:
                        made.append(chunk())
                        number += 1
                    texts, pages, used = [], set(), int(head_n)
                    if new_collection:
                        number = 0
                    collection, source, head, started = c, s, h, True
                texts.append(text)
                used += int(n)
                if not pd.isna(page):
                    pages.add(int(page))
            if made:
                yield pd.DataFrame(made, columns=PACKED_COLUMNS)
        if texts:
            yield pd.DataFrame([chunk()], columns=PACKED_COLUMNS)

    return run


def _pack_each(located: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """One task per collection."""
    lined = located.repartition("collection_id").sortWithinPartitions(*order)
    return lined.select("collection_id", "source", "head", "page_no", "text", "n", "head_n").mapInPandas(_pack_runs(budget), PACKED_BLOCKS)


PACKED_COLUMNS = [part.split()[0] for part in PACKED_BLOCKS.split(", ")]


# Size of a collection (its blocks, and one more per 2,000 characters) from which many tasks pack it.
LARGE = 1_000_000


def _large_collections(blocks: DataFrame, least: int) -> DataFrame:
    size = F.sum(1 + F.floor(F.length("text") / 2_000))
    large = blocks.where("collection_id IS NOT NULL").groupBy("collection_id").agg(size.alias("size")).where(F.col("size") > least)
    return materialize(large.select("collection_id"), "large-collections")


def chunk_blocks(
    blocks: DataFrame, budget: int = CHUNK_TOKENS, tokenizer: Factory | None = None, large: int = LARGE, group_bits: int = GROUP_BITS
) -> DataFrame:
    """Chunks of a block table ``(collection_id, source, page_no, block_no, heading, text)``.

    Blocks are packed in reading order; neighbours of equal heading merge while they fit, over any number of pages. The
    heading comes first in the text of each of its chunks and counts towards the budget. Chunk ids count from 0
    in each collection. Blocks are cut natively, or with a ``tokenizer`` plug-in; a document is then one sorted run of rows
    through a task that holds one chunk at a time. Collections larger than ``large`` are packed by many tasks, with the same result.
    """
    head = strip(F.coalesce(F.col("heading"), F.lit("")))
    filled = blocks.where(strip(F.col("text")) != "").withColumn("head", head).withColumn("head_n", counted(F.col("head"), tokenizer))
    room = F.greatest(F.lit(budget) - F.col("head_n"), F.lit(1))
    if tokenizer is None:
        pieces = cut_block(F.col("text"), room)
    else:
        filled = filled.withColumn("ends", token_ends(F.col("text"), tokenizer))
        pieces = cut_at_ends(F.col("text"), F.col("ends"), room)
    cut = filled.select("collection_id", "source", "head", "head_n", "page_no", "block_no", F.posexplode(pieces).alias("slice", "piece"))
    located = cut.select("collection_id", "source", "head", "head_n", "page_no", "block_no", "slice", "piece.text", "piece.n")
    order = [F.col("collection_id"), F.col("source"), F.coalesce("page_no", F.lit(1)), F.col("block_no"), F.col("slice"), F.col("text")]
    hot = _large_collections(blocks, large)
    if hot.isEmpty():
        packed = _pack_each(located, order, budget)
    else:
        of = lambda how: salted_join(located, hot, ["collection_id"], F.col("block_no"), how)
        packed = _pack_each(of("left_anti"), order, budget).unionByName(pack_large(of("left_semi"), order, budget, group_bits))
    page_, pages = page_provenance(F.col("pages"))
    return packed.select(
        "collection_id",
        "chunk_id",
        "text",
        "source",
        F.lit(PDF_TYPE).alias("file_type"),
        F.lit(BLOCK_CHUNKING).alias("chunking"),
        page_.alias("page"),
        pages.alias("pages"),
        F.lit(None).cast("bigint").alias("row_start"),
        F.lit(None).cast("bigint").alias("row_end"),
        "n_tokens",
    ).select(*CHUNK_COLUMNS)


BLOCKS = (
    "collection_id string, source string, page_no int, block_no int, heading string, text string, "
    "status_code int, detail string"
)


# Blocks, or characters of them, from which a parsing task gives back what it holds.
FRAME_BLOCKS, FRAME_CHARS = 5_000, 4_000_000


def parse_files(files: DataFrame, parser: Factory) -> tuple[DataFrame, DataFrame]:
    """``(blocks, rejects)`` of PDF files ``(collection_id, source, content)`` through a pluggable parser
    ``bytes -> list[(page_no, heading, text)]``. A parser that fails, or finds nothing, rejects its file. Small files share
    a frame."""
    columns = [part.split()[0] for part in BLOCKS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = parser()
        held, chars = [], 0
        for frame in frames:
            for collection, source, content in zip(frame["collection_id"], frame["source"], frame["content"]):
                try:
                    found = [entry for entry in parse(bytes(content)) if entry[2].strip()]
                    reason = None if found else PDF_NO_CONTENT
                except Exception:
                    reason = PDF_UNREADABLE
                if reason:
                    held.append((collection, source, None, None, None, None, *reason))
                else:
                    held += [(collection, source, page, at, heading, text, None, None) for at, (page, heading, text) in enumerate(found)]
                    chars += sum(len(text) for _, _, text in found)
                if len(held) >= FRAME_BLOCKS or chars >= FRAME_CHARS:
                    yield pd.DataFrame(held, columns=columns, dtype=object)
                    held, chars = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns, dtype=object)

    # Written, so that the plug-in is called once for blocks and rejects.
    parsed = materialize(files.select("collection_id", "source", "content").mapInPandas(run, BLOCKS), "parsed")
    good = F.col("status_code").isNull()
    return parsed.where(good).drop("status_code", "detail"), parsed.where(~good).select(
        F.col("collection_id").alias("id"), "status_code", "detail"
    )
