"""Alignment of two tokenizers over a corpus, in Arrow kernels.

In a task, token lists are flattened with their parent indices, byte ends are segmented cumulative sums of token lengths, and
an Acero join of both sides on (document, end) keys gives all boundaries: rows that both sides share cut the text into
groups, and every stretch between two boundaries is one pair of overlapping tokens. ``Table.group_by`` counts pairs by document
and by task; Spark merges the partial counts.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from evispan.llm.common import arrow_pass, only
from evispan.session import fits, materialize_plain as materialize

# Bytes of text that are aligned at a time (a longer text alone), distinct pairs that a task counts before it hands them on.
PART_BYTES, TASK_PAIRS = 1 << 20, 1_000_000
# Pairs whose counts travel to the links (some 50 bytes each); beyond that only pairs in many documents do.
HELD_PAIRS = 1_000_000
END_BITS = 40


class ByteLevel:
    """A byte-level BPE file of ``tokenizers`` whose ids are its merge ranks: a space is put before the text, strings of special
    tokens are plain text. The file's vocabulary runs in ``tiktoken``, which is four times as fast; very long texts, whose
    recursion is deep there, stay with ``tokenizers``. Both split at the same places for every code point (tested)."""

    LONG = 200_000

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        special = self.tokenizer.get_added_tokens_decoder()
        ranks = {token: i for i, token in enumerate(self.token_bytes()) if i not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def token_bytes(self) -> list[bytes]:
        """Printable bytes stand for themselves in the vocabulary, the others for code points from 256 on, in order."""
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = (b for b in range(256) if b not in printable)
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        out = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.fast.encode_ordinary(" " + t) if len(t) < self.LONG else self.encode_slowly(t) for t in texts]

    def encode_slowly(self, text: str) -> list[int]:
        return self.tokenizer.encode(" " + text, add_special_tokens=False).ids


class Pieces:
    """A ``sentencepiece`` model, which puts the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def token_bytes(self) -> list[bytes]:
        out = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            out.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Side:
    """Token lists of one tokenizer with the bytes of its vocabulary."""

    def __init__(self, encoder):
        self.encoder = encoder
        self.bytes = pa.array(encoder.token_bytes(), pa.binary())
        self.lengths = pc.binary_length(self.bytes).cast(pa.int64())

    def lists(self, texts: list[str]) -> pa.ListArray:
        return pa.array(self.encoder.encode(texts), pa.list_(pa.int32()))

    def joined(self, lists: pa.ListArray) -> pa.Array:
        """Bytes of each list of tokens."""
        return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.bytes.take(lists.flatten())), pa.scalar(b"", pa.binary()))

    def ends(self, lists: pa.ListArray, name: str) -> pa.Table:
        """``key`` (document and byte end) and id of every token."""
        doc, ids = pc.list_parent_indices(lists).cast(pa.int64()), pc.list_flatten(lists)
        total = pc.cumulative_sum(self.lengths.take(ids))
        firsts = lists.offsets.slice(0, len(lists))
        before = pc.subtract(total.take(firsts), self.lengths.take(ids.take(firsts)))  # bytes of the documents before
        key = pc.add(pc.shift_left(doc, END_BITS), pc.subtract(total, before.take(doc)))
        return pa.table({"key": key, name: ids})


def segments(counts: pa.Array) -> pa.Array:
    """List offsets from cumulative counts at the end of each list."""
    return pa.concat_arrays([pa.array([0], pa.int32()), counts.cast(pa.int32())])


def aligned(a: Side, b: Side, lists_a: pa.ListArray, lists_b: pa.ListArray) -> dict[str, pa.Array]:
    """Per document (each with tokens on both sides, of the same bytes): ``n_groups, n_links, groups, links``; the pairs of
    ``links`` are distinct, with the times they occur."""
    both = a.ends(lists_a, "a").join(b.ends(lists_b, "b"), "key", join_type="full outer", use_threads=False)
    both = both.sort_by("key").combine_chunks()
    key, ids_a, ids_b = (both[c].combine_chunks() for c in ("key", "a", "b"))
    doc = pc.shift_right(key, END_BITS)
    here_a, here_b = ids_a.is_valid(), ids_b.is_valid()
    cut = pc.and_(here_a, here_b)

    def per_group(ids: pa.Array, here: pa.Array) -> pa.Array:
        """Ids of each group, comma-joined."""
        text = pc.drop_null(ids).cast(pa.string())
        seen = pc.cumulative_sum(here.cast(pa.int32())).filter(cut)
        return pc.binary_join(pa.ListArray.from_arrays(segments(seen), text), ",")

    group = pc.binary_join_element_wise(per_group(ids_a, here_a), per_group(ids_b, here_b), "|")
    # A document's last row is where the next one's first stands; all its rows are links.
    counts = pa.table({"doc": doc, "cut": cut.cast(pa.int32())}).group_by("doc", use_threads=False)
    counts = counts.aggregate([("cut", "sum"), ("cut", "count")]).sort_by("doc").combine_chunks()
    n_groups, n_links = counts["cut_sum"].combine_chunks(), counts["cut_count"].combine_chunks()
    groups = pc.binary_join(pa.ListArray.from_arrays(segments(pc.cumulative_sum(n_groups)), group), ";")
    pair = pc.add(pc.multiply(pc.fill_null_backward(ids_a).cast(pa.int64()), len(b.bytes)), pc.fill_null_backward(ids_b).cast(pa.int64()))
    held = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    held = held.sort_by("doc").combine_chunks()
    per_doc = held.group_by("doc", use_threads=False).aggregate([([], "count_all")]).sort_by("doc").combine_chunks()
    links = pa.StructArray.from_arrays(
        [held["pair"].combine_chunks(), held["count_all"].combine_chunks().cast(pa.int32())], ["pair", "n"]
    )
    lists = pa.ListArray.from_arrays(segments(pc.cumulative_sum(per_doc["count_all"].combine_chunks())), links)
    return {"n_groups": n_groups, "n_links": n_links.cast(pa.int64()), "groups": groups, "links": lists}


ALIGNED = (
    "row bigint, id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, groups_sha256 string, "
    "links array<struct<pair: bigint, n: int>>"
)


def align(rows: DataFrame, side_a: Callable[[], object], side_b: Callable[[], object], spelled: bool) -> DataFrame:
    """Alignment of every row ``row, id, text``, with its distinct pairs; one pass without shuffle. ``groups`` is longer than
    the text and null unless ``spelled``."""
    limit = PART_BYTES

    def part(a: Side, b: Side, rows: list[int], ids: list, texts: list[str | None]) -> dict:
        some = [i for i, t in enumerate(texts) if t]
        own = [texts[i] for i in some]
        lists_a, lists_b = a.lists(own), b.lists(own)
        want = pa.array([b" " + t.encode() for t in own], pa.binary())
        same = pc.and_(pc.equal(a.joined(lists_a), want), pc.equal(b.joined(lists_b), want))
        lists_a, lists_b = lists_a.filter(same), lists_b.filter(same)
        place: list[int | None] = [None] * len(texts)
        for n, i in enumerate(pa.array(some, pa.int64()).filter(same).to_pylist()):
            place[i] = n
        at = pa.array(place, pa.int64())
        out = {"row": pa.array(rows, pa.int64()), "id": pa.array(ids, pa.int64())}
        if not len(lists_a):
            zero = pa.array([0] * len(texts), pa.int64())
            none = [None] * len(texts)
            return out | {c: zero for c in ("n_a", "n_b", "n_groups", "n_links")} | {c: none for c in ("groups", "groups_sha256", "links")}
        found = aligned(a, b, lists_a, lists_b)
        found |= {"n_a": pc.list_value_length(lists_a).cast(pa.int64()), "n_b": pc.list_value_length(lists_b).cast(pa.int64())}
        found["groups_sha256"] = pa.array([hashlib.sha256(g.as_buffer()).hexdigest() for g in found["groups"]], pa.string())
        if not spelled:
            found["groups"] = pa.nulls(len(lists_a), pa.string())
        found = {c: v.take(at) for c, v in found.items()}
        return out | found | {c: found[c].fill_null(0) for c in ("n_a", "n_b", "n_groups", "n_links")}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        a, b = Side(side_a()), Side(side_b())
        for batch in batches:
            held, start, texts = 0, 0, batch.column(2).to_pylist()
            row, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, text in enumerate(texts):
                held += len(text or "")
                if held >= limit or i + 1 == len(texts):
                    yield part(a, b, row[start : i + 1], ids[start : i + 1], texts[start : i + 1])
                    held, start = 0, i + 1

    return arrow_pass(rows, task, ALIGNED)


def pair_counts(table: DataFrame, size_b: int) -> DataFrame:
    """``pair, documents, best``: how many documents hold a pair, and whether no pair of its A id is in more."""
    limit = TASK_PAIRS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def merge(tables: list[pa.Table]) -> pa.Table:
            joined = pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("documents", "sum")])
            return joined.rename_columns(["pair", "documents"])

        held: list[pa.Table] = []
        for batch in batches:
            pair = pc.list_flatten(batch.column(0)).field("pair")  # distinct within a document
            counted = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
            held.append(counted.rename_columns(["pair", "documents"]))
            if sum(t.num_rows for t in held) > limit:
                held = [merge(held)]
                if held[0].num_rows > limit // 2:
                    yield {c: held[0][c].combine_chunks() for c in ("pair", "documents")}
                    held = []
        if held:
            last = merge(held)
            yield {c: last[c].combine_chunks() for c in ("pair", "documents")}

    partial = arrow_pass(table.where("links IS NOT NULL").select("links"), task, "pair bigint, documents bigint")
    counts = partial.groupBy("pair").agg(F.sum("documents").alias("documents"))
    counts = materialize(counts.withColumn("a", F.floor(F.col("pair") / size_b)), "alignment-counts")
    top = counts.groupBy("a").agg(F.max("documents").alias("top"))
    return materialize(counts.join(top, "a").select("pair", "documents", (F.col("documents") == F.col("top")).alias("best")), "alignment-pairs")


def counted_links(links: DataFrame, counts: DataFrame, documents: int, held: int) -> DataFrame:
    """Links with the counts of their pairs. All counts travel to the links if there are few of them; else those of pairs
    in more than a thousandth of the documents, so that no frequent pair is a hot key in the join of the others."""
    if fits(counts, held):
        return links.join(F.broadcast(counts), "pair")
    often = F.col("documents") > documents / 1000
    if not fits(counts.where(often), held):
        return links.join(counts, "pair")
    met = links.join(F.broadcast(counts.where(often)), "pair", "left")
    rare = met.where("documents IS NULL").drop("documents", "best").join(counts.where(~often), "pair")
    return met.where("documents IS NOT NULL").unionByName(rare)


def cross_tokenizer_alignment(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    spelled: bool = False,
    held: int = HELD_PAIRS,
) -> DataFrame:
    """One row per input row: ``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, and ``groups`` if ``spelled``.

    A space and the text are encoded by a byte-level vocabulary (A) and a sentencepiece model (B). Offsets where tokens of
    both end cut them into groups (``a1,a2|b1;a3|b2,b3``; the digest is that of this text). A link is a pair of tokens that share a byte; the count of
    its ids is the number of rows that hold them linked. ``count_sum`` adds the counts over all links, ``n_best`` counts the
    links whose count is the highest of their A id (ties too). Null and empty texts, and texts that the tokens of one side don't
    spell byte by byte, have no tokens: zeros, and empty strings instead of groups and digest. Ids may be null or repeat; other columns are ignored; an
    empty table gives an empty result. A text is aligned as a whole: a task needs some 200 bytes per token of its longest one.
    """
    rows = only(docs, id_col, text_col).select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")
    )
    table = materialize(align(rows, lambda: ByteLevel(path_a), lambda: Pieces(path_b), spelled), "alignment")
    counts = pair_counts(table, len(Pieces(path_b).token_bytes()))
    links = table.select("row", F.explode("links").alias("link")).select("row", "link.pair", "link.n")
    sums = counted_links(links, counts, table.count(), held).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("documents")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return table.drop("links").join(sums, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"),
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("groups_sha256", *(["groups"] if spelled else []))),
    )
