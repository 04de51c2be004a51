"""Packing of token ids into sequences of one length, by the sum-of-squares rule.

Each scan task tokenises its documents, cuts their full windows and leaves one remainder per document. Only the
sizes of the remainders move: they are dealt by hash over packing groups of a bounded number of pieces, and each group is
packed online. An array holds, per fill level, how many windows stand there; a piece goes to the level for which the
sum of the squared counts of partially filled windows grows least.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from evispan.llm.common import arrow_pass, only, parts
from evispan.session import materialize_plain as materialize

SEQUENCE = 4096
END_ID = 2
GROUP_PIECES = 20_000
# Parts of words whose ids a task remembers (some 200 bytes each).
CACHE_UNITS = 500_000

PIECES = (
    "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, digest bigint, full boolean"
)
PACKED = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


# Letters and signs, after A-Z and their like became lower case, on which Arrow's classes and those of the
# tokenizer's pattern agree and which no normal form changes; digits are single. The pattern is the tokenizer's own.
LETTERS = "a-zß-öø-ÿĀ-įı-ſа-яё"
SAFE = f"^[\\x00-\\x7f{LETTERS}À-ÖØ-ÞА-ЯЁ×÷–—‘’“”„…«»¡¿§©®°€]*$"
UNITS = f"('s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+)"
# Units that the tokenizer leaves whole: the last of their ids, and no other, ends a word.
WHOLE = f"^('s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[!-/:-@\\[-`{{-~×÷–—‘’“”„…«»¡¿§©®°€]+)$"


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def strings(array: pa.Array) -> list[str]:
    """Through NumPy: Arrow's own way makes a scalar of each."""
    return array.to_numpy(zero_copy_only=False).tolist()


def gathered(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists named by ``codes``, one after the other, and their sizes; lists of ``sizes`` lie in ``flat`` in order."""
    starts, length = np.cumsum(sizes) - sizes, sizes[codes]
    upto = np.cumsum(length)
    at = np.repeat(starts[codes] - upto + length, length)
    return flat[at + np.arange(len(at))], length


@lru_cache(maxsize=1)
def tokenizer_of(path: str):
    """One per worker process; what a task learns about words ends with it."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def word_ends(path: str) -> np.ndarray | None:
    """For each id whether it ends a word; None for a vocabulary without word ends."""
    tokenizer = tokenizer_of(path)
    suffix, vocabulary = getattr(tokenizer.model, "end_of_word_suffix", None), tokenizer.get_vocab(with_added_tokens=True)
    if not suffix:
        return None
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return ends


class WordIds:
    """Ids of words of a lower-case BPE with word ends.

    White space separates words for this tokenizer and leaves no id, so a text's ids are those of its words in order. Inside
    a word the tokenizer cuts at fixed places, and the ids of what lies between depend on nothing else; such *units* are
    few, so only they are encoded, once while they are remembered: ``WHOLE`` ones many at a time as one text, whose ids are
    cut at word ends. Words with other characters than ``SAFE`` ones, or with a special token's text, are units as they are.
    """

    def __init__(self, path: str, limit: int = CACHE_UNITS):
        self.tokenizer, self.ends, self.limit, self.known = tokenizer_of(path), word_ends(path), limit, {}
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())

    def ids_of(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, one after the other, and their numbers."""
        if len(self.known) + len(units) > self.limit:
            self.known.clear()
        fresh = [u for u in units if u not in self.known]
        for at in range(0, len(fresh), 2000):
            part = self.joined(fresh[at : at + 2000])
            encoded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update((u, pack_ids(e.ids)) for u, e in zip(part, encoded))
        ids = [self.known[u] for u in units]
        return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4

    def joined(self, units: list[str]) -> list[str]:
        """Learn the whole ones of ``units`` from one text; the others are returned."""
        if self.ends is None or not units:
            return units
        array = pa.array(units, pa.string())
        fit = pc.match_substring_regex(array, WHOLE)
        if self.special:
            fit = pc.and_not(fit, pc.match_substring_regex(array, self.special))
        whole = strings(array.filter(fit))
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(whole)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cuts) != len(whole) or cuts[-1:].sum() != ids.nbytes:
            return units
        flat, upto = ids.tobytes(), cuts.tolist()
        self.known.update((u, flat[a:b]) for u, a, b in zip(whole, [0, *upto], upto))
        return strings(array.filter(pc.invert(fit)))

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and their numbers."""
        cut = pc.match_substring_regex(words, SAFE)
        if self.special:
            cut = pc.and_not(cut, pc.match_substring_regex(words, self.special))
        spaced = pc.replace_substring_regex(pc.utf8_lower(words), UNITS, r"\1 ")
        split = pc.ascii_split_whitespace(pc.if_else(cut, spaced, words))
        units = split.flatten().dictionary_encode()
        flat, sizes = self.ids_of(strings(units.dictionary))
        flat, length = gathered(flat, sizes, units.indices.to_numpy())
        offsets = np.asarray(split.offsets) - split.offsets[0].as_py()
        return flat, np.diff(np.r_[0, np.cumsum(length)][offsets])


def ids_of_texts(texts: pa.Array, known: WordIds, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, each text with its end id, and the texts' offsets there.

    Words are coded by an Arrow dictionary, the ids of the distinct ones lie in one flat array, and the texts' ids are
    gathered from it by code.
    """
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    coded = split.flatten().dictionary_encode()
    flat, sizes = known.encode(coded.dictionary)
    ends = np.asarray(split.offsets)[1:] - split.offsets[0].as_py()
    codes = np.insert(coded.indices.to_numpy(), ends, len(sizes))  # an end after each text
    ids, length = gathered(np.r_[flat, np.uint32(end_id)], np.r_[sizes, 1], codes)
    return ids, np.r_[0, np.cumsum(length)[ends + np.arange(len(ends))]]


def tokenised(
    docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, sequence: int, end_id: int, cache_units: int
) -> DataFrame:
    """Pieces of every row: its full windows, then the remainder (if any); one pass without shuffle. ``digest`` names the
    whole text's ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = WordIds(tokenizer_path, cache_units)
        for batch in parts(batches, 500):
            ids, offsets = ids_of_texts(batch.column(1), known, end_id)
            out: list[tuple] = []
            for doc, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                name = xxhash.xxh3_64_intdigest(ids[a:b]) - (1 << 63)
                for start in range(a, b, sequence):
                    piece = ids[start : min(start + sequence, b)]
                    out.append((doc, start - a, len(piece), zlib.crc32(piece), b - a, name, len(piece) == sequence))
            yield dict(zip(("id", "start", "length", "ids_crc32", "doc_tokens", "digest", "full"), zip(*out)))

    return arrow_pass(only(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")), task, PIECES)


def pack_sizes(sizes: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece (all shorter than ``sequence``), in the order given."""
    count = np.zeros(sequence + 1, np.int64)  # windows at each fill level; full and empty ones don't count
    open_at: list[list[int]] = [[] for _ in range(sequence + 1)]
    window, offset, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        top = sequence - s
        # Growth of the sum of squares: leaving level h and arriving at h + s.
        grow = 2 * (count[s : sequence + 1] - count[: top + 1]) + 2
        grow[0] = 2 * count[s] + 1  # a new window leaves no level
        grow[top] = 1 - 2 * count[top]  # a full window is no longer counted
        grow[1:][count[1 : top + 1] == 0] = len(sizes) * 4 + 4  # nothing stands there
        level = top - int(np.argmin(grow[::-1]))  # of equal ones the fullest
        if level:
            w = open_at[level].pop()
            count[level] -= 1
        else:
            w, made = made, made + 1
        window[i], offset[i] = w, level
        if level + s < sequence:
            count[level + s] += 1
            open_at[level + s].append(w)
    return window, offset


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence: int = SEQUENCE,
    end_id: int = END_ID,
    group_pieces: int = GROUP_PIECES,
    cache_units: int = CACHE_UNITS,
) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is a document of its end id alone. Repeated rows are packed once each. Null ids stay null.
    An empty table gives no piece. ``cache_units`` trades a task's memory for time and changes no result. Sequence ids are unique, not dense: packing group, then window in it. The
    result depends on the rows alone, not on how they lie in files or how tasks are retried: pieces are dealt by id, digest
    of the document's ids, start and number among equal pieces, and a group is packed in that order.
    """
    pieces = materialize(tokenised(docs, tokenizer_path, id_col, text_col, sequence, end_id, cache_units), "pieces")
    n = pieces.count()
    groups = max(1, -(-n // group_pieces))
    alike = pieces.groupBy(*pieces.columns).agg(F.count(F.lit(1)).alias("copies"))
    each = alike.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    dealt = each.withColumn("dealt", F.pmod(F.xxhash64("id", "digest", "start", "copy"), F.lit(groups)).cast("int"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "digest", "start", "copy"], kind="stable", ignore_index=True)
        full = rows.full.to_numpy()
        window, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        window[~full], offset[~full] = pack_sizes(rows.length.to_numpy()[~full], sequence)
        window[full] = window[~full].max(initial=-1) + 1 + np.arange(full.sum())
        rows["sequence_id"], rows["offset"] = (int(key[0]) << 40) + window, offset
        return rows[["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]].astype({"id": "Int64"})

    return dealt.groupBy("dealt").applyInPandas(run, PACKED).withColumnRenamed("id", id_col)
