"""Packing of one large collection by many tasks.

Packing pieces while they fit depends on what came before only through the fill of the open chunk. So each group of
consecutive pieces is summed up as a function of that fill: where it makes the group's first cut, how many chunks begin from there
on, and the fill at the group's end. A fold over these summaries (one row per group) tells every group the fill it starts
with and the number of its open chunk, and then all groups are packed side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evispan.session import materialize

# Consecutive pieces of a group, as a power of two.
GROUP_BITS = 15

# Stands for a group that can't lie in one chunk, as its key changes.
NEVER = 1 << 60
KEY = ["collection_id", "source", "head"]
SUMMARY = (
    "collection_id string, blk bigint, role int, source string, head string, last_source string, last_head string, "
    "alone boolean, sums array<bigint>, starts array<bigint>, fills array<bigint>, total bigint"
)
CARRY = "blk bigint, goes_on boolean, carried bigint, open_no bigint"
PARTIAL = "collection_id string, chunk_id bigint, source string, head string, blk bigint, text string, pages array<int>, n_tokens int, edge boolean"


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


class Group:
    """Consecutive pieces in reading order."""

    def __init__(self, frame: pd.DataFrame, budget: int):
        self.budget, self.n = budget, len(frame)
        self.keys = list(zip(*(frame[c].tolist() for c in KEY)))
        self.head_n = frame["head_n"].to_numpy(np.int64)
        self.sums = np.concatenate([[0], np.cumsum(frame["n"].to_numpy(np.int64))])
        changes = [i for i in range(1, self.n) if self.keys[i] != self.keys[i - 1]]
        self.edges = np.array([*changes, self.n])
        self.first_edge = int(self.edges[0])
        # Where the next chunk begins if one begins here: where the budget is passed, or at the next change of key.
        at = np.arange(self.n)
        full = np.searchsorted(self.sums[1:], self.budget - self.head_n + self.sums[:-1], side="right")
        self.next = np.minimum(np.maximum(full, at + 1), self.edges[np.searchsorted(self.edges, at, side="right")])

    def first_cut(self, goes_on: bool, carried: int) -> int:
        if not goes_on:
            return 0
        return int(min(np.searchsorted(self.sums[1:], self.budget - carried, side="right"), self.first_edge))

    def starts(self, at: int) -> list[int]:
        found = []
        while at < self.n:
            found.append(at)
            at = int(self.next[at])
        return found

    def fill(self, start: int) -> int:
        """At the end, of a chunk that began at ``start``."""
        return int(self.head_n[start] + self.sums[self.n] - self.sums[start])

    def summary(self, blk: int) -> list[tuple]:
        """One row for the first collection and, if it is another one, one for the last. Entry i of the lists holds for a first cut at i."""
        first, last = self.keys[0], self.keys[-1]
        cuts = int(min(np.searchsorted(self.sums[1:], self.budget, side="right"), self.first_edge))
        count, fill = np.zeros(self.n + 1, np.int64), np.zeros(self.n + 1, np.int64)
        for at in range(self.n - 1, -1, -1):
            after = self.next[at]
            count[at] = count[after] + 1
            fill[at] = self.fill(at) if after == self.n else fill[after]
        alone = first[0] == last[0]
        listed = slice(0, min(cuts, self.n - 1) + 1)
        total = int(self.sums[self.n]) if self.first_edge == self.n else NEVER
        row = (first[0], blk, 0, *first[1:], *last[1:], alone, self.sums[1:][listed].tolist(), count[listed].tolist(), fill[listed].tolist(), total)
        if alone:
            return [row]
        own = self.n - 1
        while self.keys[own - 1][0] == last[0]:
            own -= 1
        return [row, (last[0], blk, 1, *last[1:], *last[1:], True, [], [int(count[own])], [int(fill[own])], 0)]


def _fold(budget: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Over the summaries of a collection in order; holds the open chunk's key, fill and number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for frame in frames:
            out = []
            for c, blk, role, source, head, last_source, last_head, alone, sums, starts, fills, total in frame[_names(SUMMARY)].itertuples(index=False, name=None):
                if role == 1:  # the collection begins inside this group
                    state = (c, last_source, last_head, int(fills[0]), int(starts[0]) - 1)
                    continue
                same = state is not None and state[0] == c
                number = state[4] if same else -1
                goes_on = same and state[1:3] == (source, head)
                used = state[3] if goes_on else 0
                out.append((blk, goes_on, used, number))
                if not alone:
                    state = None
                    continue
                # The first of the listed sums that passes what is left makes the cut.
                cut = int(np.searchsorted(np.asarray(sums), budget - used, side="right")) if goes_on else 0
                if cut < len(starts):
                    state = (c, last_source, last_head, int(fills[cut]), number + int(starts[cut]))
                elif total <= budget - used:  # no cut
                    state = (c, last_source, last_head, used + int(total), number)
                else:  # the cut is where the first key ends, the last entry
                    state = (c, last_source, last_head, int(fills[-1]), number + int(starts[-1]))
            if out:
                yield pd.DataFrame(out, columns=_names(CARRY))

    return run


def pack_large(located: DataFrame, order: list, budget: int, bits: int = GROUP_BITS) -> DataFrame:
    """Chunks ``collection_id, chunk_id, text, source, pages, n_tokens`` of pieces ``collection_id, source, head, page_no, text, n,
    head_n`` read in ``order``; the same as one task per collection would make."""
    lined = located.repartitionByRange(*order).sortWithinPartitions(*order)
    wanted = ["collection_id", "source", "head", "page_no", "text", "n", "head_n"]
    placed = materialize(lined.select(*wanted).withColumn("at", F.monotonically_increasing_id()), "pieces")
    placed = placed.withColumn("blk", F.shiftright("at", bits))

    def sum_up(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(Group(frame.sort_values("at"), budget).summary(key[0]), columns=_names(SUMMARY))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        group = Group(frame, budget)
        goes_on, carried, number = bool(frame["goes_on"].iloc[0]), int(frame["carried"].iloc[0]), int(frame["open_no"].iloc[0])
        cuts = group.starts(group.first_cut(goes_on, carried))
        begins = cuts if cuts and cuts[0] == 0 else [0, *cuts]
        texts, pages, out = frame["text"].tolist(), frame["page_no"].tolist(), []
        for begin, end in zip(begins, [*begins[1:], group.n]):
            own, opened = group.keys[begin], bool(cuts) and begin >= cuts[0]
            if begin and own[0] != group.keys[begin - 1][0]:
                number = -1
            number += opened
            n = int(group.sums[end] - group.sums[begin]) + (int(group.head_n[begin]) if opened else 0)
            found = sorted({int(p) for p in pages[begin:end] if not pd.isna(p)})
            out.append((own[0], number, own[1], own[2], key[0], "\n".join(texts[begin:end]), found, n, not opened or end == group.n))
        return pd.DataFrame(out, columns=_names(PARTIAL))

    sizes = placed.select("collection_id", "source", "head", "n", "head_n", "at", "blk")
    summaries = sizes.groupBy("blk").applyInPandas(sum_up, SUMMARY)
    lined_up = summaries.repartition("collection_id").sortWithinPartitions("collection_id", "blk")
    carries = materialize(lined_up.mapInPandas(_fold(budget), CARRY), "carries")
    packed = materialize(placed.join(carries, "blk").groupBy("blk").applyInPandas(pack, PARTIAL), "partial-chunks")
    parts = F.sort_array(F.collect_list(F.struct("blk", "text", "pages", "n_tokens")))
    joined = (
        packed.where("edge")
        .groupBy("collection_id", "chunk_id", "source", "head")
        .agg(parts.alias("parts"))
        .select(
            "collection_id", "chunk_id", "source", "head", F.array_join("parts.text", "\n").alias("text"),
            F.array_sort(F.array_distinct(F.flatten("parts.pages"))).alias("pages"),
            F.aggregate("parts.n_tokens", F.lit(0), lambda total, n: total + n).alias("n_tokens"),
        )
    )
    every = packed.where("NOT edge").select(*joined.columns).unionByName(joined)
    text = F.when(F.col("head") != "", F.concat("head", F.lit("\n"), "text")).otherwise(F.col("text"))
    return every.select("collection_id", "chunk_id", text.alias("text"), "source", "pages", "n_tokens")
