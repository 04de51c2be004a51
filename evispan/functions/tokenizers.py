"""Pluggable tokenizers for token counts and token budgets.

A tokenizer is a factory, called once per task, of a callable ``list[str] -> list[list[int]]``: the ends of each text's tokens, in
code points from its start. Counting and cutting both go by these ends, so they can't disagree. None stands for the
native default (words and single punctuation signs), which needs no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, functions as F

from evispan.functions.text import TOKEN, strip, token_count
from evispan.plugins import Factory

# Words whose pieces a task remembers at most.
HELD_WORDS = 100_000
# Characters of texts whose tokens are held at a time; a longer text goes alone.
HELD_CHARS = 1_000_000


def _held(texts: Iterable[str]) -> Iterator[list[str]]:
    """``texts`` in lists of a bounded length in characters, in order."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > HELD_CHARS:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def token_ends(text: Column, tokenizer: Factory) -> Column:
    """``array<int>``: where the tokens of ``text`` end; null text has none. A task keeps four bytes per token."""

    def ends(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = tokenizer()
        for part in parts:
            found = [np.asarray(one, dtype=np.int32) for some in _held(part.fillna("")) for one in call(some)]
            yield pd.Series(found, index=part.index, dtype=object)

    ends.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(ends, "array<int>")(text)


def counted(text: Column, tokenizer: Factory | None = None) -> Column:
    """Number of tokens of ``text``; null text has none. Of a tokenizer's ends only their numbers leave its task."""
    if tokenizer is None:
        return token_count(text)

    def sizes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = tokenizer()
        for part in parts:
            found = [len(one) for some in _held(part.fillna("")) for one in call(some)]
            yield pd.Series(found, index=part.index, dtype="int32")

    sizes.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(sizes, "int")(text)


def cut_at_ends(text: Column, ends: Column, budget: Column) -> Column:
    """``array<struct<text, n>>``: the text itself while it keeps within ``budget`` tokens, else slices of that many. A slice
    begins where the one before it ended, and the last one goes to the end of the text."""
    size = F.size(ends)

    def one(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i * budget - 1))
        last = (i + 1) * budget >= size
        n = F.when(last, size - i * budget).otherwise(budget).cast("int")
        end = F.when(last, F.length(text)).otherwise(F.get(ends, (i + 1) * budget - 1))
        return F.struct(strip(F.substring(text, start + 1, end - start)).alias("text"), n.alias("n"))

    whole = F.array(F.struct(strip(text).alias("text"), size.cast("int").alias("n")))
    count = F.ceil(size / budget).cast("int")
    return F.when(size <= budget, whole).otherwise(F.transform(F.sequence(F.lit(0), count - 1), one))


def _by_word(pieces: Callable[[str], list[int]]) -> Factory:
    """A tokenizer that cuts each word (of the default tokens) on its own; ``pieces`` gives the ends inside a word."""

    def factory() -> Callable[[list[str]], list[list[int]]]:
        token = regex.compile(TOKEN)
        held: dict[str, list[int]] = {}

        def call(texts: list[str]) -> list[list[int]]:
            out = []
            for text in texts:
                ends: list[int] = []
                for found in token.finditer(text):
                    word = found.group()
                    if word not in held:
                        if len(held) >= HELD_WORDS:
                            held.clear()
                        held[word] = pieces(word)
                    start = found.start()
                    ends += [start + end for end in held[word]]
                out.append(ends)
            return out

        return call

    return factory


def fixed_pieces(width: int) -> Factory:
    """Pieces of at most ``width`` code points inside a word."""
    return _by_word(lambda word: [*range(width, len(word), width), len(word)])


def longest_pieces(vocabulary: Iterable[str], mark: str = "##") -> Factory:
    """Greedy longest match from a trie of ``vocabulary``; entries that begin with ``mark`` go on inside a word. A word with a
    place that no entry matches is one token."""
    leaf = ""  # no code point, so it can't be a branch
    begin, inside = {}, {}
    for entry in vocabulary:
        node = inside if entry.startswith(mark) and entry != mark else begin
        for c in entry.removeprefix(mark) if node is inside else entry:
            node = node.setdefault(c, {})
        node[leaf] = True

    def pieces(word: str) -> list[int]:
        ends, at = [], 0
        while at < len(word):
            node, end = inside if at else begin, 0
            for i in range(at, len(word)):
                node = node.get(word[i])
                if node is None:
                    break
                if leaf in node:
                    end = i + 1
            if not end:
                return [len(word)]
            ends.append(end)
            at = end
        return ends

    return _by_word(pieces)
