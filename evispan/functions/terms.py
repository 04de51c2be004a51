"""Whole-word search for long term lists: one automaton for all terms, shared with the tasks once."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

# Longest list (in bytes of its folded terms) that is sent to the tasks.
TERM_BYTES = 64 << 20


def folded(term: str) -> str:
    return unicodedata.normalize("NFKC", term).casefold()


def _in_word(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


class TermSearch:
    """Positions in a list of the terms that stand in a folded text as whole words."""

    def __init__(self, terms: list[str]):
        places: dict[str, list[int]] = {}
        for i, term in enumerate(terms):
            places.setdefault(folded(term), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for term, found in places.items():
            self.automaton.add_word(term, (len(term), found))
        self.automaton.make_automaton()

    def of(self, text: str | None) -> list[int]:
        if not text:
            return []
        found: set[int] = set()
        for last, (length, places) in self.automaton.iter(text):
            first = last + 1 - length
            if first and _in_word(text[first - 1]):
                continue
            if last + 1 < len(text) and _in_word(text[last + 1]):
                continue
            found.update(places)
        return sorted(found)


def found_terms(normalized: Column, terms: list[str]) -> Column:
    """``array<string>``: the terms, in their order, that stand as whole words in text put through ``compat_casefold``; none in a
    null text. The plan's size doesn't depend on the list. A blank term, or more than ``TERM_BYTES`` of them, is an
    error of the configuration."""
    if not all(folded(term) for term in terms):
        raise ValueError("a blocked term is empty")
    size = sum(len(folded(term).encode()) for term in terms)
    if size > TERM_BYTES:
        raise ValueError(f"blocked terms hold {size} bytes; {TERM_BYTES} can be sent to the tasks")
    shared = SparkSession.active().sparkContext.broadcast(list(terms))

    def search(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        listed = shared.value
        automaton = TermSearch(listed)
        for part in parts:
            yield part.map(lambda text: [listed[i] for i in automaton.of(text)])

    search.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(search, "array<string>")(normalized)
