"""Text functions as native column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from evispan.constants import EXCERPT_CHARS, SUMMARY_CHARS

# The characters Python's str.strip() and str.split() treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
LINE_BREAK = r"\r\n|[\x{a}-\x{d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
TERM = r"[\p{L}\p{N}]+"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\p{M}\p{Z}\p{C}]"

# Character ranges the native form of normalize_text handles without help: Latin and its
# extensions, combining marks, dashes, quotes and currency signs.
NATIVE_RANGES = ((0x00, 0x24F), (0x300, 0x36F), (0x1E00, 0x1EFF), (0x2010, 0x2027), (0x20A0, 0x20BF))


def fold_accents(text: str) -> str:
    """Casefold, decompose (NFKD), drop combining marks."""
    decomposed = unicodedata.normalize("NFKD", text.casefold())
    if decomposed.isascii():
        return decomposed
    return "".join(filter(lambda ch: not unicodedata.combining(ch), decomposed))


@lru_cache(maxsize=1)
def _native_map() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to, expansions) for ``translate`` and ``replace``, by applying the rule to every character
    of the native ranges. Characters that map to nothing come last, where ``translate`` deletes them."""
    single, dropped, expanded = {}, [], []
    for low, high in NATIVE_RANGES:
        for code in range(low, high + 1):
            char = chr(code)
            folded = fold_accents(char)
            if not folded:
                dropped.append(char)
            elif len(folded) > 1:
                expanded.append((char, folded))
            elif folded != char:
                single[char] = folded
    return "".join(single) + "".join(dropped), "".join(single.values()), tuple(expanded)


def _outside_native() -> str:
    return "[^" + "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in NATIVE_RANGES) + "]"


@F.pandas_udf(StringType())
def _fold_accents_exact(texts: pd.Series) -> pd.Series:
    return texts.map(fold_accents, na_action="ignore")


def normalize_text(text: Column, exact: bool = True) -> Column:
    """Casefold, decompose and drop combining marks.

    ASCII rows take ``lower``; Latin rows a character translation; both stay in the JVM. With ``exact``
    the rows holding any other script go through an Arrow function (all other rows are sent as null).
    ``exact=False`` leaves characters outside the native ranges lower-cased only. The tests for the rarer
    cases are nested behind cheap one-range tests, which most rows end at.
    """
    source, target, expansions = _native_map()
    sharp_s = F.replace(F.translate(text, source, target), F.lit("ß"), F.lit("ss"))
    expanded = sharp_s
    for char, folded in expansions:
        expanded = F.replace(expanded, F.lit(char), F.lit(folded))
    latin = F.when(text.rlike(r"[\x{bc}-\x{be}\x{100}-\x{10ffff}]"), expanded).otherwise(sharp_s)
    not_ascii = text.rlike(r"[^\x{0}-\x{7f}]")
    outside = text.rlike(r"[^\x{0}-\x{24f}]") & text.rlike(_outside_native())
    if not exact:
        return F.when(not_ascii, F.when(outside, F.lower(latin)).otherwise(latin)).otherwise(F.lower(text))
    native = F.when(not_ascii, latin).otherwise(F.lower(text))
    return F.coalesce(_fold_accents_exact(F.when(outside, text)), native)


def tokenize(normalized: Column) -> Column:
    """Runs of letters and digits, in order."""
    return F.regexp_extract_all(normalized, F.lit(TERM), F.lit(0))


def remove_stopwords(tokens: Column, stopwords: Sequence[str]) -> Column:
    """Drop stop words; repeats of the other tokens stay (term frequency needs them)."""
    if not stopwords:
        return tokens
    return F.filter(tokens, lambda token: ~token.isin(list(stopwords)))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, also where ``use`` needs it inside a lambda
    function (Spark would otherwise evaluate it for every element)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of an array of tokens, sorted by term, inside the row.

    The tokens are sorted and cut at each change of value, so no shuffle is needed to count the terms of a
    chunk.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return bind(
            starts,
            lambda first: F.transform(
                first,
                lambda at, i: F.struct(
                    F.get(ordered, at).alias("term"),
                    (F.coalesce(F.get(first, i + 1), F.size(ordered)) - at).cast("int").alias("tf"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<term:string,tf:int>>")
    return F.when(F.size(tokens) > 0, bind(F.sort_array(tokens), runs)).otherwise(empty)


def token_count(text: Column) -> Column:
    """Default token counter: words, and each punctuation sign on its own."""
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def collapse_whitespace(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, WHITESPACE_CLASS + "+", " "))


def excerpt(text: Column, length: int = EXCERPT_CHARS) -> Column:
    """The first characters of a text with its white space collapsed. Mostly its beginning tells them; only texts with very much white
    space there are collapsed as a whole."""
    start = collapse_whitespace(F.substring(text, 1, 4 * length))
    return F.when(F.length(start) >= length, F.substring(start, 1, length)).otherwise(F.substring(collapse_whitespace(text), 1, length))


def answer_key(answer: Column) -> Column:
    """Form in which answers are compared: lower case, white space collapsed."""
    return collapse_whitespace(F.lower(answer))


def short_summary(answer: Column) -> Column:
    return F.substring(F.get(F.split(answer, "\n\n", 2), F.lit(0)), 1, SUMMARY_CHARS)


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


@F.pandas_udf(StringType())
def _casefold_exact(texts: pd.Series) -> pd.Series:
    return texts.map(str.casefold, na_action="ignore")


@F.pandas_udf(StringType())
def _compat_casefold_exact(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: unicodedata.normalize("NFKC", text).casefold(), na_action="ignore")


# Latin-1 letters fold as lower() does, except sharp s (two letters) and the micro sign (Greek mu).
_LATIN1_OUTSIDE = r"[^\x{0}-\x{ff}]"


def casefold(text: Column) -> Column:
    """Python's ``casefold``: native up to Latin-1, Arrow for rows with any other character."""
    latin1 = F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("\u00b5"), F.lit("\u03bc"))
    return F.coalesce(_casefold_exact(F.when(text.rlike(_LATIN1_OUTSIDE), text)), latin1)


# Latin-1 characters that NFKC rewrites, and everything beyond; rows holding one take the exact function.
_NFKC_OUTSIDE = r"[\x{a0}\x{a8}\x{aa}\x{af}\x{b2}-\x{b5}\x{b8}-\x{ba}\x{bc}-\x{be}\x{100}-\x{10ffff}]"
_SOME_OUTSIDE = r"[\x{a0}-\x{be}\x{100}-\x{10ffff}]"


def compat_casefold(text: Column) -> Column:
    """NFKC then casefold; accents are kept."""
    latin1 = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    outside = text.rlike(_SOME_OUTSIDE) & text.rlike(_NFKC_OUTSIDE)
    return F.coalesce(_compat_casefold_exact(F.when(outside, text)), latin1)
