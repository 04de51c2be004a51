"""Input rules as column predicates."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, functions as F

from evispan.constants import (
    ALLOWED_REASON,
    BLOCKED_VIOLATION,
    DEFAULT_DEPTH,
    EMPTY_VIOLATION,
    MAX_ROUNDS,
    MIN_QUESTION_CHARS,
)
from evispan.functions.terms import found_terms
from evispan.functions.text import compat_casefold, strip

# Longest list that is written into the plan as patterns; longer ones go to the tasks as one automaton.
PATTERN_TERMS = 64
WORD = r"[\p{L}\p{N}_]"


def valid_question(question: Column) -> Column:
    return F.coalesce(F.length(question) >= MIN_QUESTION_CHARS, F.lit(False))


def valid_clarification(answer: Column) -> Column:
    return F.coalesce(F.length(answer) >= 1, F.lit(False))


def depth_or_default(depth: Column) -> Column:
    return F.coalesce(depth, F.lit(DEFAULT_DEPTH))


def valid_depth(depth: Column) -> Column:
    return depth_or_default(depth).between(1, MAX_ROUNDS)


def is_empty(text: Column) -> Column:
    return strip(text) == ""


def is_too_long(text: Column, max_characters: int) -> Column:
    """The limit applies to the text as sent, before stripping."""
    return F.length(text) > max_characters


def _term_pattern(terms: list[str]) -> str:
    folded = [re.escape(unicodedata.normalize("NFKC", term).casefold()) for term in terms]
    return f"(?<!{WORD})(?:{'|'.join(folded)})(?!{WORD})"


def blocked_terms(normalized: Column, terms: list[str]) -> Column:
    """The terms found as whole words in text already put through ``compat_casefold``. One combined pattern
    clears most rows; only rows it matches are checked term by term. The list is configuration, in order; a list of more than
    ``PATTERN_TERMS`` is searched by an automaton, with the same result."""
    none = F.array().cast("array<string>")
    if not terms:
        return none
    if len(terms) > PATTERN_TERMS:
        return found_terms(normalized, terms)
    each = F.array_compact(F.array(*[F.when(normalized.rlike(_term_pattern([term])), F.lit(term)) for term in terms]))
    return F.when(normalized.rlike(_term_pattern(terms)), each).otherwise(none)


def violations(text: Column, field: str, max_characters: int, terms: list[str]) -> Column:
    """Messages of the broken rules in their order: empty, too long, blocked content."""
    rules = [
        F.when(is_empty(text), F.lit(field + EMPTY_VIOLATION)),
        F.when(is_too_long(text, max_characters), F.lit(f"{field} excede o limite de {max_characters} caracteres")),
    ]
    if terms:
        folded = compat_casefold(text)
        blocked = F.size(found_terms(folded, terms)) > 0 if len(terms) > PATTERN_TERMS else folded.rlike(_term_pattern(terms))
        rules.append(F.when(blocked, F.lit(BLOCKED_VIOLATION)))
    return F.array_compact(F.array(*rules))


def decision(found: Column) -> Column:
    """``struct<allowed, reason, violations>`` of an array of violations."""
    allowed = F.size(found) == 0
    return F.struct(
        allowed.alias("allowed"),
        F.when(allowed, F.lit(ALLOWED_REASON)).otherwise(F.array_join(found, "; ")).alias("reason"),
        found.alias("violations"),
    )


def blocked_term_list(raw: Column) -> Column:
    """A configured list: a JSON list of texts, or any other text split at commas; trimmed, blanks dropped.
    Null where the text is JSON but not a list of texts, which is a configuration error."""
    trimmed = strip(raw)
    parsed = F.try_parse_json(trimmed)
    shape = F.schema_of_variant(parsed)
    json_list = F.when(shape.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.from_json(trimmed, "array<string>"))
    no_terms = F.array().cast("array<string>")
    values = (
        F.when(trimmed == "", no_terms)
        .when(parsed.isNull(), F.split(trimmed, ","))
        .when(shape == "ARRAY<VOID>", F.when(F.size(json_list) == 0, no_terms))
        .otherwise(json_list)
    )
    return F.filter(F.transform(values, strip), lambda term: term != "")
