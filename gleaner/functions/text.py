"""Text scalars as Column expressions.

Two tokenisers exist on purpose: ASCII words for features and validation,
Unicode words of two or more characters for retrieval.  ``\\w`` and ``\\s`` are
ASCII-only in Java, so classes are spelled out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.config import BANNED_PHRASES, STOP_WORDS

# What counts as white space, a word, a term, an entity, a number and an
# identifier.  The class bodies are valid in Java and in RE2.
WS_CLASS = r"\s\x0b\x1c-\x1f\x85\p{Z}"
WS = f"[{WS_CLASS}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SENTENCE_BREAK = rf"(?<=[.!?]){WS}+"

WORD = "[A-Za-z0-9_]+"
TERM = r"[\p{L}\p{N}_]{2,}"
ENTITY = "[A-Za-z][A-Za-z0-9_./:-]*"
TOKEN_PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
NUMBER = r"(?U)\b\d+(?:\.\d+)?%?\b"
IDENTIFIER = r"(?iU)\b[a-z]{2,4}_[a-z0-9]{3,}\b"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a let-expression)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def lines(text: Column) -> Column:
    """Lines of ``text``; a trailing terminator adds no empty line."""
    return bind(
        F.split(text, LINE_BREAK, -1),
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts),
    )


def is_stop_word(token: Column) -> Column:
    return token.isin(*STOP_WORDS)


def tokenize(text: Column) -> Column:
    return F.transform(matches(text, WORD), F.lower)


def content_tokens(text: Column) -> Column:
    return F.filter(tokenize(text), lambda t: ~is_stop_word(t))


def retrieval_terms(text: Column) -> Column:
    return F.filter(matches(F.lower(text), TERM), lambda t: ~is_stop_word(t))


def term_counts(terms: Column) -> Column:
    """``array<struct<term,tf>>`` of a term array, sorted by term, in one row.

    Sorting once and measuring run lengths keeps the count inside the row, so
    no (chunk, term) shuffle is needed.
    """

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return bind(
            starts,
            lambda st: F.transform(
                st,
                lambda v, j: F.struct(
                    F.get(s, v).alias("term"),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - v).alias("tf"),
                ),
            ),
        )

    empty = F.expr("cast(array() as array<struct<term:string,tf:int>>)")
    return bind(
        F.sort_array(terms), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(empty)
    )


def split_sentences(text: Column) -> Column:
    return F.filter(
        F.transform(F.split(strip(text), SENTENCE_BREAK, -1), strip), lambda s: s != ""
    )


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of the set ``a`` that is also in ``b``; 0.0 for an empty ``a``."""
    return bind(
        F.array_distinct(a),
        lambda s: F.when(
            F.size(s) > 0, F.size(F.array_intersect(s, b)) / F.size(s)
        ).otherwise(F.lit(0.0)),
    )


def entity_tokens(text: Column) -> Column:
    """Distinct lower-cased tokens that look like names, paths or codes."""
    looks_special = lambda t: t.rlike("[0-9_./-]") | (
        t.rlike("^[A-Z]") & (F.length(t) > 1)
    )
    return F.array_distinct(F.transform(F.filter(matches(text, ENTITY), looks_special), F.lower))


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs of an array, joined by one space (duplicates kept)."""
    return bind(
        tokens,
        lambda a: F.transform(
            F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))),
            lambda t, i: F.concat_ws(" ", t, F.get(a, i + 1)),
        ),
    )


def phrase_share(phrases: Column, text: Column) -> Column:
    """Share of ``phrases`` that are substrings of ``lower(text)``."""
    return bind(
        F.struct(phrases.alias("p"), F.lower(text).alias("t")),
        lambda s: F.when(
            F.size(s["p"]) > 0,
            F.size(F.filter(s["p"], lambda p: F.contains(s["t"], p))) / F.size(s["p"]),
        ).otherwise(F.lit(0.0)),
    )


def count_tokens(text: Column) -> Column:
    """Default token counter: words and single punctuation marks."""
    return F.regexp_count(text, F.lit(TOKEN_PIECE))


def find_banned_claim(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in BANNED_PHRASES])


def numbers(text: Column) -> Column:
    return F.array_distinct(matches(text, NUMBER))


def identifiers(text: Column) -> Column:
    return F.array_distinct(F.transform(matches(text, IDENTIFIER), F.lower))
