"""Tokenising, word-set similarity and byte-length helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the words ignored by every similarity measure.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from",
    "as", "is", "was", "are", "this", "that", "it", "i", "you", "we", "he", "she", "they", "be",
    "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "can", "not", "no", "yes", "ok", "so", "if", "then", "than", "when", "where", "what",
    "how", "why", "who", "which", "there", "here",
)

WORD_BREAK = r"[^\p{IsAlphabetic}\p{N}]+"
SPACE_RUN = r"(?U)\s+"
EDGE_SPACE = r"(?U)^\s+|\s+$"


def trim_all(text: Column) -> Column:
    """Without white space, Unicode's included, at the ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def _lowered_pieces(text: Column) -> Column:
    # Split before lowering: lowering can turn one letter into letter + mark.
    return F.transform(F.split(text, WORD_BREAK), lambda piece: F.lower(piece))


def tokens(text: Column) -> Column:
    """Meaningful words in text order, repeats kept."""
    return F.filter(
        _lowered_pieces(text), lambda word: (word != "") & ~word.isin(list(STOPWORDS))
    )


def word_set(text: Column) -> Column:
    """Distinct meaningful words."""
    ignored = F.split(F.lit(" ".join(["", *STOPWORDS])), " ")
    return F.array_except(_lowered_pieces(text), ignored)


def each_word(words: Column) -> Column:
    """One row per array item; drop NULLs afterwards with ``where``.

    The outer form keeps the optimizer from testing the array's size in a filter
    of its own, which would tokenise every text twice.
    """
    return F.explode_outer(words)


def computed_once(value: Column) -> Column:
    """A select item that stops the optimizer from copying ``value`` into later filters.

    A filter on a computed column is pushed below the projection together with
    the whole expression, so an expensive value would be worked out twice per
    row. Filters are not pushed through a generator's own output.
    """
    return F.explode_outer(F.array(value))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it; works inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def jaccard(left: Column, right: Column) -> Column:
    """Shared share of two word sets; 0 when either is empty."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(shared / union)


def space_separated_words(text: Column) -> Column:
    """Number of whitespace-separated words, the rough token estimate."""
    return F.size(F.filter(F.split(text, SPACE_RUN), lambda word: word != ""))


def truncate_chars(text: Column, limit: int) -> Column:
    return F.left(text, F.lit(limit))


def truncate_bytes(text: Column, limit: int, ellipsis: str = "…") -> Column:
    """Keep at most ``limit - 1`` bytes plus an ellipsis, on a character boundary."""
    room = limit - 1
    # Start from the character count that fits if every character is one byte,
    # then drop the characters that overflow (a character is at most 4 bytes).
    left = F.left(text, F.lit(room))
    overflow_free = F.element_at(
        F.filter(
            F.transform(
                F.sequence(F.lit(room), F.lit(max(room // 4, 1)), F.lit(-1)),
                lambda n: F.left(left, n),
            ),
            lambda s: F.octet_length(s) <= room,
        ),
        1,
    )
    plain = F.octet_length(left) <= room
    return (
        F.when(F.octet_length(text) <= limit, text)
        .when(plain, F.concat(left, F.lit(ellipsis)))
        .otherwise(F.concat(overflow_free, F.lit(ellipsis)))
    )
