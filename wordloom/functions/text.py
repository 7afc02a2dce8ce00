"""Words of texts: Unicode word boundaries, with hyphens as letters between letters.

Boundaries are those of UAX 29 in all scripts (:mod:`.boundaries`): a Han, Hiragana or Thai
letter is a word of its own, a Katakana run is one, a sign or emoji is none.  A word is a
segment with a letter or number.  Null texts give null, empty ones no words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import boundaries


def _by_arrow(text: Column, result: str, kernel) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return kernel(texts)

    return F.arrow_udf(run, result)(text)


def words(text: Column, alphabet: str = "") -> Column:
    """The words of a text in order, as an array.  ``alphabet``: further characters that
    count as letters."""
    return _by_arrow(text, "array<string>", lambda texts: boundaries.list_words(texts, alphabet))


def word_count(text: Column, alphabet: str = "") -> Column:
    """How many words a text has."""
    return _by_arrow(text, "bigint", lambda texts: boundaries.count_words(texts, alphabet))


def word_starts(text: Column, alphabet: str = "") -> Column:
    """Byte offsets of the words, array<bigint>."""
    return _by_arrow(text, "array<bigint>", lambda texts: boundaries.list_starts(texts, alphabet))


def word_indices(text: Column, alphabet: str = "") -> Column:
    """Words with byte offsets, array<struct<idx bigint, word string>>."""
    return _by_arrow(text, "array<struct<idx: bigint, word: string>>", lambda texts: boundaries.list_indices(texts, alphabet))


def word_bounds(text: Column, alphabet: str = "") -> Column:
    """All segments, words and what lies between, as :func:`word_indices` has them."""
    return _by_arrow(text, "array<struct<idx: bigint, word: string>>", lambda texts: boundaries.list_indices(texts, alphabet, every=True))


def graphemes(text: Column) -> Column:
    """Extended grapheme clusters, as an array."""
    return F.regexp_extract_all(text, F.lit(r"(\X)"), 1)


def reversed_words(text: Column, alphabet: str = "") -> Column:
    """The words with offsets from the last to the first."""
    return F.reverse(word_indices(text, alphabet))


def cursor_context(first: Column, second: Column) -> Column:
    """The word at a cursor between two halves of a text, with two words either side.

    struct<current, first_before, second_before, first_after, second_after>, each
    struct<idx bigint, word string>.  Only the segment that touches the cursor is the
    current word, joined from both halves; offsets before it count in the first half,
    after it in the second."""
    left, right = word_indices(first), word_indices(second)
    tail, head = F.try_element_at(left, F.lit(-1)), F.try_element_at(right, F.lit(1))
    at_end = F.coalesce(tail["idx"] + F.octet_length(tail["word"]) == F.octet_length(first), F.lit(False))
    at_start = F.coalesce(head["idx"] == 0, F.lit(False))
    left_part, right_part = F.when(at_end, tail["word"]).otherwise(""), F.when(at_start, head["word"]).otherwise("")
    current = F.struct(F.when(at_end, tail["idx"]).otherwise(F.octet_length(first).cast("bigint")).alias("idx"), F.concat(left_part, right_part).alias("word"))
    skip_l, skip_r = at_end.cast("int"), at_start.cast("int")
    return F.struct(
        current.alias("current"),
        F.try_element_at(left, -1 - skip_l).alias("first_before"),
        F.try_element_at(left, -2 - skip_l).alias("second_before"),
        F.try_element_at(right, 1 + skip_r).alias("first_after"),
        F.try_element_at(right, 2 + skip_r).alias("second_after"),
    )


def segments(text: str, alphabet: str = "") -> list[tuple[int, str]]:
    """All segments of one text, words and what lies between, with byte offsets."""
    return [(x["idx"], x["word"]) for x in boundaries.list_indices(pa.array([text]), alphabet, every=True).to_pylist()[0]]


def py_word_indices(text: str, alphabet: str = "") -> list[tuple[int, str]]:
    """The words of one text, with byte offsets."""
    return [(x["idx"], x["word"]) for x in boundaries.list_indices(pa.array([text]), alphabet).to_pylist()[0]]
