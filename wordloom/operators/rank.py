"""Distances, penalties and limits of candidate corrections."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Reweighting

_CLUSTER = regex.compile(r"\X")
_EMOJI = regex.compile(r"\p{Emoji}*")


def clusters(text: str) -> list[str]:
    """Extended grapheme clusters of a string."""
    return list(text) if text.isascii() else _CLUSTER.findall(text)


def osa_distance(a: list[str], b: list[str]) -> int:
    """Edits between two sequences: insert, delete, substitute, or swap neighbours, no
    element edited twice (optimal string alignment)."""
    if a == b:
        return 0
    older: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        older, last = last, row
    return last[-1]


@F.pandas_udf(T.IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    memo: dict[tuple[str, str], int] = {}

    def one(x: str | None, y: str | None) -> int | None:
        if x is None or y is None:
            return None
        if (x, y) not in memo:
            memo[x, y] = osa_distance(clusters(x), clusters(y))
        return memo[x, y]

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="Int32")


def osa(a: Column, b: Column) -> Column:
    """Grapheme edit distance with swaps; null if a side is null."""
    return _distance(a, b)


def _shared(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _located_edits(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """Edits at the start, in the middle and at the end of two words.

    Of the ways to set aside at most one element at either end of either word, the one
    counts under which most elements agree at both ends, the earliest on ties; what is
    left between the agreeing parts is the middle."""
    ends = ((0, 0), (0, 1), (1, 0), (1, 1))
    found = (0, 0, 0, 0, 0, 0, 0)  # score, heads set aside, tails set aside, prefix, suffix
    for ha, hb in ends:
        for ta, tb in ends:
            if max(ha, ta) >= len(a) or max(hb, tb) >= len(b) or ha + ta >= len(a) or hb + tb >= len(b):
                continue
            prefix = _shared(a[ha:], b[hb:])
            suffix = _shared(a[ha : len(a) - ta][::-1], b[hb : len(b) - tb][::-1])
            if prefix + suffix > found[0]:
                found = (prefix + suffix, ha, hb, ta, tb, prefix, suffix)
    _, ha, hb, ta, tb, prefix, suffix = found
    start = osa_distance(a[:ha], b[:hb])
    end = osa_distance(a[len(a) - ta :], b[len(b) - tb :])
    suffix = max(0, min(suffix, min(len(a) - ha - ta, len(b) - hb - tb) - prefix))
    spans = []
    for word, head, tail in ((a, ha, ta), (b, hb, tb)):
        lo, hi = head + prefix, len(word) - tail - suffix
        spans.append((word[min(lo, hi) : max(lo, hi)], max(0, hi - lo), lo < hi))
    (rest_a, left_a, more_a), (rest_b, left_b, more_b) = spans
    if not left_a and not left_b:
        return start, 0, end
    if left_a <= 1 and left_b <= 1 and not suffix:
        return start, 0, 1
    middle = osa_distance(rest_a, rest_b) if more_a or more_b else 0
    # an edit in the middle that has nothing agreeing before (after) it is at the start (end)
    if middle and not prefix and suffix:
        return start + 1, middle - 1, end
    if middle and prefix and not suffix:
        return start, middle - 1, end + 1
    return start, middle, end


def _doubled(word: list[str], at: int, step: int) -> bool:
    return len(word) > 1 and word[at] == word[at + step]


def edit_places(source: str, value: str) -> tuple[int, int, int]:
    """(start, middle, end) edits between an input and a candidate, on small letters.
    Middle is -1 for two short words, where there is none."""
    a, b = clusters(source.lower()), clusters(value.lower())
    if not a and not b:
        start = middle = end = 0
    elif len(a) <= 2 and len(b) <= 2:
        start = int(a[0] != b[0]) if a and b else 1
        end = int(len(a) > 1 and len(b) > 1 and a[-1] != b[-1])
        middle = -1
    else:
        start, middle, end = _located_edits(a, b)
        if a and b:
            # one of two equal letters lost or added at an end belongs to the middle
            if start and a[0] == b[0] and (_doubled(a, 0, 1) or _doubled(b, 0, 1)):
                start, middle = 0, middle + start
            if end and a[-1] == b[-1] and (_doubled(a, -1, -1) or _doubled(b, -1, -1)):
                end, middle = 0, middle + end
    heads = clusters(source)[:1], clusters(value)[:1]
    if not start and heads[0] and heads[1] and heads[0] != heads[1] and heads[0][0].lower() == heads[1][0].lower():
        start = 1
    return start, middle, end


@lru_cache(maxsize=65536)
def penalties(source: str, value: str, mutator_weight: float | None, settings: Reweighting | None) -> tuple[float, float, float, float]:
    """(start, middle, end, total) penalties of a candidate; middle -1 says there is none.

    A correction that the error model offers for less than a middle edit apiece was put
    there on purpose and goes free; emoji go free as well."""
    if settings is None:
        return 0.0, 0.0, 0.0, 0.0
    start, middle, end = edit_places(source, value)
    edits = start + max(middle, 0) + end
    if mutator_weight is not None and edits and mutator_weight / edits < settings.mid_penalty:
        return 0.0, 0.0, 0.0, 0.0
    parts = (settings.start_penalty if start else 0.0, settings.mid_penalty * middle if middle >= 0 else -1.0, settings.end_penalty if end else 0.0)
    total = 0.0 if _EMOJI.fullmatch(value) else parts[0] + parts[2] + max(parts[1], 0.0)
    return *parts, total


PENALTIES = T.StructType([T.StructField(n, T.FloatType()) for n in ("start", "mid", "end", "total")])


def reweight(source: Column, value: Column, mutator_weight: Column, settings: Reweighting | None = Reweighting()) -> Column:
    """struct<start, mid, end, total float> of penalties; nulls count as empty words."""

    @F.pandas_udf(PENALTIES)
    def run(a: pd.Series, b: pd.Series, w: pd.Series) -> pd.DataFrame:
        rows = [penalties(x or "", y or "", None if z is None or z != z else float(z), settings) for x, y, z in zip(a, b, w)]
        return pd.DataFrame(rows, columns=["start", "mid", "end", "total"], dtype="float32")

    return run(source, value, mutator_weight)


def rank_suggestions(candidates: DataFrame, *, by: list[str], weight: str = "weight", lexicon_weight: str | None = None, value: str = "value", n_best: int | None = 10) -> DataFrame:
    """Adds ``rank`` from 1: lightest first, then the lexicon's share, then the text in
    byte order.  ``n_best`` None is no limit, 0 leaves nothing."""
    keys = [weight, *([lexicon_weight] if lexicon_weight else []), value]
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*keys)))
    return ranked if n_best is None else ranked.where(F.col("rank") <= n_best)


def weight_limits(ranked: DataFrame, *, by: list[str], source: str, weight: str = "weight", value: str = "value", max_weight: float | None = None, beam: float | None = None) -> DataFrame:
    """Keeps what is within ``beam`` of the lightest and not above ``max_weight``, and
    always what is the input itself but for case.  A beam of 0 is off."""
    best = F.min(weight).over(Window.partitionBy(*by))
    keep = F.lit(True)
    if beam is not None and beam > 0:
        keep = keep & (F.col(weight) <= best + F.lit(beam).cast("float"))
    if max_weight is not None:
        keep = keep & (F.col(weight) <= max_weight)
    return ranked.withColumn("__keep", keep | (F.lower(value) == F.lower(source))).where("__keep").drop("__keep")


def completed(value: Column, marker: str | None) -> Column:
    """Whether a suggestion is a whole word: it does not end in the marker; null without one."""
    return F.lit(None).cast("boolean") if marker is None else ~value.endswith(marker)
