"""Percentiles of numeric columns from mergeable sketches with a stated error.

The sketch is KLL: a hierarchy of compactors, each of which sorts its buffer and
hands every second value (odd or even by a fair coin) to the next level with twice
the weight; hierarchies merge level by level.  Spark ships the Apache DataSketches
implementation as aggregate functions, which run in the JVM with partial aggregation
before the shuffle, so a hot group costs one sketch a task, not its rows.

Sketches are kept per group and day; any set of days is merged later from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_error(k: int) -> float:
    """Normalised rank error of one percentile, held with 99 % probability, for sketches
    of size ``k``; merging does not widen it (published fit of the KLL sketch)."""
    return 2.296 / k**0.9021


def day_sketches(values: DataFrame, groups: list[str], value: str, *, k: int = 800) -> DataFrame:
    """(groups..., n, least, greatest, sketch) over the non-null values; a group with
    only nulls has no row; null groups are groups.  ``value`` must be an integer column."""
    if clash := {"n", "least", "greatest", "sketch"} & set(groups):
        raise ValueError(f"{', '.join(sorted(clash))}: names of output columns")
    return (
        values.where(F.col(value).isNotNull())
        .groupBy(*groups)
        .agg(F.count("*").alias("n"), F.min(value).cast("bigint").alias("least"), F.max(value).cast("bigint").alias("greatest"), F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), F.lit(k)).alias("sketch"))
    )


def merge_sketches(sketches: DataFrame, groups: list[str], *, k: int = 800) -> DataFrame:
    """Sketches of coarser groups, from those of finer ones."""
    return sketches.groupBy(*groups).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"))


def percentiles(sketches: DataFrame, points: dict[str, float], *, k: int = 800) -> DataFrame:
    """Replaces the sketch by one column per point, and ``rank_error``."""

    def at(p: float) -> Column:
        return F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(p)))

    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *[at(p).alias(name) for name, p in points.items()], F.lit(rank_error(k)).alias("rank_error"))
