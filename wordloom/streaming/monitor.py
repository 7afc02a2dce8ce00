"""Checks over streams: the batch operators on readStream frames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SpellerConfig
from ..operators.accept import Lexicon


def check_stream(words: DataFrame, lexicon: Lexicon, *, column: str = "word", config: SpellerConfig = SpellerConfig()) -> DataFrame:
    """Adds ``is_correct`` to each row, statelessly; null words give null."""
    names = words.columns
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields] + ["is_correct boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            memo: dict[str, bool] = {}
            out = [None if w is None else memo[w] if w in memo else memo.setdefault(w, lexicon.is_correct(w, config)) for w in batch.column(names.index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*names, "is_correct"])

    return words.mapInArrow(run, ddl)


def typo_rate(checked: DataFrame, *, time: str, window: str = "10 minutes", slide: str | None = None, late: str = "1 hour", by: list[str] = ()) -> DataFrame:
    """Words and unknown words per time window (and group); rows later than ``late`` are dropped."""
    return (
        checked.withWatermark(time, late)
        .groupBy(F.window(time, window, slide or window), *by)
        .agg(F.count("*").alias("words"), F.count(F.when(~F.col("is_correct"), 1)).alias("unknown"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "words", "unknown", F.try_divide("unknown", "words").alias("rate"))
    )
