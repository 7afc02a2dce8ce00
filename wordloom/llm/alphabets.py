"""The letters of each speller's locale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def speller_alphabets(spellers: DataFrame, symbols: DataFrame) -> DataFrame:
    """(speller_id, locale, alphabet): the distinct code points of the ``char`` and
    ``multichar`` symbols of the locale, sorted, as one string; analysis tags (``+...``)
    and special symbols (``@...``) are left out.  A locale without symbols has ''.

    Both inputs have a row per archive and per symbol, whatever the size of the corpus.
    """
    letters = (
        symbols.where(F.col("kind").isin("char", "multichar") & ~F.col("key").rlike("^[+@]."))
        .select("locale", F.explode(F.split("key", "")).alias("c"))
        .where("c <> ''")
        .groupBy("locale")
        .agg(F.array_join(F.array_sort(F.collect_set("c")), "").alias("alphabet"))
    )
    per = spellers.select("speller_id", "locale").dropDuplicates(["speller_id"])
    return per.join(letters, "locale", "left").select("speller_id", "locale", F.coalesce("alphabet", F.lit("")).alias("alphabet"))
