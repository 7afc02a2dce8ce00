"""Readers of typo lists and word lists, writers of results and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_typos(spark: SparkSession, path: str, max_words: int | None = None) -> DataFrame:
    """(input, expected) of a tab-separated list: ``#`` lines are comments, rows may be
    ragged; the expected form is trimmed, and null if missing or empty.  A cell may be
    quoted, with quotation marks doubled in it.  ``max_words``: the first so many in the
    order of the lines (of several files: in the order of their names)."""
    rows = _pairs(spark, path).withColumn("expected", F.nullif(F.trim("expected"), F.lit("")))
    if max_words is not None:
        rows = rows.orderBy("file", "line").limit(max_words)
    return rows.select("input", "expected")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(input, expected) as written; rows without a second column are dropped."""
    return _pairs(spark, path).where("expected is not null").select("input", "expected")


def _pairs(spark: SparkSession, path: str) -> DataFrame:
    cells = F.split("value", "\t")

    def plain(cell):
        return F.when(cell.rlike('^".*"$') & (F.length(cell) > 1), F.replace(F.substr(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))).otherwise(cell)

    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    return lines.where("value <> '' and not startswith(value, '#')").select(plain(cells[0]).alias("input"), plain(F.try_element_at(cells, F.lit(2))).alias("expected"), "file", "line")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a list with one word a line, trimmed; empty lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


def suggestion_lines(results: DataFrame, *, verbose: bool = False) -> DataFrame:
    """Text output (line) of words with ranked suggestions: (word, is_correct, suggestions
    array<struct<value, weight, weight_details>>).  A middle penalty of -1 prints as ``-``."""
    head = F.concat(F.lit("Input: "), F.col("word"), F.lit("\t\t["), F.when(F.col("is_correct"), "CORRECT").otherwise("INCORRECT"), F.lit("]"))

    def line(s):
        base = F.format_string("%s\t\t%.5f", s["value"], s["weight"].cast("double"))
        if not verbose:
            return base
        d = s["weight_details"]
        mid = F.when(d["reweight_mid"] == -1, "-").otherwise(F.format_string("%.5f", d["reweight_mid"].cast("double")))
        return F.when(d.isNull(), base).otherwise(F.concat(base, F.format_string(" (lex: %.5f, mut: %.5f, rew: %.5f/", d["lexicon_weight"].cast("double"), d["mutator_weight"].cast("double"), d["reweight_start"].cast("double")), mid, F.format_string("/%.5f)", d["reweight_end"].cast("double"))))

    return results.select(F.concat_ws("\n", head, F.array_join(F.transform("suggestions", line), "\n")).alias("line"))


def analysis_lines(suggestions: DataFrame, analyses: DataFrame) -> DataFrame:
    """suggestion, analysis, lexicon weight, total: tab-separated (line) per suggestion and
    analysis; the total adds the error model's share and the penalties."""
    total = F.col("a_weight") + F.col("mutator_weight") + F.col("reweight_start") + F.greatest(F.col("reweight_mid"), F.lit(0.0)) + F.col("reweight_end")
    joined = suggestions.join(analyses.select(F.col("word").alias("value"), "analysis", F.col("weight").alias("a_weight")), "value")
    return joined.select(F.format_string("%s\t%s\t%.5f\t%.5f", "value", "analysis", F.col("a_weight").cast("double"), total.cast("double")).alias("line"))


def to_json_lines(results: DataFrame) -> DataFrame:
    """One JSON object a row (value), null fields left out."""
    return results.select(F.to_json(F.struct(*results.columns), {"ignoreNullFields": "true"}).alias("value"))


def report_json(results: DataFrame, summary: DataFrame, by: str, *, config: str = "{}", metadata: str | None = None, times: DataFrame | None = None) -> DataFrame:
    """(by, value): the JSON report of each run.  ``config`` and ``metadata`` are JSON texts
    and become objects; ``times`` has start_timestamp and total_time by run.  A report holds
    its results, so its size is that of the run, never of the corpus."""
    fields = [c for c in results.columns if c != by]
    listed = results.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("results"))
    totals = summary.select(by, F.struct(*[c for c in summary.columns if c != by]).alias("summary"))
    joined = listed.join(totals, by)
    parts = [F.parse_json(F.lit(metadata)).alias("metadata"), F.parse_json(F.lit(config)).alias("config"), "summary", "results"]
    if times is not None:
        joined = joined.join(times.select(by, "start_timestamp", "total_time"), by, "left")
        parts += ["start_timestamp", "total_time"]
    return joined.select(by, F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("value"))


def suggestion_json(suggestions: DataFrame, analyses: DataFrame) -> DataFrame:
    """(value): one JSON document per word of (word, rank, value, weight): its suggestions in
    order, each with its analyses (word, analysis, weight) under ``combinedAnalysis``."""
    of = analyses.groupBy(F.col("word").alias("value")).agg(F.sort_array(F.collect_list(F.struct("weight", "analysis"))).alias("combinedAnalysis"))
    each = suggestions.join(of, "value", "left")
    listed = each.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("rank", "value", F.col("weight"), "combinedAnalysis"))).alias("s"))
    return listed.select(F.to_json(F.struct("word", F.transform("s", lambda x: F.struct(x["value"].alias("value"), x["weight"].alias("weight"), x["combinedAnalysis"].alias("combinedAnalysis"))).alias("suggestions"))).alias("value"))


def per_cent(share: F.Column) -> F.Column:
    """A share as a percentage with two places; null stays null."""
    return F.when(share.isNotNull(), F.format_string("%.2f", share.cast("double") * 100))


def human_time(nanos: F.Column) -> F.Column:
    """Minutes and seconds with three places."""
    seconds = nanos.cast("double") / 1e9
    minutes = F.floor(seconds / 60)
    return F.when(nanos.isNull(), F.lit(None)).when(seconds > 60, F.concat(minutes.cast("string"), F.lit(":"), F.format_string("%.3f", seconds - minutes * 60))).otherwise(F.format_string("00:%.3f", seconds))


#: Columns of the history, in order.
HISTORY = ("id", "date", "tag/branch", "top1", "top5", "worse", "no suggs", "wrong suggs")


def history_lines(summary: DataFrame, *, git_id: str = "", date: str = "", describe: str = "") -> DataFrame:
    """Summaries as lines of a history, with what tells the revision."""
    counts = [F.col(c).cast("string") for c in ("first_position", "top_five", "any_position", "no_suggestions", "only_wrong")]
    return summary.select(*[F.coalesce(c, F.lit("")).alias(n) for n, c in zip(HISTORY, (F.lit(git_id), F.lit(date), F.lit(describe), *counts))])


def append_history(lines: DataFrame, path: str) -> None:
    """Appends lines to a tab-separated history (a folder); its head line is written once,
    with the first."""
    spark = lines.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = not files.exists(where) or not any(f.getPath().getName().startswith("part-") for f in files.listStatus(where))
    # a history has a line a run
    lines.coalesce(1).write.mode("append").option("sep", "\t").option("header", fresh).csv(path)
