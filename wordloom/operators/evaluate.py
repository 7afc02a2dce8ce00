"""Accuracy of spellers: per-word results, summaries, metrics, regressions, reports.

Results are rows (report, input, expected, position from 0, suggestions, nanos,
false_accept): ``false_accept`` says, where something was expected, that the faulty word
was accepted, and where nothing was, that the correct word was rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from time import perf_counter_ns

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.case import case_variants
from ..model import SpellerConfig
from ..session import checkpointed, spread
from .accept import check_words, is_correct_by_members
from .rank import osa
from .scan import suggestion_lists
from .suggest import _DETAILS, _NAMES, Speller, suggest_words


def nanos(time: str) -> Column:
    """Nanoseconds of a struct<secs, subsec_nanos>; null for null."""
    return F.col(f"{time}.secs") * 1_000_000_000 + F.col(f"{time}.subsec_nanos")


def latest(rows: DataFrame, key: list[str], by: str) -> DataFrame:
    """One row per key, the one with the greatest ``by``: rows sent again count once.
    Aggregates structs, so copies are dropped before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(by).isNotNull(), F.col(by))).alias("__x"))
    return best.select(*key, *[F.col("__x")[c].alias(c) for c in rest])


def classification(expected: Column, false_accept: Column) -> Column:
    """true_positive (a fault found), false_negative (a fault accepted), true_negative (a
    correct word accepted), false_positive (a correct word rejected)."""
    return F.when(expected.isNull(), F.when(false_accept, "false_positive").otherwise("true_negative")).otherwise(F.when(false_accept, "false_negative").otherwise("true_positive"))


def _fastest(results: DataFrame, by: list[str], time: str) -> DataFrame:
    """(by..., __fast): mean of the fastest 95 % of the times of each group, rounded down.

    The times of a group are counted in classes of a seven hundredth of their size, so the
    windows run over classes, of which there are some ten thousands at most.  Only the class
    in which the 95 % end is looked into, by its distinct times."""
    timed = results.where(F.col(time).isNotNull()).select(*by, F.col(time).alias("__t"), F.floor(F.log(F.greatest(F.col(time), F.lit(0)) + 1) * 700).alias("__class"))
    group = Window.partitionBy(*by)
    # both readings of the distinct times are of one shuffle
    timed = timed.groupBy(*by, "__class", "__t").agg(F.count("*").alias("__n"))
    classes = timed.groupBy(*by, "__class").agg(F.sum("__n").alias("__n"), F.sum(F.col("__n") * F.col("__t")).alias("__sum"))
    running = (
        classes.withColumn("__upto", F.sum("__n").over(group.orderBy("__class")))
        .withColumn("__below", F.sum("__sum").over(group.orderBy("__class")) - F.col("__sum"))
        .withColumn("__wanted", F.ceil(F.sum("__n").over(group) * F.lit(95) / F.lit(100)))
    )
    edge = running.where((F.col("__upto") >= F.col("__wanted")) & (F.col("__upto") - F.col("__n") < F.col("__wanted")))
    edge = edge.select(*[F.col(c).alias(f"__g_{c}") for c in by], F.col("__class").alias("__edge"), "__below", "__wanted", (F.col("__wanted") - F.col("__upto") + F.col("__n")).alias("__need"))
    same = F.col("__class") == F.col("__edge")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    values = timed.join(edge, same)
    before = F.sum("__n").over(group.orderBy("__t")) - F.col("__n")
    taken = values.withColumn("__take", F.greatest(F.lit(0), F.least(F.col("__n"), F.col("__need") - before)))
    return taken.groupBy(*by).agg(F.floor((F.first("__below") + F.sum(F.col("__take") * F.col("__t"))) / F.first("__wanted")).cast("bigint").alias("__fast"))


def summarize(results: DataFrame, by: list[str], *, n_suggestions: str = "n_suggestions", time: str = "nanos", small_groups: bool = False) -> DataFrame:
    """One row per group: counts by outcome and position, lookup times, and means over
    the corrected words.  A group may hold a third of all rows: everything is aggregated
    before it is shuffled, the mean of the fastest 95 % by classes of times.  Null times
    are left out; a group without times has null times.  ``small_groups``: groups are of
    bounded size (single runs), so their times are ranked in one window, with the same result."""
    expected, position, fa = F.col("expected"), F.col("position"), F.col("false_accept")
    tp = expected.isNotNull() & ~fa

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    found = position.isNotNull()
    fastest = []
    if small_groups:
        group = Window.partitionBy(*by)
        wanted = F.ceil(F.count(time).over(group) * F.lit(95) / F.lit(100))
        results = results.withColumn("__fast", (F.row_number().over(group.orderBy(F.col(time).asc_nulls_last())) <= wanted) & F.col(time).isNotNull())
        chosen = F.when(F.col("__fast"), F.col(time))
        fastest = [F.floor(F.sum(chosen) / F.count(chosen)).cast("bigint").alias("average_time_95pc")]
    counts = results.groupBy(*by).agg(
        F.count("*").alias("total_words"),
        count(tp & (position == 0)).alias("first_position"),
        count(tp & (position < 5)).alias("top_five"),
        count(tp & found).alias("any_position"),
        count(tp & ~found & (F.col(n_suggestions) == 0)).alias("no_suggestions"),
        count(tp & ~found & (F.col(n_suggestions) > 0)).alias("only_wrong"),
        count(expected.isNull() & fa).alias("false_accept"),
        count(tp).alias("true_positive"),
        count(expected.isNotNull() & fa).alias("false_negative"),
        count(expected.isNull() & ~fa).alias("true_negative"),
        F.max(time).alias("slowest_lookup"),
        F.min(time).alias("fastest_lookup"),
        F.floor(F.sum(time) / F.count(time)).cast("bigint").alias("average_time"),
        *fastest,
        F.avg(F.when(found, position + 1)).alias("average_position_of_correct"),
        F.avg(F.when(found, F.col(n_suggestions))).alias("average_suggestions_for_correct"),
    )
    if small_groups:
        return counts
    fast = _fastest(results, by, time).select(*[F.col(c).alias(f"__g_{c}") for c in by], F.col("__fast").alias("average_time_95pc"))
    same = F.lit(True)
    for c in by:
        same = same & counts[c].eqNullSafe(F.col(f"__g_{c}"))
    order = [c for c in counts.columns if not c.startswith("average_position") and not c.startswith("average_suggestions")]
    return counts.join(fast, same, "left").select(*order, "average_time_95pc", "average_position_of_correct", "average_suggestions_for_correct")


def _harmonic(precision: Column, recall: Column) -> Column:
    """F of two shares; 0 if both are, null if one is null."""
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)))


def classifier_metrics(summary: DataFrame) -> DataFrame:
    """precision, recall, accuracy and F of finding faults; null where undefined."""
    tp, fp, tn, fn = (F.col(c) for c in ("true_positive", "false_accept", "true_negative", "false_negative"))
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return summary.select("*", precision.alias("precision"), recall.alias("recall"), F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"), _harmonic(precision, recall).alias("f_score"))


def suggestion_metrics(results: DataFrame, by: list[str], *, n_suggestions: str = "n_suggestions") -> DataFrame:
    """How good the suggestions are, over the faults found; shares of nothing are 0."""
    tp = results.where(F.col("expected").isNotNull() & ~F.col("false_accept"))
    hit, some = F.col("position").isNotNull(), F.col(n_suggestions) > 0
    out = tp.groupBy(*by).agg(
        F.count("*").alias("faults"),
        F.count(F.when(F.col("position") == 0, 1)).alias("first"),
        F.count(F.when(F.col("position") < 5, 1)).alias("top_five"),
        F.count(F.when(hit, 1)).alias("any"),
        F.count(F.when(~hit & ~some, 1)).alias("none"),
        F.count(F.when(~hit & some, 1)).alias("only_wrong"),
        F.count(F.when(some, 1)).alias("with_suggestions"),
        F.sum(n_suggestions).alias("suggestions"),
    )
    precision, recall, accuracy = (F.coalesce(F.try_divide("any", of), F.lit(0.0)) for of in ("with_suggestions", "faults", "suggestions"))
    return out.select("*", precision.alias("precision"), recall.alias("recall"), accuracy.alias("accuracy"), _harmonic(precision, recall).alias("f_score"))


def throughput(results: DataFrame, by: list[str], *, time: str = "nanos", wall: Column | None = None) -> DataFrame:
    """Words a second: by the sum of lookup times, and by wall time if given (nanoseconds)."""
    out = results.groupBy(*by).agg(F.count("*").alias("words"), F.sum(time).alias("cpu_nanos"))
    out = out.withColumn("words_per_cpu_second", F.try_divide(F.col("words") * 1e9, F.col("cpu_nanos")))
    return out if wall is None else out.withColumn("words_per_second", F.try_divide(F.col("words") * 1e9, wall))


def regression_rate(old: DataFrame, new: DataFrame, key: list[str], *, threshold: float) -> DataFrame:
    """One row: pairs, how many changed their position (for better or worse; not found is
    a position too), the rate, and whether it is below the threshold.  No pairs fail."""
    both = old.select(*key, F.col("position").alias("__old")).join(new.select(*key, F.col("position").alias("__new")), key)
    out = both.agg(F.count("*").alias("pairs"), F.count(F.when(~F.col("__old").eqNullSafe(F.col("__new")), 1)).alias("changed"))
    return out.withColumn("rate", F.try_divide("changed", "pairs")).withColumn("passed", F.coalesce(F.col("rate") < threshold, F.lit(False)))


def passes_threshold(summary: DataFrame, threshold: float) -> DataFrame:
    """Adds ``passed``: the share of words corrected among the first five, in per cent, is above the threshold."""
    return summary.withColumn("passed", F.coalesce(F.try_divide(F.col("top_five") * 100.0, F.col("total_words")) > threshold, F.lit(False)))


#: Classes from best to worst.
_CLASS_ORDER = ("true_positive", "true_negative", "false_positive", "false_negative")


def report_order(mode: str, ascending: bool = True, *, n_suggestions: str = "n_suggestions", time: str = "nanos") -> Column:
    """Sort column of a report: by time (ascending: the slowest first), position (the best
    first; then only wrong suggestions, then none at all), distance (the least first) or
    classification (hits, correct words accepted, correct words rejected, misses)."""
    kind = F.array_position(F.array(*[F.lit(c) for c in _CLASS_ORDER]), classification(F.col("expected"), F.col("false_accept")))
    place = F.coalesce("position", F.when(F.col(n_suggestions) > 0, F.lit(2**62)).otherwise(F.lit(2**62 + 1)))
    column = {"time": -F.col(time), "position": place, "distance": F.col("distance"), "classification": kind}[mode]
    return column.asc_nulls_last() if ascending else column.desc_nulls_last()


def sort_report(results: DataFrame, mode: str, ascending: bool = True, *, ties: str = "input") -> DataFrame:
    """Results in the order of :func:`report_order`, equal ones by ``ties``."""
    return results.orderBy(report_order(mode, ascending), ties)


def place_in_report(results: DataFrame, mode: str, ascending: bool = True, *, by: list[str], ties: str = "result_id") -> DataFrame:
    """Adds ``place``, from 1, of each result in its report (``by``) under that order.  A
    report is one run of bounded size, whatever the corpus."""
    return results.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(report_order(mode, ascending), ties)))


def without_hidden(suggestions: DataFrame, analyses: DataFrame, *, value: str = "value", analysis: str = "analysis", hidden: str = "+Spell/NoSugg") -> DataFrame:
    """Suggestions with at least one analysis that lacks the tag; those without any
    analysis go too."""
    open_ = analyses.where(~F.col(analysis).contains(hidden)).select(F.col(value).alias("__value")).distinct()
    return suggestions.join(open_, F.col(value) == F.col("__value"), "left_semi")


def evaluate(corpus: DataFrame, speller: Speller, config: SpellerConfig = SpellerConfig(), *, timed: bool = False) -> DataFrame:
    """Checks a corpus (input, expected or null): accepted or not, suggestions of rejected
    words, position of the expected one, edit distance.  Distinct words are looked up once.
    A null input is checked as an empty word.  With ``timed``, every word is looked up alone
    and ``nanos`` is how long its check and its suggestions took."""
    rows = corpus.withColumn("input", F.coalesce("input", F.lit("")))
    if timed:
        lookups = _timed_lookups(rows, speller, config)
        found = lookups.select("input", F.explode("s").alias("s")).select("input", "s.*")
        return _outcomes(rows, lookups.select("input", "is_correct"), found, ["input"]).join(lookups.select("input", "nanos"), "input", "left")
    checked = check_words(rows, speller.lexicon, column="input", config=config)
    wrong = checked.where("not is_correct")
    found = suggest_words(wrong, speller, column="input", config=config)
    return _outcomes(rows, checked, found, ["input"])


_SUGGESTED = "array<struct<rank:int,value:string,weight:float,completed:boolean,weight_details:struct<lexicon_weight:float,mutator_weight:float,reweight_start:float,reweight_mid:float,reweight_end:float>>>"


def _timed_lookups(rows: DataFrame, speller: Speller, config: SpellerConfig) -> DataFrame:
    """(input, is_correct, s, nanos) of the distinct inputs.  Written to the checkpoint
    folder, as a time is not the same when it is taken again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word in batch.column(0).to_pylist():
                began = perf_counter_ns()
                correct = speller.is_correct(word, config)
                given = [] if correct else speller.suggest(word, config)
                took = perf_counter_ns() - began
                out.append((correct, [{"rank": i, "value": s.value, "weight": s.weight, "completed": s.completed, "weight_details": dict(zip(_NAMES, s.details)) if s.details else None} for i, s in enumerate(given, 1)], took))
            item = pa.struct([("rank", pa.int32()), ("value", pa.string()), ("weight", pa.float32()), ("completed", pa.bool_()), ("weight_details", _DETAILS)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in out], pa.bool_()), pa.array([r[1] for r in out], pa.list_(item)), pa.array([r[2] for r in out], pa.int64())], names=["input", "is_correct", "s", "nanos"])

    todo = spread(rows.select(F.col("input").cast("string")).distinct())
    return checkpointed(todo.mapInArrow(run, f"input string, is_correct boolean, s {_SUGGESTED}, nanos bigint"))


def evaluate_from_list(corpus: DataFrame, entries: DataFrame, *, group: str, config: SpellerConfig = SpellerConfig()) -> DataFrame:
    """The same per group, with the entries (group, word, weight) as its lexicon and single
    edits as its error model; the lexicon may be of any size."""
    rows = corpus.withColumn("input", F.coalesce("input", F.lit("")))
    variants = case_variants(F.col("word")) if config.recase else F.array().cast("array<string>")
    words = rows.select(group, F.col("input").alias("word"))
    checked = is_correct_by_members(words, entries, variants, group=group).withColumnRenamed("word", "input")
    listed = suggestion_lists(checked.where("not is_correct"), entries, group=group, column="input", config=config)
    return _judged(rows, checked, listed.withColumnRenamed("suggestions", "__s"), [group, "input"])


def _outcomes(rows: DataFrame, checked: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    listed = found.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank", "value", "weight", "completed", "weight_details"))).alias("__s"))
    return _judged(rows, checked, listed, key)


def _judged(rows: DataFrame, checked: DataFrame, listed: DataFrame, key: list[str]) -> DataFrame:
    """Outcomes from the lists ``__s`` of suggestions by key."""
    out = rows.join(checked, key, "left").join(listed, key, "left")
    suggestions = F.when(F.col("is_correct") | F.col("__s").isNull(), F.array().cast(_SUGGESTED)).otherwise(F.col("__s"))
    place = F.array_position(F.transform(suggestions, lambda s: s["value"]), F.col("expected"))
    return out.select(
        *rows.columns,
        F.coalesce(osa(F.col("input"), F.col("expected")), F.lit(0)).alias("distance"),
        suggestions.alias("suggestions"),
        F.when(F.col("expected").isNotNull() & (place > 0), place - 1).alias("position"),
        F.when(F.col("expected").isNull(), ~F.col("is_correct")).otherwise(F.col("is_correct")).alias("false_accept"),
        F.size(suggestions).alias("n_suggestions"),
    )
