"""Queries of the training-data operators, and the SQL that some can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alphabets import speller_alphabets


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _with_locale(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """Adds locale and alphabet of the speller; the lookup table has a row per archive,
    and Spark broadcasts it only below its own size threshold."""
    return rows.join(speller_alphabets(_read(spark, sf, "spellers"), _read(spark, sf, "symbols")), "speller_id", "left")


def _fields(results: DataFrame, *columns: str) -> DataFrame:
    """input and expected as rows (field, text)."""
    return results.select(*columns, F.expr("stack(2, 'input', input, 'expected', expected) as (field, text)")).where("text is not null and text <> ''")


def _results_values(spark: SparkSession, sf: str) -> DataFrame:
    """All stored values of results and suggestions as rows (field, result_id, rank, report_id, speller_id, text)."""
    results = _read(spark, sf, "accuracy_results")
    suggestions = _read(spark, sf, "suggestions")
    fields = _fields(results, "result_id", "report_id", "speller_id").withColumn("rank", F.lit(0))
    values = suggestions.select("result_id", "report_id", "speller_id", F.lit("value").alias("field"), F.col("value").alias("text"), "rank").where("text is not null and text <> ''")
    return fields.unionByName(values)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """(result_id, field) of every result whose stored input or expected is garbled."""
    from .encoding import find_garbled

    fields = _with_locale(spark, sf, _fields(_read(spark, sf, "accuracy_results"), "result_id", "speller_id"))
    return find_garbled(fields, keep=["result_id", "field"]).select("result_id", "field").distinct()


def p1_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Garbled values with what was restored, and the encoding pairs."""
    from .encoding import find_garbled

    fields = _with_locale(spark, sf, _fields(_read(spark, sf, "accuracy_results"), "result_id", "speller_id"))
    found = find_garbled(fields, keep=["result_id", "field", "text"])
    return found.select("result_id", "field", F.col("text").alias("stored"), "restored", F.array_join("pairs", "; ").alias("pairs"), "lost").distinct()


def _terms(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    from .terms import mark_terms, term_frequencies

    rows = _results_values(spark, sf).where("field in ('input', 'value')")
    total = _read(spark, sf, "reports").agg(F.count_distinct("report_id")).first()[0]
    return mark_terms(term_frequencies(rows, term="text", record="report_id", keys=["result_id", "rank"]), total), total


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """(field, term, mark) of the terms too rare or too common."""
    return _terms(spark, sf)[0].where("mark is not null").select("field", "term", "mark")


def p2_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences and reports of every distinct term."""
    return _terms(spark, sf)[0].select("field", "term", "occurrences", "records", "mark")


def _disguised(spark: SparkSession, sf: str, keep: list[str]) -> DataFrame:
    from .lookalike import disguised_values, fit_lookalikes

    alphabets = speller_alphabets(_read(spark, sf, "spellers"), _read(spark, sf, "symbols"))
    values = _with_locale(spark, sf, _results_values(spark, sf))
    return disguised_values(values, fit_lookalikes(values, alphabets), keep=keep)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """(field, result_id, rank) of the values that look ordinary but are stored otherwise."""
    return _disguised(spark, sf, ["field", "result_id", "rank"]).select("field", "result_id", "rank").distinct()


def p3_normal(spark: SparkSession, sf: str) -> DataFrame:
    """The disguised values with their ordinary form."""
    found = _disguised(spark, sf, ["field", "result_id", "rank", "text"])
    return found.select("field", "result_id", "rank", F.col("text").alias("stored"), "normal").distinct()


#: Percentiles reported by p4.
POINTS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def _nanos(time: str) -> F.Column:
    return F.col(f"{time}.secs") * 1_000_000_000 + F.col(f"{time}.subsec_nanos")


def _lookups(spark: SparkSession, sf: str) -> DataFrame:
    """(metric, speller_id, day, nanos): lookup times of the results, and the runs' own
    averages; day is that of the run.  Of a run that came twice the one received last
    counts, of a result sent again the one logged last."""

    def last(rows: DataFrame, key: str, by: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in (key, by)]
        return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(by).isNotNull(), F.col(by), F.struct(*rest))).alias("x")).select(key, "x.*")

    reports = last(_read(spark, sf, "reports").select("report_id", "received_at", "speller_id", F.to_date("start_timestamp").alias("day"), _nanos("summary.average_time_95pc").alias("nanos")), "report_id", "received_at")
    # the first step spreads by result, not by run
    results = last(_read(spark, sf, "accuracy_results").select("result_id", "logged_at", "report_id", "speller_id", _nanos("time").alias("nanos")), "result_id", "logged_at")
    lookups = results.join(reports.select("report_id", "day"), "report_id", "left").select(F.lit("time").alias("metric"), "speller_id", "day", "nanos")
    return lookups.unionByName(reports.select(F.lit("average_time_95pc").alias("metric"), "speller_id", "day", "nanos"))


def p4_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of lookup times per speller and day (period 'day'), and per speller over
    all days ('all', day null), the latter merged from the days' sketches.  A run without a
    date has a day of its own, null.  Times in nanoseconds."""
    from .quantiles import day_sketches, merge_sketches, percentiles

    days = day_sketches(_lookups(spark, sf), ["metric", "speller_id", "day"], "nanos").withColumn("period", F.lit("day"))
    merged = merge_sketches(days, ["metric", "speller_id"]).withColumn("day", F.lit(None).cast("date")).withColumn("period", F.lit("all"))
    return percentiles(days.unionByName(merged), POINTS)


def p4_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Every percentile over all days of a speller against the exact ranks of all values:
    (metric, speller_id, point, n, within), whether the rank error is within its bound."""
    from .quantiles import day_sketches, merge_sketches, percentiles

    values = _lookups(spark, sf).where("nanos is not null")
    found = percentiles(merge_sketches(day_sketches(values, ["metric", "speller_id", "day"], "nanos"), ["metric", "speller_id"]), POINTS)
    points = found.select("metric", "speller_id", "rank_error", F.expr(f"stack({len(POINTS)}, {', '.join(f"'{n}', {p}D, {n}" for n, p in POINTS.items())}) as (point, p, value)"))
    counted = values.join(points, ["metric", "speller_id"]).groupBy("metric", "speller_id", "point").agg(F.count("*").alias("n"), F.first("p").alias("p"), F.first("rank_error").alias("e"), F.count(F.when(F.col("nanos") < F.col("value"), 1)).alias("below"), F.count(F.when(F.col("nanos") <= F.col("value"), 1)).alias("upto"))
    return counted.select("metric", "speller_id", "point", "n", ((F.col("below") / F.col("n") <= F.col("p") + F.col("e")) & (F.col("upto") / F.col("n") >= F.col("p") - F.col("e"))).alias("within"))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Which documents share a container, and how full it is."""
    from .packing import fill_containers
    from .tokens import with_tokens

    sized = with_tokens(_read(spark, sf, "documents"), keep=["doc_id"])
    return fill_containers(sized, _read(spark, sf, "containers"))


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from ..session import checkpointed
    from .language import language_code
    from .mixing import mix, source_name
    from .tokens import with_tokens

    docs = _read(spark, sf, "documents").select("doc_id", source_name(F.col("source")).alias("source"), language_code(F.col("lang")).alias("lang"), F.nullif(F.upper(F.substring(F.trim("ipc"), 1, 1)), F.lit("")).alias("topic"), "text")
    targets = _read(spark, sf, "mix_targets").withColumn("source", source_name(F.col("source")))
    return mix(checkpointed(with_tokens(docs)), targets)


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mixture, and how often each is used."""
    return _mix(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source, and which have too little to reach theirs."""
    return _mix(spark, sf)[1]


def _labelled(spark: SparkSession, sf: str, overall: bool = False) -> DataFrame:
    from .language import fit_languages, label_spans, refit_with_documents

    samples, documents = _read(spark, sf, "lang_samples"), _read(spark, sf, "documents")
    model = refit_with_documents(fit_languages(samples), samples, documents)
    return label_spans(documents, model, keep=["doc_id", "lang"], overall=overall)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, lang): languages with a whole sentence in the text that its label does not name."""
    from .language import missing_languages

    return missing_languages(_labelled(spark, sf))


def p8_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Main language of each document with a confidence, and its stretches."""
    from .language import document_language

    labelled = document_language(_labelled(spark, sf, overall=True))
    return labelled.select("doc_id", F.col("lang").alias("label"), "main_lang", "main_confidence", F.to_json("spans").alias("spans"))


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_frequencies, p3_found, p3_normal, p4_percentiles, p4_errors, p6_containers, p7_mixture, p7_shares, p8_found, p8_languages)}

_TERMS_SQL = """
with rows as (
    select distinct 'input' as field, input as term, report_id, result_id, 0 as rank from accuracy_results where input <> ''
    union
    select distinct 'value', value, report_id, result_id, rank from suggestions where value <> ''
), counts as (
    select field, term, count(*) as occurrences, count(distinct report_id) as records from rows group by field, term
), marked as (
    select *, case when records = 1 then 'rare' when records > 0.1 * (select count(distinct report_id) from reports) then 'common' end as mark from counts
)
"""

_ERRORS_SQL = """
with r as (select report_id, arg_max(speller_id, received_at) as speller_id, arg_max(struct_pack(t := summary.average_time_95pc), received_at).t as t from reports group by report_id),
a as (select result_id, any_value(speller_id) as speller_id, arg_max(struct_pack(t := time), logged_at).t as t from accuracy_results group by result_id),
v as (select 'time' as metric, speller_id from a where t is not null union all select 'average_time_95pc', speller_id from r where t is not null),
p(point) as (values ('p50'), ('p90'), ('p95'), ('p99'))
select metric, speller_id, point, count(*) as n, true as within from v, p group by all
"""

ORACLES = {
    "p4_errors": _ERRORS_SQL,
    "p2_found": _TERMS_SQL + "select field, term, mark from marked where mark is not null",
    "p2_frequencies": _TERMS_SQL + "select field, term, occurrences, records, mark from marked",
}
