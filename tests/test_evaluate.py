import random

import pytest
from pyspark.sql import functions as F

from tests import automata
from wordloom.model import SpellerConfig
from wordloom.operators import accept, evaluate, rank, suggest
from wordloom.operators.suggest import Speller

RAW = SpellerConfig(reweight=None, recase=False)


@pytest.fixture(scope="module")
def speller():
    return Speller(automata.lexicon(), automata.mutator())


def test_corpus(spark, speller):
    rows = [("kat", "cat"), ("cat", "cat"), ("cat", None), ("ked", None), ("xyz", "dog"), (None, "cat"), ("kat", "cat"), ("", None)]
    df = spark.createDataFrame(rows, "input string, expected string")
    got = {(r["input"], r["expected"]): r for r in evaluate.evaluate(df, speller, RAW).collect()}
    hit = got["kat", "cat"]
    assert hit["position"] == 0 and not hit["false_accept"] and hit["distance"] == 1 and hit["n_suggestions"] > 0
    assert got["cat", "cat"]["false_accept"] and got["cat", "cat"]["suggestions"] == []
    assert not got["cat", None]["false_accept"] and got["ked", None]["false_accept"] and got["ked", None]["position"] is None
    assert got["xyz", "dog"]["position"] is None and got["", "cat"]["false_accept"]
    assert evaluate.evaluate(df, speller, RAW).count() == len(rows)
    s = evaluate.summarize(evaluate.evaluate(df, speller, RAW).withColumn("g", F.lit(1)).withColumn("nanos", F.lit(5)), ["g"]).first()
    assert (s["total_words"], s["true_positive"], s["false_negative"], s["true_negative"], s["false_accept"], s["first_position"], s["only_wrong"]) == (8, 3, 2, 2, 1, 2, 1)
    assert evaluate.summarize(df.limit(0).selectExpr("1 as g", "input", "expected", "1 as position", "false as false_accept", "1 as n_suggestions", "1 as nanos"), ["g"]).count() == 0


def test_summary_of_times(spark):
    rows = [("r", "x", None, False, 0, i * 10) for i in range(1, 41)] + [("q", "x", None, False, 0, None)]
    df = spark.createDataFrame(rows, "g string, expected string, position bigint, false_accept boolean, n_suggestions bigint, nanos bigint")
    got = {r["g"]: r for r in evaluate.summarize(df, ["g"]).collect()}
    assert got["r"]["slowest_lookup"] == 400 and got["r"]["average_time"] == 205 and got["r"]["average_time_95pc"] == sum(range(10, 390, 10)) // 38
    assert got["q"]["average_time"] is None and got["q"]["no_suggestions"] == 1


def test_metrics_and_gates(spark):
    s = spark.createDataFrame([(8, 2, 5, 1, 16, 4), (0, 0, 0, 0, 0, 0)], "true_positive bigint, false_accept bigint, true_negative bigint, false_negative bigint, total_words bigint, top_five bigint")
    a, b = evaluate.classifier_metrics(s).collect()
    assert a["precision"] == 0.8 and a["recall"] == pytest.approx(8 / 9) and a["accuracy"] == 13 / 16 and b["precision"] is None and b["f_score"] is None
    assert [r["passed"] for r in evaluate.passes_threshold(s, 24.0).collect()] == [True, False]
    old = spark.createDataFrame([("a", 0), ("b", 1), ("c", None), ("d", 2)], "input string, position bigint")
    new = spark.createDataFrame([("a", 0), ("b", 0), ("c", None), ("d", None)], "input string, position bigint")
    r = evaluate.regression_rate(old, new, ["input"], threshold=0.6).first()
    assert (r["pairs"], r["changed"], r["rate"], r["passed"]) == (4, 2, 0.5, True)
    assert not evaluate.regression_rate(old.limit(0), new, ["input"], threshold=0.6).first()["passed"]


def test_frames_agree_with_the_search(spark, speller):
    words = ["kat", "cet", "Kat", "KAT", "", "xyz", "cart"]
    df = spark.createDataFrame([(w,) for w in [*words, "kat", None]], "word string")
    got = {}
    for r in suggest.suggest_words(df, speller, config=SpellerConfig(verbose=True)).collect():
        got.setdefault(r["word"], []).append((r["rank"], r["value"], r["weight"], tuple(r["weight_details"])))
    for w in words:
        want = [(i, s.value, s.weight, s.details) for i, s in enumerate(speller.suggest(w, SpellerConfig(verbose=True)), 1)]
        assert sorted(got.get(w, [])) == want
    checked = {r["word"]: r["is_correct"] for r in accept.check_words(df, speller.lexicon).collect()}
    assert checked == {w: speller.is_correct(w) for w in words}
    assert suggest.suggest_words(df.limit(0), speller).count() == 0


def test_relational_walk_and_neighbours(spark, speller):
    entries = spark.createDataFrame([("x", w, float(i)) for i, w in enumerate(["cat", "car", "cart", "care", "cär", "", "a̱b"])], "g string, word string, weight double")
    words = spark.createDataFrame([("x", w) for w in ["cat", "kat", "ca", "carts", "", "cär", "a̱b", None, "cat"]] + [("y", "cat")], "g string, word string")
    arcs = accept.lexicon_arcs(entries, group="g")
    got = {tuple(r) for r in accept.accept_by_arcs(words, arcs, entries.select("g", F.col("word").alias("state")), group="g").collect()}
    assert got == {("x", "cat"), ("x", "cär"), ("x", "a̱b"), ("x", "")}
    near = {(r["word"], r["value"], r["weight"]) for r in suggest.edit_neighbours(words, entries, group="g").collect()}
    assert ("kat", "cat", 5.0) in near and ("ca", "cat", 8.0) in near and ("ca", "car", 8.0) in near and ("carts", "cart", 7.0) in near and ("cat", "cat", 0.0) in near and ("cat", "cart", 8.0) in near
    assert not any(w == "kat" and v == "car" for w, v, _ in near)
    dist = {r["state"]: r["distance"] for r in accept.distances_to_final(entries, group="g").collect()}
    assert dist[""] == 0.0 and dist["car"] == 1.0 and dist["care"] == 3.0


def test_ranking(spark):
    rows = [(1, "b", 2.0, 1.0), (1, "a", 2.0, 1.0), (1, "c", 2.0, 0.5), (1, "D", 9.0, 0.0), (2, "x", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "id bigint, value string, weight float, lexicon_weight float").withColumn("source", F.lit("d"))
    ranked = rank.rank_suggestions(df, by=["id"], lexicon_weight="lexicon_weight", n_best=None)
    assert [r["value"] for r in ranked.where("id = 1").orderBy("rank").collect()] == ["c", "a", "b", "D"]
    assert rank.rank_suggestions(df, by=["id"], n_best=0).count() == 0
    assert {r["value"] for r in rank.weight_limits(ranked, by=["id"], source="source", beam=1.0).collect()} == {"a", "b", "c", "D", "x"}
    limited = rank.weight_limits(ranked.withColumn("source", F.lit("q")), by=["id"], source="source", max_weight=1.5, beam=0.0)
    assert {r["value"] for r in limited.collect()} == {"x"}
    hidden = spark.createDataFrame([("a", "a+N"), ("a", "a+Spell/NoSugg"), ("b", "b+Spell/NoSugg")], "value string, analysis string")
    assert {r["value"] for r in evaluate.without_hidden(df, hidden).collect()} == {"a"}
    order = spark.createDataFrame([("p", "x", None, False, 5, 3, 0), ("q", None, None, False, 1, 0, 4), ("r", "x", 2, False, 9, 1, 3), ("s", "x", None, True, None, None, 0), ("t", None, None, True, 7, 2, 0)], "input string, expected string, position bigint, false_accept boolean, nanos bigint, distance bigint, n_suggestions int")

    def sort(mode, ascending=True):
        return "".join(r["input"] for r in evaluate.sort_report(order, mode, ascending).collect())

    assert sort("position") == "rqpst" and sort("position", False) == "pstqr"
    assert sort("time") == "rtpqs" and sort("time", False) == "qptrs"
    assert sort("classification") == "prqts" and sort("classification", False) == "stqpr"
    assert sort("distance")[:4] == "qrtp"
    placed = evaluate.place_in_report(order.withColumn("g", F.lit(1)), "classification", by=["g"], ties="input").collect()
    assert {r["input"]: r["place"] for r in placed} == {"p": 1, "r": 2, "q": 3, "t": 4, "s": 5}


def test_fastest_by_classes_of_times(spark):
    rng = random.Random(3)
    rows = [(g, "x", None, False, 0, rng.choice([None, 0, 5, 5, 1000, rng.randrange(10**9), int(rng.expovariate(1e-7))])) for g in ("a", "a", "a", "b", None) for _ in range(700)]
    rows += [("a", "x", None, False, 0, 7_000_000)] * 3000 + [("c", "x", None, False, 0, 3)]
    df = spark.createDataFrame(rows, "g string, expected string, position bigint, false_accept boolean, n_suggestions bigint, nanos bigint").repartition(5)
    rows_of = lambda found: sorted(map(str, found.collect()))
    assert rows_of(evaluate.summarize(df, ["g"])) == rows_of(evaluate.summarize(df, ["g"], small_groups=True))
    for r in evaluate.summarize(df, ["g"]).collect():
        times = sorted(x[5] for x in rows if x[0] == r["g"] and x[5] is not None)
        k = -(-len(times) * 95 // 100)
        assert r["average_time_95pc"] == sum(times[:k]) // k and r["total_words"] == sum(x[0] == r["g"] for x in rows)


def test_metrics_of_nothing_and_of_no_hits(spark):
    s = spark.createDataFrame([(0, 2, 5, 1), (0, 0, 3, 0)], "true_positive bigint, false_accept bigint, true_negative bigint, false_negative bigint")
    a, b = evaluate.classifier_metrics(s).collect()
    assert (a["precision"], a["recall"], a["f_score"]) == (0.0, 0.0, 0.0) and b["precision"] is None and b["f_score"] is None and b["accuracy"] == 1.0
    rows = spark.createDataFrame([("g", "x", None, False, 0)], "g string, expected string, position bigint, false_accept boolean, n_suggestions bigint")
    m = evaluate.suggestion_metrics(rows, ["g"]).first()
    assert (m["precision"], m["recall"], m["accuracy"], m["f_score"]) == (0.0, 0.0, 0.0, 0.0)
