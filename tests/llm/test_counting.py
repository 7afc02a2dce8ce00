"""Terms, percentiles, tokens, packing and mixing."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.llm.mixing import mix, rake, source_goals, source_name
from wordloom.llm.packing import fill_containers, pack_histogram
from wordloom.llm.quantiles import day_sketches, merge_sketches, percentiles, rank_error
from wordloom.llm.terms import mark_terms, term_frequencies
from wordloom.llm.tokens import _counter, count_tokens, with_tokens


def brute_terms(rows):
    seen, recs = defaultdict(set), defaultdict(set)
    for f, t, r, a, b in rows:
        if t:
            seen[f, t].add((r, a, b))
            if r is not None:
                recs[f, t].add(r)
    return {k: (len(v), len(recs[k])) for k, v in seen.items()}


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_terms_against_brute_force(spark, partitions):
    rng = random.Random(partitions)
    words = ["hot"] * 12 + ["a", "b", "ä", "", None, "long " * 300]
    rows = [(rng.choice("xy"), rng.choice(words), rng.choice([None, *range(6)]), rng.choice([None, *range(9)]), rng.randrange(2)) for _ in range(3000)]
    rows += [("x", "hot", 1, 1, 1)] * 1500  # copies of one row: a third of all
    df = spark.createDataFrame(rows, "field string, term string, record bigint, key bigint, rank int").withColumn("edge", F.lit(1)).withColumn("occurrences", F.lit("clash")).repartition(7)
    got = {(r[0], r[1]): (r[2], r[3]) for r in term_frequencies(df, keys=["key", "rank"], partitions=partitions).collect()}
    assert got == brute_terms(rows)


def test_terms_small(spark):
    empty = spark.createDataFrame([], "field string, term string, record bigint, key bigint")
    assert term_frequencies(empty, keys=["key"]).count() == 0
    one = spark.createDataFrame([("f", "t", None, None), ("f", "t", None, None), ("f", "u", 5, 1)], "field string, term string, record bigint, key bigint")
    assert {tuple(r) for r in term_frequencies(one, keys=["key"]).collect()} == {("f", "t", 1, 0), ("f", "u", 1, 1)}
    marked = mark_terms(spark.createDataFrame([("a", 1), ("b", 2), ("c", 11), ("d", 10), ("e", 0)], "term string, records bigint"), 100)
    assert {r["term"]: r["mark"] for r in marked.collect()} == {"a": "rare", "b": None, "c": "common", "d": None, "e": None}


def test_percentiles_and_merging(spark):
    rng = np.random.default_rng(1)
    n = 60_000
    values = np.where(rng.random(n) < 0.3, 0, np.exp(rng.normal(14, 2, n))).astype(np.int64)
    df = spark.range(n).select(F.expr("id % 3").alias("g"), F.expr("id % 10").alias("day"), F.element_at(F.array(*[F.lit(0)]), 1).alias("z"), "id")
    data = spark.createDataFrame([(int(i % 3), int(i % 10), int(v) if i % 97 else None) for i, v in enumerate(values)], "g bigint, day bigint, v bigint")
    del df
    days = day_sketches(data, ["g", "day"], "v")
    whole = percentiles(merge_sketches(days, ["g"]), {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    assert days.count() == 30
    for r in whole.collect():
        exact = np.sort(np.array([v for i, v in enumerate(values) if i % 3 == r["g"] and i % 97]))
        assert r["n"] == len(exact) and r["least"] == exact[0] and r["greatest"] == exact[-1]
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            lo, hi = np.searchsorted(exact, r[name], "left") / len(exact), np.searchsorted(exact, r[name], "right") / len(exact)
            assert lo - rank_error(800) <= p <= hi + rank_error(800)
    nulls = spark.createDataFrame([(1, None), (None, 5), (None, 5)], "g bigint, v bigint")
    assert [(r["g"], r["n"], r["p50"]) for r in percentiles(day_sketches(nulls, ["g"], "v"), {"p50": 0.5}).collect()] == [(None, 2, 5)]
    assert day_sketches(nulls.limit(0), ["g"], "v").count() == 0
    with pytest.raises(ValueError):
        day_sketches(nulls.withColumn("n", F.lit(1)), ["n"], "v")


def test_tokens(spark):
    from wordloom.llm import tokens

    texts = ["Hello world, it's 42 km.", "a  b", " lead", "trail ", "x \ny", "\n", "a\n b", "", None, "花园里 的狗", "naïve café’s", "x" * 300_000, "don't can't 1234 5678", "tab\tand nbsp", "<|endoftext|> y"]
    import base64

    import tiktoken

    with open(tokens.DEFAULT_VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("x", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert count_tokens(texts) == [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id bigint, text string, tokens int")
    assert [r["tokens"] for r in with_tokens(df).orderBy("id").collect()] == count_tokens(texts)
    assert with_tokens(df.limit(0)).count() == 0
    _counter.cache_clear()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(1, 60), max_size=60))
def test_packing_invariants(capacity, sizes):
    sizes = [s for s in sizes if s <= capacity]
    bins = pack_histogram(capacity, Counter(sizes))
    placed = Counter()
    for times, content in bins:
        assert times > 0 and 0 < sum(s * k for s, k in content) <= capacity
        assert sum(k for s, k in content if 3 * s > capacity) <= 2
        for s, k in content:
            placed[s] += times * k
    assert placed == Counter(sizes)
    total = sum(t for t, _ in bins)
    assert total <= 2 * max(1, -(-sum(sizes) // capacity)) + 1  # never far from the room needed


def best_fit_decreasing(capacity, sizes):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, g in enumerate(gaps) if g >= s]
        if fit:
            i = min(fit, key=lambda i: gaps[i])
            gaps[i] -= s
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_packing_is_as_good_as_best_fit():
    rng = random.Random(3)
    for _ in range(20):
        sizes = [min(100, int(rng.expovariate(1 / 30)) + 1) for _ in range(400)]
        got = sum(t for t, _ in pack_histogram(100, Counter(sizes)))
        assert got <= best_fit_decreasing(100, sizes) * 1.02 + 1


def test_containers(spark):
    rng = random.Random(5)
    items = [(i, rng.choice([3, 7, 7, 7, 40, 99, 250])) for i in range(900)] + [(1000, None), (1001, 0), (1002, 10_000), (2000, 7), (2000, 7), (2000, 7)]
    df = spark.createDataFrame(items, "doc_id bigint, tokens bigint").withColumn("bin_id", F.lit("clash")).withColumn("size", F.lit(0))
    kinds = spark.createDataFrame([("small", 64), ("large", 300), ("none", 0), ("null", None)], "container_kind string, capacity_tokens int")
    rows = fill_containers(df, kinds).collect()
    for kind, capacity in (("small", 64), ("large", 300)):
        own = [r for r in rows if r["container_kind"] == kind]
        fill = Counter()
        for r in own:
            fill[r["bin_id"]] += r["piece_tokens"]
        assert all(fill[r["bin_id"]] == r["bin_tokens"] <= capacity for r in own)
        assert set(fill) == set(range(len(fill)))
        assert sum(fill.values()) == sum(n or 0 for _, n in items)
        pieces = Counter((r["doc_id"], r["piece_no"]) for r in own)
        assert pieces[2000, 0] == 3
        assert all((r["pieces"] == 1) == (dict(items)[r["doc_id"]] <= capacity) for r in own)
        sizes = [p for _, n in items if n for p in [capacity] * (n // capacity) + [n % capacity] * (n % capacity > 0)]
        assert len(fill) <= best_fit_decreasing(capacity, sizes) * 1.02 + 1
    assert {r["container_kind"] for r in rows} == {"small", "large"}
    # frequent sizes in several classes: other ranks, the same bins
    shape = lambda found: Counter((r["container_kind"], r["bin_id"], r["piece_tokens"], r["bin_tokens"]) for r in found)
    assert shape(fill_containers(df, kinds, per_task=50).collect()) == shape(rows)
    assert fill_containers(df.limit(0), kinds).count() == 0
    assert fill_containers(df, kinds.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_containers(df.withColumnRenamed("doc_id", "pieces"), kinds, id_col="pieces")


def test_rake_reaches_marginals():
    cells = [(s, l, t) for s in "ab" for l in ("en", "de") for t in "XY"]
    tokens = np.array([100, 200, 300, 50, 500, 10, 70, 900], float)
    plan = rake(cells, tokens, {"a": 0.5, "b": 0.5}, {"a": 3, "b": 3}, total=600)
    got = plan.weights * tokens
    assert got[:4].sum() == pytest.approx(300, rel=1e-3) and got[4:].sum() == pytest.approx(300, rel=1e-3)
    share = tokens[[0, 1, 4, 5]].sum() / tokens.sum()
    assert got[[0, 1, 4, 5]].sum() / got.sum() == pytest.approx(share, rel=0.02)
    assert (plan.weights <= 3).all()
    most = rake(cells, tokens, {"a": 0.9, "b": 0.1}, {"a": 2, "b": 1})
    assert most.total == pytest.approx(650 * 2 / 0.9) and (most.weights[:4] == pytest.approx(2))
    assert rake([], np.zeros(0), {}, {}).total == 0


def test_mixture(spark):
    rng = random.Random(2)
    docs = [(i, "b" if i % 10 else "a", rng.choice(["en", "de", None]), rng.choice("XYZ"), rng.randrange(1, 400)) for i in range(6000)]
    docs += [(9000, None, None, None, None), (9001, "c", "en", "X", 10), (9002, "a", "en", "X", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, lang string, topic string, tokens bigint").withColumn("weight", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.6, 1), ("absent", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixture, shares = mix(df, targets)
    rows = mixture.collect()
    assert max(r["copies"] for r in rows if r["source"] == "a") <= 2 and max(r["copies"] for r in rows if r["source"] == "b") == 1
    by = {r["source"]: r for r in shares.collect()}
    assert by["a"]["actual_share"] == pytest.approx(0.4, abs=0.003) and by["b"]["actual_share"] == pytest.approx(0.6, abs=0.003)
    assert by["absent"]["copies"] == 0 and sum(r["actual_share"] for r in by.values()) == pytest.approx(1)
    assert sorted(map(tuple, mix(df, targets)[0].collect())) == sorted(map(tuple, rows))
    none_mix, none_shares = mix(df.limit(0), targets)
    assert none_mix.count() == 0 and all(r["actual_share"] is None for r in none_shares.collect())
    names = spark.createDataFrame([(" OCR-backfile ",), ("PCT_FEED",), (None,)], "s string")
    assert [r[0] for r in names.select(source_name(F.col("s"))).collect()] == ["ocr_backfile", "pct_feed", None]


def test_large_sizes_of_one_item_are_paired():
    assert sum(t for t, _ in pack_histogram(100, {45: 1, 42: 1, 41: 1, 40: 1})) == 2
    assert sorted(pack_histogram(100, {45: 3, 40: 2})) == [(1, ((40, 1),)), (1, ((45, 1), (40, 1))), (1, ((45, 2),))]
    rng = random.Random(8)
    for _ in range(50):
        sizes = Counter(rng.randrange(34, 51) for _ in range(rng.randrange(1, 40)))
        assert sum(t for t, _ in pack_histogram(100, sizes)) == -(-sizes.total() // 2)


def test_scarce_sources_do_not_decide_the_size():
    tokens, shares, repeats = {"tiny": 60.0, "a": 5e5, "b": 4e5, "none": 1e5}, {"tiny": 0.01, "a": 0.59, "b": 0.4, "absent": 0.1}, {"tiny": 8.0, "a": 1.0, "b": 2.0}
    got = source_goals(tokens, shares, repeats)
    assert set(got) == {"tiny", "a", "b"} and got["tiny"] == 480 and got["a"] == pytest.approx(5e5)
    assert all(abs(g / sum(got.values()) - shares[s]) <= 0.02 for s, g in got.items())
    exact = source_goals(tokens, shares, repeats, small=0.0)
    assert sum(exact.values()) == pytest.approx(48_000) and exact["a"] == pytest.approx(48_000 * 0.59)
    asked = source_goals(tokens, shares, repeats, total=1e6)
    assert sum(asked.values()) == pytest.approx(1e6) and asked["a"] <= 5e5 and asked["b"] <= 8e5
    assert sum(source_goals(tokens, shares, repeats, total=1e9).values()) == pytest.approx(480 + 5e5 + 8e5)
    assert source_goals({}, shares, repeats) == {} and source_goals(tokens, shares, dict.fromkeys(tokens, 0.0)) == {}


def test_rake_to_language_and_topic_targets():
    cells = [(s, l, t) for s in "ab" for l in ("en", "de") for t in "XY"]
    tokens = np.array([100, 200, 300, 50, 500, 10, 70, 900], float)
    plan = rake(cells, tokens, {"a": 0.5, "b": 0.5}, {"a": 5, "b": 5}, total=600, langs={"en": 0.75, "de": 0.25}, topics={"X": 0.5, "Y": 0.5})
    got = plan.weights * tokens
    assert got[[0, 1, 4, 5]].sum() == pytest.approx(450, rel=0.01) and got[[0, 2, 4, 6]].sum() == pytest.approx(300, rel=0.01) and got[:4].sum() == pytest.approx(300, rel=1e-3)


def test_repeats_of_zero_and_null(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], "en", "X", 10) for i in range(600)], "doc_id bigint, source string, lang string, topic string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 0), ("b", 0.25, None), ("c", 0.25, 3)], "source string, target_share double, max_repeats int")
    mixture, shares = mix(docs, targets)
    assert {r["source"] for r in mixture.collect()} == {"b", "c"}
    by = {r["source"]: r for r in shares.collect()}
    assert by["a"]["copies"] == 0 and by["a"]["exhausted"] and not by["b"]["exhausted"] and by["b"]["actual_share"] == pytest.approx(0.5, abs=0.02)
