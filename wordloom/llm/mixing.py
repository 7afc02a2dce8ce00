"""Mix sources to target weights by raking.

Tokens are summed over the cells source x language x topic; iterative proportional
fitting scales the cells' weights until the mixture has the target shares by source
and the wanted marginals by language and topic, no weight above the repeats allowed
in its source.  Each document is then taken floor(w) times, and once more with a
probability proportional to frac(w), calibrated per source to the tokens wanted and
drawn from a hash of its id: the draw is the same on every run and executor, and no
document is taken more often than its source allows.

The cell table has one row per named source, known language and topic class; it is
bounded by those lists, not by the documents.  Documents of sources without a target,
or without text, are not in the mixture.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_name(source: Column) -> Column:
    """One spelling of a source: trimmed, small letters, underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[-\s]+", "_")


#: Classes of a draw's quotient up to 1, in the histogram that calibrates the draws.
BINS = 2048


@dataclass(frozen=True)
class Plan:
    """Weights of the cells, and what the mixture is expected to hold."""

    cells: list[tuple[str, str, str]]
    weights: np.ndarray
    tokens: np.ndarray
    total: float


def source_goals(tokens: dict[str, float], shares: dict[str, float], repeats: dict[str, float], *, total: float | None = None, small: float = 0.02) -> dict[str, float]:
    """Tokens wanted of each source that has any: in proportion to the shares, but no more
    than its repeats give, what is missing then spread over the others in proportion.

    ``total``: tokens wanted in all, as far as the repeats give them.  By default as many as
    leave every share exact but those of the scarcest sources, whose targets together are at
    most ``small``: they give all they have, and do not decide the size for the others."""
    have = {s: t for s, t in tokens.items() if t > 0 and shares.get(s, 0) > 0 and repeats.get(s, 1.0) > 0}
    whole = sum(shares[s] for s in have)
    if not have:
        return {}
    most = {s: t * repeats.get(s, 1.0) for s, t in have.items()}
    full = sorted((most[s] * whole / shares[s], shares[s] / whole) for s in have)

    def at(level: float) -> dict[str, float]:
        return {s: min(most[s], level * shares[s] / whole) for s in have}

    if total is None:
        missed, level = 0.0, full[-1][0]
        for level, share in full:
            missed += share
            if missed > small:
                break
        return at(level)
    low, high = 0.0, full[-1][0]
    if sum(at(high).values()) <= total:
        return at(high)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(at(middle).values()) <= total else (low, middle)
    return at(low)


def rake(cells: list[tuple[str, str, str]], tokens: np.ndarray, shares: dict[str, float], repeats: dict[str, float], *, total: float | None = None, small: float = 0.02, langs: dict[str, float] | None = None, topics: dict[str, float] | None = None, rounds: int = 200, tolerance: float = 1e-6) -> Plan:
    """Weights by iterative proportional fitting under upper bounds.

    ``total`` and ``small``: as in :func:`source_goals`.  ``langs`` and ``topics``: target
    shares of languages and topics, by default those of the documents; without a target in
    a given list, a class has none.  Where bounds make all marginals together impossible,
    source goes first.  Targets of absent sources are spread over the others in proportion.
    """
    tokens = np.asarray(tokens, float)
    if not len(cells) or tokens.sum() <= 0:
        return Plan([], np.zeros(0), np.zeros(0), 0.0)
    names = [np.array([c[j] for c in cells]) for j in range(3)]
    goals = source_goals({s: float(tokens[names[0] == s].sum()) for s in dict.fromkeys(names[0].tolist())}, shares, repeats, total=total, small=small)
    cap = np.array([repeats.get(s, 1.0) for s in names[0]], float)
    total = sum(goals.values())
    usable = np.isin(names[0], list(goals))

    def marginal(j: int, targets: dict[str, float] | None) -> dict[str, float]:
        present = dict.fromkeys(names[j][usable].tolist())
        if targets is None:
            return {v: total * tokens[usable & (names[j] == v)].sum() / tokens[usable].sum() for v in present}
        whole = sum(targets.get(v, 0.0) for v in present) or 1.0
        return {v: total * targets.get(v, 0.0) / whole for v in present}

    wanted = [goals, marginal(1, langs), marginal(2, topics)]
    masks = [[(names[j] == v, goal) for v, goal in wanted[j].items()] for j in range(3)]
    w = np.ones(len(cells))
    w[~usable] = 0.0

    def fit(mask: np.ndarray, goal: float) -> None:
        # scale up to the bound; what the bound cuts off goes to the cells below it
        for _ in range(30):
            have = float((w[mask] * tokens[mask]).sum())
            free = mask & (w < cap) & (w > 0)
            open_ = float((w[free] * tokens[free]).sum())
            if have <= 0 or abs(have - goal) <= 1e-12 * max(goal, 1.0):
                return
            if goal < have:
                w[mask] *= max(goal, 0.0) / have
                return
            if open_ <= 0:
                return
            w[free] = np.minimum(cap[free], w[free] * (1 + (goal - have) / open_))

    for _ in range(rounds):
        before = w.copy()
        for j in (2, 1, 0):
            for mask, goal in masks[j]:
                fit(mask, goal)
        if np.abs(w - before).max() < tolerance:
            break
    return Plan(cells, w, tokens, total)


def mix(documents: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", source: str = "source", lang: str = "lang", topic: str = "topic", size: str = "tokens", seed: int = 42, total: float | None = None, small: float = 0.02, langs: dict[str, float] | None = None, topics: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).  mixture: (id, source, lang, topic, tokens, weight, copies) of
    the documents taken at least once.  shares: per target source its target and actual
    share, documents, copies and tokens, and whether all its repeats together fall short of
    the target (``exhausted``; a source without documents is); actual shares sum to 1 (null
    if nothing is taken).  ``total``, ``small``, ``langs``, ``topics``: as in :func:`rake`.
    A null ``max_repeats`` counts as 1, 0 keeps a source out.

    ``documents`` must be cheap to read twice (a stored table, or checkpointed).
    """
    spark = documents.sparkSession
    goal = {}
    for r in targets.select("source", "target_share", "max_repeats").collect():
        if r[0] is not None and r[1] is not None:
            goal[r[0]] = (float(r[1]), 1.0 if r[2] is None else float(r[2]))
    docs = documents.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.coalesce(F.col(lang), F.lit("?")).alias("lang"), F.coalesce(F.col(topic), F.lit("?")).alias("topic"), F.col(size).cast("bigint").alias("tokens")).where((F.col("tokens") > 0) & F.col("source").isin(list(goal)))
    sums = docs.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("t")).orderBy("source", "lang", "topic").collect()
    plan = rake([(r[0], r[1], r[2]) for r in sums], np.array([r[3] for r in sums], float), {s: g[0] for s, g in goal.items()}, {s: g[1] for s, g in goal.items()}, total=total, small=small, langs=langs, topics=topics)
    weights = spark.createDataFrame([(*c, float(w)) for c, w in zip(plan.cells, plan.weights)], "source string, lang string, topic string, weight double")
    # 53 bits of the hash, as a number in [0, 1)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) / F.lit(float(1 << 53))
    drawn = (
        docs.join(weights, ["source", "lang", "topic"])
        .withColumn("base", F.floor("weight"))
        .withColumn("part", F.col("weight") - F.col("base"))
        # a document is taken once more if its draw is below its part: the quotient below 1
        .withColumn("draw", F.when(F.col("part") > 0, u / F.col("part")))
        .withColumn("bin", F.floor(F.col("draw") * BINS))
    )
    # lengths are so skewed that the tokens drawn miss their target; the limit on the quotient
    # is therefore set per source where the tokens below it come nearest, by a histogram
    sums = drawn.groupBy("source", F.when(F.col("bin") < 2 * BINS, F.col("bin")).alias("bin")).agg(F.sum(F.when(F.col("part") > 0, F.col("tokens"))).alias("t"), F.sum(F.col("base") * F.col("tokens")).alias("whole")).collect()
    own = {name: np.array([c[0] == name for c in plan.cells], bool) for name in {c[0] for c in plan.cells}}
    aim = {name: float((plan.weights[at] * plan.tokens[at]).sum()) for name, at in own.items()}
    room = {name: float(plan.tokens[at].sum()) * goal[name][1] for name, at in own.items()}
    limits = []
    for name in sorted({r["source"] for r in sums}):
        mine = [r for r in sums if r["source"] == name]
        wanted = aim[name] - sum(r["whole"] or 0 for r in mine)
        best, limit, have = abs(wanted), 0.0, 0.0
        for b, t in sorted((r["bin"], r["t"]) for r in mine if r["bin"] is not None):
            have += t
            if abs(wanted - have) < best:
                best, limit = abs(wanted - have), (b + 1) / BINS
        limits.append((name, limit))
    at = spark.createDataFrame(limits, "source string, limit double")
    mixture = (
        drawn.join(at, "source")
        .withColumn("copies", (F.col("base") + F.coalesce(F.col("draw") < F.col("limit"), F.lit(False)).cast("int")).cast("int"))
        .where("copies > 0")
        .select(F.col("id").alias(id_col), "source", "lang", "topic", "tokens", "weight", "copies")
    )
    reach = sum(goal[s][0] for s in aim if aim[s] > 0) or 1.0
    aims = spark.createDataFrame([(s, g[0], int(g[1]), room.get(s, 0.0) < plan.total * g[0] / reach * (1 - 1e-9)) for s, g in goal.items()], "source string, target_share double, max_repeats int, exhausted boolean")
    taken = mixture.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    shares = aims.join(taken, "source", "left").fillna(0, ["documents", "copies", "tokens"])
    # one row per target source: the window over all of them is that small
    shares = shares.withColumn("actual_share", F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy(F.lit(0))), F.lit(0)))
    return mixture, shares
