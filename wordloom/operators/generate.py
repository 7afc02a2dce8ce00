"""Inflected forms of lemmas, from a lexicon transducer.

The lemma is read symbol by symbol; after it only tag symbols (keys of more than one
character) may be read.  Every complete path gives a surface form (what it writes) and
an analysis (the tags it read); of equal pairs the lightest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Fst, GeneratorConfig, apply_flag, tagged_lexicon
from ..session import spread
from .rank import clusters
from .shards import aligned


def generate(fst: Fst, lemma: str, config: GeneratorConfig = GeneratorConfig(), split=clusters) -> list[tuple[str, str, float]]:
    """(surface, analysis, weight), ordered by weight, surface and analysis.  A lemma that
    is empty or has a symbol unknown to the lexicon has no forms.  ``split`` cuts the lemma
    into symbols; a letter of several code points counts as a tag, as its key is long."""
    letters = split(lemma)
    if not letters or any(g not in fst.by_key for g in letters):
        return []
    read = [fst.by_key[g] for g in letters]
    best: dict[tuple[str, str], float] = {}
    # a path may not come to a state twice
    stack = [(0, 0, 0.0, 0, frozenset(), (0,) * fst.n_features, "", "")]
    rounds = 0
    while stack:
        state, at, weight, depth, path, flags, surface, analysis = stack.pop()
        rounds += 1
        if config.max_iterations is not None and rounds > config.max_iterations:
            break
        if depth > config.max_depth or weight > config.max_weight:
            continue
        if at == len(read) and state in fst.finals:
            total = weight + fst.finals[state]
            key = (surface, analysis)
            if total <= config.max_weight and total < best.get(key, float("inf")):
                best[key] = total
        steps: list[tuple[int, tuple[int, int, float], tuple[int, ...]]] = [(0, arc, flags) for arc in fst.out(state, 0)]
        for sym, arc in fst.flag_arcs(state):
            after = apply_flag(flags, fst.flags[sym])
            if after is not None:
                steps.append((sym, arc, after))
        if at < len(read):
            steps += [(read[at], arc, flags) for arc in fst.out(state, read[at])]
        else:
            steps += [(s, arc, flags) for s in fst.arcs.get(state, {}) if s and s not in fst.flags and len(fst.keys[s]) > 1 for arc in fst.out(state, s)]
        for sym, (out, target, step), after in steps:
            if target in path:
                continue
            real = sym and sym not in fst.flags
            wrote = fst.keys[out] if out and out not in fst.flags else ""
            stack.append((target, at + 1 if real and at < len(read) else at, weight + step, depth + 1, path | {target}, after, surface + wrote, analysis + (fst.keys[sym] if real and at == len(read) else "")))
    ranked = sorted(((s, a, w) for (s, a), w in best.items()), key=lambda x: (x[2], x[0], x[1]))
    return ranked if config.max_results is None else ranked[: config.max_results]


def generate_forms(lemmas: DataFrame, fst: Fst, *, column: str = "lemma", config: GeneratorConfig = GeneratorConfig(), split=clusters) -> DataFrame:
    """(lemma, surface, analysis, weight) of the distinct lemmas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, *r) for w in batch.column(0).to_pylist() for r in generate(fst, w, config, split)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.float32())], names=[column, "surface", "analysis", "weight"])

    return spread(lemmas.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct()).mapInArrow(run, f"`{column}` string, surface string, analysis string, weight float")


def generate_by_parts(lemmas: DataFrame, *, tags, column: str = "lemma", config: GeneratorConfig = GeneratorConfig(), part_lemmas: int = 20_000) -> DataFrame:
    """(lemma, surface, analysis, weight) of the distinct lemmas under a lexicon that knows
    them all, with the paradigm ``tags`` (see :func:`..model.tagged_lexicon`).  Lemmas part by
    hash, and each task builds the transducer of its part: any number of lemmas will do."""
    entries = lemmas.select(F.lit("").alias("__all"), F.col(column).cast("string").alias("word"), F.lit(0.0).alias("weight")).where("length(word) > 0").distinct()

    def work(part: dict[str, float], todo: list[str]) -> pa.Table:
        fst = tagged_lexicon(part, tags, write=False)
        rows = [(w, *r) for w in todo for r in generate(fst, w, config, list)]
        return pa.table({n: pa.array([r[j] for r in rows], t) for j, (n, t) in enumerate([(column, pa.string()), ("surface", pa.string()), ("analysis", pa.string()), ("weight", pa.float32())])})

    made = aligned(entries.select("__all", F.col("word").alias(column)), entries, group="__all", column=column, part="{word}", work=work, out=f"`{column}` string, surface string, analysis string, weight float", share_entries=part_lemmas)
    return made.drop("__all")
