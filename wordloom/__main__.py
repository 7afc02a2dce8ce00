"""Command line: suggest, tokenize, accuracy, info.

    python -m wordloom suggest --archive se.zhfst [--n-best 5] [--json] WORD ...
    python -m wordloom tokenize [--words] TEXT ...
    python -m wordloom accuracy --archive se.zhfst typos.tsv [--json-output FILE] [--threshold 50]
    python -m wordloom info se.zhfst

Without words or texts, lines are read from the standard input.  Exit codes: 0 done, 1 below
the threshold, 2 an archive or setting that cannot be used."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .functions import text
from .model import SpellerConfig
from .operators.suggest import Speller
from .sources import transducers


def _config(args: argparse.Namespace) -> SpellerConfig:
    base = SpellerConfig.from_json(Path(args.config).read_text("utf-8")) if args.config else SpellerConfig()
    return base.with_flags(n_best=args.n_best, max_weight=args.max_weight, completion_marker=args.completion_marker or base.completion_marker, verbose=args.verbose)


def _lines(given: list[str]) -> list[str]:
    return given or [line.rstrip("\n") for line in sys.stdin]


def _suggest(args: argparse.Namespace) -> int:
    speller: Speller = transducers.open_archive(args.archive).speller()
    config = _config(args)
    out = []
    for word in (w for w in _lines(args.words) if w):
        correct = speller.is_correct(word, config)
        given = [] if correct and not args.always else speller.suggest(word, config)
        counts: dict[str, int] = {}
        if args.statistics:
            speller.search(word, config, statistics=counts)
        analyses = {s.value: speller.lexicon.analyses(s.value, config.n_best) for s in given} if args.analyze else {}
        if args.json:
            found = [{"value": s.value, "weight": s.weight} | ({"completed": s.completed} if s.completed is not None else {}) | ({"analyses": [{"analysis": a, "weight": w} for a, w in analyses[s.value]]} if args.analyze else {}) for s in given]
            out.append({"word": word, "is_correct": correct, "suggestions": found} | ({"statistics": counts} if counts else {}))
            continue
        print(f"Input: {word}\t\t[{'CORRECT' if correct else 'INCORRECT'}]")
        for s in given:
            print(f"{s.value}\t\t{s.weight:.5f}" + (f" (lex: {s.details[0]:.5f}, mut: {s.details[1]:.5f}, rew: {s.details[2]:.5f}/{'-' if s.details[3] == -1 else format(s.details[3], '.5f')}/{s.details[4]:.5f})" if s.details else ""))
            for a, w in analyses.get(s.value, []):
                print(f"\t{a}\t{w:.5f}")
        for k, n in counts.items():
            print(f"# {k}: {n}")
    if args.json:
        print(json.dumps(out, ensure_ascii=False, indent=2))
    return 0


def _tokenize(args: argparse.Namespace) -> int:
    for line in _lines(args.texts):
        for at, piece in text.py_word_indices(line, args.alphabet) if args.words else text.segments(line, args.alphabet):
            print(f"{at}\t{json.dumps(piece, ensure_ascii=False)}")
    return 0


def _accuracy(args: argparse.Namespace) -> int:
    import time

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import evaluate
    from .session import ship
    from .sources import corpora

    archive = transducers.open_archive(args.archive)
    config = _config(args)
    spark = ship(SparkSession.builder.getOrCreate())
    began = time.time_ns()
    rows = evaluate.evaluate(corpora.read_typos(spark, args.typos, args.max_words), archive.speller(), config, timed=True).withColumn("run", F.lit(1))
    rows = rows.cache()
    summary = evaluate.summarize(rows, ["run"])
    counts = summary.first()
    took = time.time_ns() - began
    if args.json_output and counts is not None:
        span = lambda n: F.struct(F.lit(n // 10**9).alias("secs"), F.lit(n % 10**9).alias("subsec_nanos"))
        times = summary.select("run", span(began).alias("start_timestamp"), span(took).alias("total_time"))
        results = rows.select("run", "input", "expected", "distance", "suggestions", "position", F.struct(F.floor(F.col("nanos") / 10**9).alias("secs"), (F.col("nanos") % 10**9).alias("subsec_nanos")).alias("time"), "false_accept")
        report = corpora.report_json(results, summary, "run", config=json.dumps(config.to_dict()), metadata=json.dumps(archive.metadata.to_dict()) if archive.metadata else None, times=times)
        Path(args.json_output).write_text(report.first()["value"], "utf-8")
    if counts is None:
        print("no words")
        return 1 if args.threshold is not None else 0
    print(json.dumps(counts.asDict(), default=str))
    share = 100.0 * counts["top_five"] / counts["total_words"]
    return 1 if args.threshold is not None and not share > args.threshold else 0


def _info(args: argparse.Namespace) -> int:
    print(json.dumps(transducers.archive_info(transducers.open_archive(args.archive)), ensure_ascii=False, indent=2))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wordloom")
    commands = parser.add_subparsers(required=True)

    def command(name: str, run, settings: bool) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        if settings:
            p.add_argument("--archive", required=True)
            p.add_argument("--config", help="settings as JSON")
            p.add_argument("--n-best", type=int)
            p.add_argument("--max-weight", type=float)
            p.add_argument("--completion-marker")
            p.add_argument("--verbose", action="store_true")
        return p

    p = command("suggest", _suggest, True)
    p.add_argument("words", nargs="*")
    for flag in ("--json", "--analyze", "--always", "--statistics"):
        p.add_argument(flag, action="store_true")
    p = command("tokenize", _tokenize, False)
    p.add_argument("texts", nargs="*")
    p.add_argument("--words", action="store_true")
    p.add_argument("--alphabet", default="")
    p = command("accuracy", _accuracy, True)
    p.add_argument("typos")
    p.add_argument("--max-words", type=int)
    p.add_argument("--json-output")
    p.add_argument("--threshold", type=float)
    p = command("info", _info, False)
    p.add_argument("archive")
    args = parser.parse_args(argv)
    try:
        return args.run(args)
    except (transducers.UnsupportedArchive, transducers.CorruptArchive, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
