"""Find and undo text that was decoded with the wrong character encoding.

A hidden Markov model labels the characters of a value.  Its states are *clean*
and one per encoding pair (right encoding -> encoding it was read with); a pair
state emits *units*, the character sequences into which that pair turns one
character, so a unit of several characters is one step of the chain.  Viterbi
decoding (in bits) gives the cheapest labelling; every labelled span is restored
by the inverse transform of its state.

The pairs follow from rules, not from a list of garbled forms: UTF-8 bytes read as
each of ``READ_AS``, once or twice over, or as UTF-16; and each single-byte code
page that can write nearly the whole alphabet, read as one of ``LEGACY_READ_AS``.  Case
changes after the damage, control characters that were dropped and no-break spaces
that became blanks are variants of the units.  U+FFFD is a unit whose original is
lost; it is reported, but restored to itself.

A value of any length is labelled whole: between two units so far apart that leaving a
pair state and coming back costs no more than staying, the chain is clean, so what lies
between such places is labelled by itself; only the histories still alive are kept.

The state of a code page holds for whole words: it is entered and left at a blank, a
hyphen or an end, and a letter that it would have changed, or that its locale does not
write, cannot stand in it.

Nulls and empty values are clean.  A locale without an alphabet has only the
UTF-8 pairs.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread

# Encodings with which UTF-8 text is wrongly read.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-15", "cp437", "cp850", "cp852", "cp866", "mac_roman", "mac_cyrillic", "koi8-r")
# Encodings with which text in another code page is wrongly read.
LEGACY_READ_AS = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437")
# A code page belongs to a locale if it has this share of the letters beyond ASCII.
PAGE_SHARE = 0.85
# Single-byte code pages of European languages.
CODE_PAGES = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-4", "iso8859-5", "iso8859-7", "iso8859-9", "iso8859-10", "iso8859-13", "iso8859-15", "koi8-r", "koi8-u")
# Signs that stand beside words in technical text.
COMMON_SIGNS = "½±№≈βΔ™€°§«»²³µ–—’‘“”„…·×÷£©®¼¾"

# Costs in bits.
LETTER, OUTSIDE, FOREIGN, MIMIC, CAPITAL = 4.0, 5.0, 16.0, 9.0, 0.5
# A code page turns each of its letters into one character and cannot leave it as it is.
UNIT, CODED, FOLDED, DROPPED, SIGN = 2.0, 1.0, 1.0, 2.0, 3.0
ENTER, LEAVE, WITHIN, BETWEEN, UNTOUCHED = 6.0, 2.0, 0.3, 2.0, 5.0
LOST = "�"
# Plain characters (for code pages: blanks and hyphens) over which staying in a pair state
# costs as much as leaving and coming back.
APART, WORDS_APART = math.ceil((ENTER + LEAVE) / WITHIN), math.ceil((ENTER + LEAVE) / BETWEEN)


def _read(data: bytes, encoding: str) -> str:
    """Decode; bytes that the encoding leaves undefined become control characters."""
    return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in data)


@lru_cache(maxsize=None)
def _repertoire(encoding: str) -> frozenset[str]:
    return frozenset(_read(bytes(range(128, 256)), encoding))


@lru_cache(maxsize=100_000)
def _clean_cost(c: str, alphabet: frozenset[str]) -> float:
    if c in alphabet or c in " -":
        return LETTER
    if c < "\x7f" and c >= " ":
        return OUTSIDE
    kind = unicodedata.category(c)
    if any(c in _repertoire(w) for w in LEGACY_READ_AS) and c not in "\xa0\xad":
        return FOREIGN
    if kind in ("Cf", "Zs", "Mn") or kind[0] == "L" and ("＀" <= c < "｠" or "Ͱ" <= c < "԰" or unicodedata.decomposition(c).startswith("<compat>")):
        return MIMIC
    return FOREIGN


@lru_cache(maxsize=8)
def _utf8_units(more: str) -> tuple[list[str], dict[str, dict[int, tuple[float, str]]]]:
    """Names of the UTF-8 pairs, and unit -> pair -> (cost beyond that of the letter,
    original), over the letters of the European alphabets and ``more``."""
    ranges = ((0xA1, 0x180), (0x300, 0x332), (0x384, 0x3CF), (0x400, 0x460), (0x490, 0x500))
    letters = sorted({chr(x) for lo, hi in ranges for x in range(lo, hi)} | set(COMMON_SIGNS) | set(more))
    names: list[str] = []
    units: dict[str, dict[int, tuple[float, str]]] = {}
    for w in READ_AS:
        once = {c: _read(c.encode(), w) for c in letters}
        stages = [(f"utf-8 as {w}", once)]
        for again in dict.fromkeys((w, "cp1252")):
            stages.append((f"utf-8 as {w}, then as {again}", {c: _read(g.encode(), again) for c, g in once.items()}))
        for name, forms in stages:
            pair = len(names)
            names.append(name)
            for c, g in forms.items():
                variants = {g: UNIT}
                for v in (g.lower(), g.upper(), g[:1] + g[1:].lower()):
                    variants.setdefault(v, UNIT + FOLDED)
                for v, extra in list(variants.items()):
                    variants.setdefault(v.replace("\xa0", " "), extra + DROPPED)
                    kept = re.sub("[\x80-\x9f\xa0\xad]", "", v)
                    variants.setdefault(kept, extra + DROPPED + (2 if len(kept) == 1 else 0))
                for v, k in variants.items():
                    if v.isascii() or v == c or (k != UNIT and v.isalpha() and any("Ͱ" <= x < "԰" for x in v)):
                        continue  # two small letters of another script are no trace of bytes
                    have = units.setdefault(v, {})
                    if pair not in have or have[pair][0] > k:
                        have[pair] = (k, c)
    return names, units


class Garbles:
    """The units of every encoding pair for one alphabet."""

    def __init__(self, alphabet: frozenset[str]):
        self.alphabet = alphabet
        special = sorted(c for c in alphabet if c > "\x7f")
        names, self.utf8 = _utf8_units("".join(c for c in special if not any(lo <= ord(c) < hi for lo, hi in ((0xA1, 0x180), (0x300, 0x332), (0x384, 0x3CF), (0x400, 0x460), (0x490, 0x500)))))
        self.pairs = [*names, "lost"]
        self.first_legacy = len(self.pairs)
        self.units: dict[str, dict[int, tuple[float, str]]] = {LOST: {len(names): (0.0, LOST)}}
        self.changed: dict[int, frozenset[str]] = {}
        tables: dict[tuple, int] = {}
        for page in CODE_PAGES:
            coded = {c: b for c in special if (b := c.encode(page, "ignore"))}
            if len(coded) < PAGE_SHARE * len(special):
                continue
            for w in LEGACY_READ_AS:
                forms = {c: g for c, b in coded.items() if (g := _read(b, w)) != c}
                key = tuple(forms.items())
                if w == page or not forms:
                    continue
                if key in tables:
                    self.pairs[tables[key]] += f" | {page} as {w}"
                    continue
                pair = tables[key] = len(self.pairs)
                self.pairs.append(f"{page} as {w}")
                self.changed[pair] = frozenset(forms)
                for c, g in forms.items():
                    if not g.isascii():
                        self.units.setdefault(g, {})[pair] = (CODED, c)
        self.lengths: dict[str, list[int]] = {}
        for u in (*self.utf8, *self.units):
            self.lengths.setdefault(u[0], []).append(len(u))
        self.lengths = {c: sorted(set(n)) for c, n in self.lengths.items()}
        self.wide = frozenset(alphabet | set(" -"))

    def legacy(self, pair: int) -> bool:
        return pair >= self.first_legacy

    def _found(self, sub: str) -> Iterator[tuple[int, float, str]]:
        for table in (self.utf8, self.units):
            for pair, (cost, original) in table.get(sub, {}).items():
                if len(sub) > 1 or sub not in self.alphabet or self.legacy(pair):
                    yield pair, cost + (LETTER if original in self.alphabet or original == LOST else LETTER + SIGN) + CAPITAL * original.isupper(), original

    def _wide_runs(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, pair, original) of runs that are UTF-8 bytes read as UTF-16."""
        runs = []
        for m in re.finditer("[Ā-￿]+", text):
            run = m.group()
            if all(c in self.alphabet or unicodedata.decomposition(c).startswith(("<wide>", "<small>")) for c in run):
                continue
            for order in ("le", "be"):
                data = run.encode(f"utf-16-{order}", "surrogatepass").rstrip(b"\x00")
                for cut in range(3):
                    try:
                        original = data[: len(data) - cut].decode()
                    except UnicodeDecodeError:
                        continue
                    if any(c.isalpha() for c in original) and (cut == 0 or len(run) > 1) and all(c in self.wide or (c.isascii() and c.isalnum()) or c in COMMON_SIGNS for c in original) and original.isprintable():
                        runs.append((m.start(), m.end(), f"utf-8 as utf-16-{order}", original))
                    break
        return runs

    def label(self, text: str) -> tuple[str, list[str], bool] | None:
        """(restored text, pairs found, whether code-page pairs alone speak for it), or None
        if the whole text is clean."""
        names: dict[str, int] = {}
        units = self._candidates(text, names)
        coded = any(self.legacy(u[2]) for u in units)
        used: list[tuple[int, int, int, str]] = []
        first = 0
        while first < len(units):
            last, reach = first, units[first][1]
            while last + 1 < len(units) and self._near(text, reach, units[last + 1][0], coded):
                last += 1
                reach = max(reach, units[last][1])
            used += self._chain(text, units[first : last + 1], reach)
            first = last + 1
        if not used or all(text[a:b] in self.alphabet for a, b, _, _ in used):
            return None
        name = {v: k for k, v in names.items()}
        found = [name.get(s) or self.pairs[s] for s in dict.fromkeys(s for _, _, s, _ in used)]
        weak = all(s >= 0 and self.legacy(s) for _, _, s, _ in used)
        out, at = [], 0
        for a, b, _, original in used:
            if a > at:
                out.append(text[at:a])
            # a mark that was coded by itself joins the letter before it
            if out and unicodedata.combining(original[0]):
                out[-1] = out[-1][:-1] + unicodedata.normalize("NFC", out[-1][-1:] + original)
            else:
                out.append(original)
            at = b
        return "".join(out) + text[at:], found, weak

    @staticmethod
    def _near(text: str, a: int, b: int, coded: bool) -> bool:
        """Whether a pair state may be worth keeping over the plain characters text[a:b]."""
        if b - a < APART:
            return True
        return coded and text.count(" ", a, b) + text.count("-", a, b) < WORDS_APART

    def _candidates(self, text: str, names: dict[str, int]) -> list[tuple[int, int, int, float, str]]:
        """(start, end, pair, bits, original) of all units in the text, in order; pairs of
        UTF-16 are numbered below 0 in ``names``."""
        units = []
        n = len(text)
        for i, c in enumerate(text):
            for size in self.lengths.get(c, ()):
                if i + size <= n:
                    for pair, cost, original in self._found(text[i : i + size]):
                        if not self.legacy(pair) or self._in_word(text, i, size):
                            units.append((i, i + size, pair, cost, original))
        for start, end, name, original in self._wide_runs(text):
            units.append((start, end, names.setdefault(name, -1 - len(names)), LETTER * len(original) + UNIT, original))
        return sorted(units, key=lambda u: u[0])

    def _chain(self, text: str, units: list[tuple[int, int, int, float, str]], end: int) -> list[tuple[int, int, int, str]]:
        """Viterbi over the text from the first unit to ``end``, clean before and after it:
        (start, end, pair, original) of the units on the cheapest path."""
        inf = float("inf")
        states = sorted({u[2] for u in units})
        begin = units[0][0]
        # code pages: from the start of the first word, as their states hold for whole words
        if any(self.legacy(s) for s in states):
            while begin and text[begin - 1] not in " -":
                begin -= 1
            while end < len(text) and text[end] not in " -":
                end += 1
        # a history is a chain of the units used: (earlier, start, end, pair, original)
        ahead: dict[int, dict[int | None, tuple[float, tuple | None]]] = {begin: {None: (0.0, None)}}
        at = 0
        for i in range(begin, end + 1):
            here = ahead.pop(i)
            edge = i == 0 or i == len(text) or text[i] in " -" or text[i - 1] in " -"
            # entering and leaving a pair state emit nothing
            clean = here.get(None, (inf, None))
            for s in states:
                if s in here and here[s][0] + LEAVE < clean[0] and (edge or not self.legacy(s)):
                    clean = (here[s][0] + LEAVE, here[s][1])
            if i == end:
                break
            here[None] = clean
            for s in states:
                if (s not in here or clean[0] + ENTER < here[s][0]) and (edge or not self.legacy(s)):
                    here[s] = (clean[0] + ENTER, clean[1])
            c = text[i]
            cost = _clean_cost(c, self.alphabet)
            nxt = ahead.setdefault(i + 1, {})

            def come(to: dict, s: int | None, bits: float, history: tuple | None) -> None:
                if s not in to or bits < to[s][0]:
                    to[s] = (bits, history)

            come(nxt, None, clean[0] + cost, clean[1])
            for s in states:
                if s not in here:
                    continue
                bits, history = here[s]
                if not self.legacy(s):
                    come(nxt, s, bits + cost + WITHIN + (UNTOUCHED if c > "\x7f" else 0), history)
                elif c in self.alphabet:
                    # a letter that the code page leaves as it is
                    if c not in self.changed[s]:
                        come(nxt, s, bits + cost, history)
                elif not c.isalpha():
                    come(nxt, s, bits + cost + (BETWEEN if c in " -" else UNTOUCHED if c > "\x7f" else 0), history)
            while at < len(units) and units[at][0] == i:
                _, stop, s, cost, original = units[at]
                if s in here:
                    come(ahead.setdefault(stop, {}), s, here[s][0] + cost, (here[s][1], i, stop, s, original))
                at += 1
        out = []
        history = clean[1]
        while history is not None:
            history, *unit = history
            out.append(tuple(unit))
        return out[::-1]

    def _in_word(self, text: str, i: int, size: int) -> bool:
        """Whether a letter, or another suspect character, is next to text[i:i+size]."""
        near = text[max(0, i - 1) : i] + text[i + size : i + size + 1]
        return any(c.isalpha() or c > "\x7f" for c in near)


@lru_cache(maxsize=256)
def garbles(alphabet: str) -> Garbles:
    return Garbles(frozenset(alphabet))


def find_garbled(values: DataFrame, *, text_col: str = "text", alphabet_col: str = "alphabet", locale_col: str = "locale", keep: list[str] | None = None, odds: float = 20.0) -> DataFrame:
    """Rows of ``values`` whose text is wholly or partly garbled: the columns ``keep``
    (default: all but the alphabet) with ``restored`` and ``pairs`` (names of the
    encoding pairs), ``lost`` (whether U+FFFD remains).

    Input columns named like an output column are left out of the default.

    ``alphabet_col`` holds the letters of the row's locale as one string.  Values within
    alphabet and ASCII never leave the JVM, and each distinct (text, locale) is labelled
    once.  A word of a foreign name can look like one wrong letter in some code page.  How
    often a string stands where no code page explains it tells how often it is to be
    expected as such a name: a value for which only code-page pairs speak is garbled if its
    locale has it more than ``odds`` times as often.  These are rates, so the number of rows
    and how many locales happen to show a string do not matter.
    """
    keep = keep if keep is not None else [c for c in values.columns if c not in (alphabet_col, "restored", "pairs", "lost")]
    rest = F.expr(f"translate(regexp_replace({text_col}, '[\\\\x00-\\\\x7f]', ''), coalesce({alphabet_col}, ''), '')")
    odd = values.where(F.length(rest) > 0).select(*keep, F.col(text_col).cast("string").alias("__text"), F.coalesce(F.col(alphabet_col), F.lit("")).alias("__alphabet"), F.col(locale_col).cast("string").alias("__locale"))
    key = ["__text", "__alphabet", "__locale"]
    out = "__text string, __alphabet string, __locale string, __n bigint, restored string, pairs array<string>, lost boolean, __weak boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [garbles(alphabet).label(text) for text, alphabet in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g and g[0] for g in got], pa.string()), pa.array([g and g[1] for g in got], pa.list_(pa.string())), pa.array([g and LOST in g[0] for g in got], pa.bool_()), pa.array([bool(g and g[2]) for g in got], pa.bool_())],
                names=[*key, "__n", "restored", "pairs", "lost", "__weak"],
            )

    labelled = spread(odd.groupBy(*key).agg(F.count("*").alias("__n"))).mapInArrow(run, out)
    # a text has a row per locale and alphabet here, so the windows over texts are that small
    totals = values.groupBy(F.col(locale_col).cast("string").alias("__l")).agg(F.count("*").alias("__rows"))
    every = totals.agg(F.sum("__rows")).scalar()
    text = Window.partitionBy("__text")
    foreign = F.sum(F.when(F.col("__weak"), 0).otherwise(F.col("__n"))).over(text)
    explained = F.sum(F.when(F.col("__weak"), F.col("__rows")).otherwise(0)).over(text)
    expected = F.col("__rows") * F.col("__foreign") / F.nullif(every - F.col("__explained"), F.lit(0))
    judged = (
        labelled.join(totals, F.col("__locale").eqNullSafe(F.col("__l")))
        .withColumn("__foreign", foreign)
        .withColumn("__explained", explained)
        .where(F.col("restored").isNotNull() & (~F.col("__weak") | (F.col("__n") > odds * F.coalesce(expected, F.lit(0.0)))))
    )
    # one row a key, so this neither adds nor drops rows
    same = [F.col(f"__f{c}").eqNullSafe(F.col(c)) if c == "__locale" else F.col(f"__f{c}") == F.col(c) for c in key]
    judged = judged.select(*[F.col(c).alias(f"__f{c}") for c in key], "restored", "pairs", "lost")
    return odd.select(*keep, *key).join(judged, same).select(*keep, "restored", "pairs", "lost")
