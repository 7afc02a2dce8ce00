"""Bring text that looks the same to one stored form.

1. Every code point of the corpus is counted per locale (one pass over all values).
2. Look-alike classes are built by union-find over code points and strings: a code
   point joins its compatibility form where that keeps the look (full width, no-break,
   ligature, letter-like), a base with combining marks joins its composed letter, and
   letters of one confusable skeleton (Unicode TR 39, from the ICU library that Spark
   ships) and of one case join each other.  Format characters are in the class of the
   empty string, blanks in that of the space, hyphens in that of the hyphen-minus.
3. In each class the most frequent member that the locale can write is the
   representative; letters with combining marks are counted as strings for that.  One code
   point goes before several, a letter that stays alike as a capital before one that does
   not.  Two letters of the locale's own alphabet never become one.
4. An Aho-Corasick automaton over the other members rewrites each value greedily,
   longest match first, until nothing changes (a form that comes back ends it too); the
   result is in NFC.

A word is written either in the letters of the locale or in basic Latin, so a word
that mixes both is brought to the locale's letters if that works, else to Latin.

Null stays null; an empty value, or one that imitates nothing (signs, emoji, foreign
letters without a counterpart), stays as it is and is no case.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import garbles

ASCII_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
PRINTABLE = frozenset(chr(x) for x in range(32, 127))
#: Kinds of compatibility forms that keep the look of the text.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>")


class UnionFind:
    """Disjoint sets of hashable items."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        sets = defaultdict(list)
        for x in self.parent:
            sets[self.find(x)].append(x)
        return [sorted(s) for s in sets.values()]


@lru_cache(maxsize=65536)
def plain_form(c: str) -> str | None:
    """The ordinary string that one code point imitates by its Unicode properties, or None."""
    kind = unicodedata.category(c)
    if kind == "Cf" or c == "͏":
        return ""
    if kind == "Zs":
        return " "
    if kind == "Pd" and "HYPHEN" in unicodedata.name(c, "") and c != "-":
        return "-"
    tag, _, rest = unicodedata.decomposition(c).partition(" ")
    if tag in _SAME_LOOK and kind[0] in "LNP" and "VULGAR" not in unicodedata.name(c, ""):
        return unicodedata.normalize("NFKC", c)
    if tag and tag[0] != "<" and not rest:
        return unicodedata.normalize("NFC", c)
    return None


def skeletons(spark: SparkSession, chars: list[str]) -> dict[str, str]:
    """Confusable skeleton of each letter, from the JVM's ICU.  Where that is out of reach
    (a session without a JVM of its own) it is an error, as letters of other scripts would
    lose their classes unseen; such sessions pass :func:`fit_lookalikes` a table of theirs."""
    try:
        checker = getattr(spark._jvm.com.ibm.icu.text.SpoofChecker, "Builder")().build()
        return {c: checker.getSkeleton(c) for c in chars}
    except Exception as e:
        raise RuntimeError("the confusable skeletons of Spark's ICU are out of reach; pass fit_lookalikes a skeleton function") from e


class LookAlikes:
    """Classes and rewriting automata of every locale."""

    def __init__(self, counts: dict[str, dict[str, int]], alphabets: dict[str, str], skeleton: Callable[[list[str]], dict[str, str]]):
        """``counts``: code points, and letters with their marks, by locale; ``alphabets``: letters by locale."""
        chars = sorted({c for x in (*counts.values(), *alphabets.values(), ASCII_LETTERS) for k in x for c in k})
        self.alphabets = {k: frozenset(v) for k, v in alphabets.items()}
        sets = UnionFind()
        for c in chars:
            form = plain_form(c)
            if form is not None and form != c:
                sets.union(c, form)
        letters = [c for c in chars if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nl"]
        for c in (c for c in letters if c.lower() != c.upper()):
            apart = unicodedata.normalize("NFD", c)
            if apart != c:
                sets.union(c, apart)
        by_look = defaultdict(list)
        self.look = skeleton(sorted({*letters, *(u for c in letters if len(u := c.upper()) == 1)}))
        for c, look in ((c, self.look.get(c)) for c in letters):
            if look and plain_form(c) is None:
                by_look[look, c.isupper(), c.islower()].append(c)
        for same in by_look.values():
            for c in same[1:]:
                sets.union(same[0], c)
        self.classes = [c for c in sets.classes() if len(c) > 1]
        self.maps: dict[str, tuple[dict[str, str], dict[str, str]]] = {}
        for locale, alphabet in self.alphabets.items():
            seen = counts.get(locale, {})
            self.maps[locale] = (self._choose(alphabet | PRINTABLE if self._latin(alphabet) else alphabet | (PRINTABLE - ASCII_LETTERS), seen), self._choose(PRINTABLE, seen))

    @staticmethod
    def _latin(alphabet: frozenset[str]) -> bool:
        return not alphabet or sum(c in ASCII_LETTERS for c in alphabet) * 4 >= len(alphabet)

    def _choose(self, allowed: frozenset[str], seen: dict[str, int]) -> dict[str, str]:
        out = {}
        for members in self.classes:
            able = [m for m in members if all(c in allowed for c in m)]
            if not able:
                continue
            for m in members:
                if m not in able and m:
                    # a pair that stays alike as capitals goes before one that does not
                    alike = [x for x in able if self.look.get(x.upper(), x) == self.look.get(m.upper(), m)] or able
                    out[m] = "" if "" in able else max(alike, key=lambda x: (len(x) == 1, seen.get(x, 0), x.isascii(), -len(x), x))
        return out

    def __getstate__(self) -> dict:
        return {"maps": self.maps, "alphabets": self.alphabets}

    @lru_cache(maxsize=64)  # noqa: B019 - one object lives as long as the worker
    def _automaton(self, locale: str, latin: bool) -> ahocorasick.Automaton | None:
        patterns = self.maps[locale][latin]
        if not patterns:
            return None
        a = ahocorasick.Automaton()
        for k, v in patterns.items():
            a.add_word(k, (len(k), v))
        a.make_automaton()
        return a

    def _rewrite(self, text: str, locale: str, latin: bool) -> str:
        a = self._automaton(locale, latin)
        if a is None:
            return unicodedata.normalize("NFC", text)
        known = set()
        while text not in known:
            known.add(text)
            out, at = [], 0
            for end, (size, new) in a.iter_long(text):
                out += [text[at : end + 1 - size], new]
                at = end + 1
            text = unicodedata.normalize("NFC", "".join(out) + text[at:])
        return text

    def normal_form(self, text: str, locale: str) -> str | None:
        """The ordinary form that ``text`` looks like, or None if it has none."""
        if locale not in self.maps:
            return None
        alphabet = self.alphabets[locale]
        mixed = self._latin(alphabet)
        text = self._rewrite_marks(text, locale)
        out = []
        for word in _pieces(text):
            if len(word) == 1 and word not in alphabet and ("Ͱ" <= word < "Ѐ" or unicodedata.category(word)[0] in "SN"):
                out.append(word)  # a sign, or a Greek letter that stands for one, beside the text
                continue
            if all(c in PRINTABLE for c in word) or all(c in alphabet for c in word):
                out.append(word)
                continue
            new = self._rewrite(word, locale, False)
            if not all(c in alphabet or c in PRINTABLE and (mixed or c not in ASCII_LETTERS) for c in new):
                new = self._rewrite(word, locale, True)
                if not all(c in PRINTABLE for c in new):
                    return None
            out.append(new)
        new = unicodedata.normalize("NFC", "".join(out))
        return new if any(c in alphabet or c in ASCII_LETTERS for c in new) else None

    def _rewrite_marks(self, text: str, locale: str) -> str:
        """Format characters, blanks and hyphens to their plain forms: they decide where words end."""
        return "".join(p if (p := plain_form(c)) is not None and p in ("", " ", "-") else c for c in text)


def _pieces(text: str) -> list[str]:
    """Words, and the spaces and hyphens between them."""
    out, word = [], ""
    for c in text:
        if c in " -":
            out += [word, c] if word else [c]
            word = ""
        else:
            word += c
    return [*out, word] if word else out


@lru_cache(maxsize=1)
def _marks() -> np.ndarray:
    """Whether each code point is a combining mark."""
    out = np.zeros(0x110000, bool)
    out[[x for x in range(0x300, 0x1F000) if unicodedata.category(chr(x))[0] == "M"]] = True
    return out


def count_forms(values: DataFrame, *, text_col: str = "text", locale_col: str = "locale") -> DataFrame:
    """(locale, form, n) over all values: every code point, and every character with the
    combining marks after it as a string; partial counts are made before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], int] = defaultdict(int)
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(batch.column(1))))
            if not batch.num_rows:
                continue
            codes = pc.dictionary_encode(batch.column(0))
            names = codes.dictionary.to_pylist()
            sizes = pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False)
            text = "".join(batch.column(1).to_pylist())
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            owner = np.repeat(codes.indices.to_numpy(zero_copy_only=False), sizes)
            small = points < 128
            n = np.bincount(owner[small] * 128 + points[small], minlength=128 * len(names))
            for k in np.flatnonzero(n).tolist():
                total[names[k // 128], chr(k % 128)] += int(n[k])
            rest, n = np.unique(owner[~small].astype(np.int64) * 0x110000 + points[~small], return_counts=True)
            for k, m in zip(rest.tolist(), n.tolist()):
                total[names[k // 0x110000], chr(k % 0x110000)] += m
            if small.all():
                continue
            # characters with marks after them, within one value
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])[sizes > 0]
            mark = _marks()[points]
            mark[first] = False
            heads = np.flatnonzero(~mark & np.append(mark[1:], False))
            ends = np.searchsorted(bases := np.append(np.flatnonzero(~mark), len(points)), heads, side="right")
            for a, b in zip(heads.tolist(), bases[ends].tolist()):
                total[names[owner[a]], text[a:b]] += 1
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], names=["locale", "form", "n"])

    part = values.select(F.col(locale_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "locale string, form string, n bigint")
    return part.groupBy("locale", "form").agg(F.sum("n").alias("n"))


#: Most marks after a character in a counted string; no composed letter has more.
MARKS = 3


def fit_lookalikes(values: DataFrame, alphabets: DataFrame, *, text_col: str = "text", locale_col: str = "locale", skeleton: Callable[[list[str]], dict[str, str]] | None = None) -> LookAlikes:
    """Classes from the code points of all values.  What reaches the driver is one row
    per locale and code point in use, or letter with up to ``MARKS`` marks, and the letters
    per locale, whatever the rows.  ``skeleton``: confusable skeletons of letters, by
    default those of Spark's own ICU."""
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for row in count_forms(values, text_col=text_col, locale_col=locale_col).where(F.length("form") <= 1 + MARKS).collect():
        counts[row["locale"]][row["form"]] = row["n"]
    letters = {r["locale"]: r["alphabet"] for r in alphabets.select("locale", "alphabet").distinct().collect() if r["locale"] is not None}
    return LookAlikes(counts, letters, skeleton or (lambda chars: skeletons(values.sparkSession, chars)))


def disguised_values(values: DataFrame, model: LookAlikes, *, text_col: str = "text", locale_col: str = "locale", alphabet_col: str = "alphabet", keep: list[str] | None = None) -> DataFrame:
    """Rows that look like ordinary text but are stored otherwise: the columns ``keep``
    (default: all but the alphabet) and ``normal``, the ordinary form.  Garbled values,
    found as in :mod:`.encoding`, are no cases.  Ordinary values never leave the JVM.  Input
    columns named ``normal`` are left out of the default."""
    keep = keep if keep is not None else [c for c in values.columns if c not in (alphabet_col, "normal")]
    rest = F.expr(f"translate(regexp_replace({text_col}, '[\\\\x00-\\\\x7f]', ''), coalesce({alphabet_col}, ''), '')")
    # in a locale of another script, basic Latin beside its letters is suspect too
    both = F.col(text_col).rlike("[A-Za-z]") & F.col(text_col).rlike("[^\\x00-\\x7f]") & ~F.coalesce(F.col(alphabet_col), F.lit("")).rlike("[A-Za-z]{4}")
    src = values.where((F.length(rest) > 0) | both).select(*keep, F.col(text_col).cast("string").alias("__text"), F.coalesce(F.col(alphabet_col), F.lit("")).alias("__alphabet"), F.col(locale_col).cast("string").alias("__locale"))
    full = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keep).schema.fields] + ["normal string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], str | None] = {}
        for batch in batches:
            k = len(keep)
            texts, alphabets, locales = (batch.column(k + j).to_pylist() for j in range(3))
            rows, normal = [], []
            for r, (text, alphabet, locale) in enumerate(zip(texts, alphabets, locales)):
                key = (text, locale)
                if key not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    new = model.normal_form(text, locale)
                    if new is not None and (new == text or garbles(alphabet).label(text) is not None):
                        new = None
                    seen[key] = new
                if seen[key] is not None:
                    rows.append(r)
                    normal.append(seen[key])
            idx = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(idx) for c in batch.columns[:k]), pa.array(normal, pa.string())], names=[*keep, "normal"])

    return src.mapInArrow(run, full)
