"""Case of words, as Column expressions and as plain functions for Arrow kernels."""

from __future__ import annotations

from dataclasses import dataclass
from unicodedata import category

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: cased characters that are no letters Lu or Ll (ordinal signs, modifier letters, Roman numerals, circled letters).
_OTHER_UPPER = "\u2160-\u216f\u24b6-\u24cf"
_OTHER_LOWER = "\u00aa\u00ba\u02b0-\u02b8\u02c0\u02c1\u02e0-\u02e4\u0345\u037a\u1d2c-\u1d6a\u1d78\u1d9b-\u1dbf\u2071\u207f\u2090-\u209c\u2170-\u217f\u24d0-\u24e9"
_ALPHABETIC = "\\p{L}\\p{Nl}\u24b6-\u24e9"
UPPER, LOWER = rf"[\p{{Lu}}{_OTHER_UPPER}]", rf"[\p{{Ll}}{_OTHER_LOWER}]"
CASED = rf"[\p{{Lu}}\p{{Ll}}{_OTHER_UPPER}{_OTHER_LOWER}]"


def _count(word: Column, pattern: str) -> Column:
    return F.length(word) - F.length(F.regexp_replace(word, pattern, ""))


def case_class(word: Column) -> Column:
    """none, all_upper, mostly_upper, all_lower, first_upper or mixed; null for null.

    A lone capital has no class.  One small letter among at least four cased ones, in a
    word that opens with a capital, is taken for a slip in an all-caps word."""
    upper, lower = _count(word, UPPER), _count(word, LOWER)
    opens = F.regexp_extract(word, CASED, 0).rlike(UPPER)
    return (
        F.when(word.isNull(), F.lit(None))
        .when(upper + lower == 0, "none")
        .when(lower == 0, F.when(upper >= 2, "all_upper").otherwise("none"))
        .when(upper == 0, "all_lower")
        .when(~opens, "mixed")
        .when(upper == 1, "first_upper")
        .when((lower == 1) & (upper + lower >= 4), "mostly_upper")
        .otherwise("mixed")
    )


def is_all_caps(word: Column) -> Column:
    return case_class(word).isin("all_upper", "mostly_upper")


def is_first_caps(word: Column) -> Column:
    return case_class(word) == "first_upper"


def is_mixed_case(word: Column) -> Column:
    return case_class(word) == "mixed"


def starts_upper(word: Column) -> Column:
    return F.regexp_extract(word, CASED, 0).rlike(UPPER)


def lower_case(word: Column) -> Column:
    """Each character lowered by itself: no rule for a final sigma."""
    plain = F.lower(F.regexp_replace(word, "\u03a3", "\u03c3"))
    return plain


def upper_case(word: Column) -> Column:
    return F.upper(word)


def _first_letter(word: Column, change) -> Column:
    """``word`` with its first alphabetic character changed."""
    pattern = rf"(?s)^([^{_ALPHABETIC}]*)([{_ALPHABETIC}])(.*)$"
    parts = [F.regexp_extract(word, pattern, i) for i in (1, 2, 3)]
    return F.when(word.rlike(f"[{_ALPHABETIC}]"), F.concat(parts[0], change(parts[1]), parts[2])).otherwise(word)


def upper_first(word: Column) -> Column:
    return _first_letter(word, F.upper)


def lower_first(word: Column) -> Column:
    return _first_letter(word, lower_case)


def case_mutation(word: Column) -> Column:
    """How results for ``word`` are recased: all_caps, first_caps or none."""
    return F.when(is_all_caps(word), "all_caps").when(is_first_caps(word) | (is_mixed_case(word) & starts_upper(word)), "first_caps").otherwise("none")


def case_variants(word: Column) -> Column:
    """The other casings under which ``word`` is looked up, in order.

    An all-caps word: capitalised, then small; a mixed one: with its first letter
    raised, unless that makes it all caps; any other: small."""
    small = lower_case(word)
    capital = upper_first(small)
    raised = upper_first(word)
    return (
        F.when(is_mixed_case(word), F.when(case_class(raised) == "all_upper", F.array().cast("array<string>")).otherwise(F.array(raised)))
        .when(is_all_caps(word), F.array_distinct(F.array(capital, small)))
        .otherwise(F.array(small))
    )


# The same rules on Python strings.


def _is_upper(c: str) -> bool:
    return c.isupper()


@dataclass(frozen=True)
class Casing:
    """Lookup variants of a word, how its results are recased, and whether the first
    variant with results decides (mixed case) or all are merged."""

    variants: tuple[str, ...]
    mutation: str
    first_results: bool


def py_lower(word: str) -> str:
    return "".join(c.lower() for c in word)


def py_upper_first(word: str) -> str:
    for i, c in enumerate(word):
        if c.isalpha() or category(c) == "Nl" or "\u24b6" <= c <= "\u24e9":
            return word[:i] + c.upper() + word[i + 1 :]
    return word


def py_case_class(word: str) -> str:
    cased = [c for c in word if c.isupper() or c.islower()]
    upper = sum(map(_is_upper, cased))
    lower = len(cased) - upper
    if not lower:
        return "all_upper" if upper > 1 else "none"
    if not upper:
        return "all_lower"
    if not cased[0].isupper():
        return "mixed"
    return "first_upper" if upper == 1 else "mostly_upper" if lower == 1 and len(cased) > 3 else "mixed"


def casing(word: str) -> Casing:
    kind = py_case_class(word)
    if kind == "mixed":
        raised = py_upper_first(word)
        opens = next(c for c in word if c.isupper() or c.islower()).isupper()
        return Casing(() if py_case_class(raised) == "all_upper" else (raised,), "first_caps" if opens else "none", True)
    small = py_lower(word)
    if kind in ("all_upper", "mostly_upper"):
        return Casing(tuple(dict.fromkeys((py_upper_first(small), small))), "all_caps", False)
    return Casing((small,), "first_caps" if kind == "first_upper" else "none", False)


def recase(value: str, mutation: str) -> str:
    return value.upper() if mutation == "all_caps" else py_upper_first(value) if mutation == "first_caps" else value
