"""Word boundaries of Unicode (UAX 29) over Arrow string arrays, a batch at a time.

The rules look at no more than the classes of two neighbours on either side once
characters that extend others are set aside, so all boundaries of a batch come from a
handful of numpy passes over its code points: nothing recurses and nothing depends on the
length of a word.  Hyphens count as MidLetter, and a caller's alphabet as letters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

(OTHER, CR, LF, NEWLINE, EXTEND, FORMAT, ZWJ, REGIONAL, KATAKANA, HEBREW, LETTER, SINGLE, DOUBLE, MID_BOTH, MID_LETTER, MID_NUMBER, NUMERIC, LINK) = range(18)
#: Names of the Word_Break property's values.
_PROPERTY = {"CR": CR, "LF": LF, "Newline": NEWLINE, "Extend": EXTEND, "Format": FORMAT, "ZWJ": ZWJ, "Regional_Indicator": REGIONAL, "Katakana": KATAKANA, "Hebrew_Letter": HEBREW, "ALetter": LETTER, "Single_Quote": SINGLE, "Double_Quote": DOUBLE, "MidNumLet": MID_BOTH, "MidLetter": MID_LETTER, "MidNum": MID_NUMBER, "Numeric": NUMERIC, "ExtendNumLet": LINK}
#: Hyphens, which join letters here.
HYPHENS = "-‐‑﹣－"
#: Bytes of text worked on at once.
CHUNK = 1 << 21


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, whether alphabetic or a number, and whether a pictograph, by code point."""
    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))

    def marked(table: np.ndarray, pattern: str, value: int) -> None:
        for m in regex.finditer(pattern, points):
            lo, hi = (x if x < 0xD800 else x + 0x800 for x in (m.start(), m.end() - 1))
            table[lo : hi + 1] = value

    classes, wordy, picture = (np.zeros(0x110000, np.uint8) for _ in range(3))
    for name, value in _PROPERTY.items():
        marked(classes, rf"\p{{WB={name}}}+", value)
    classes[[ord(c) for c in HYPHENS]] = MID_LETTER
    marked(wordy, r"[\p{Alphabetic}\p{N}]+", 1)
    marked(picture, r"\p{ExtPict}+", 1)
    return classes, wordy, picture


@lru_cache(maxsize=1)
def _joins() -> np.ndarray:
    """Pairs of classes that always hold together."""
    join = np.zeros((18, 18), bool)
    join[CR, LF] = True
    letters = (LETTER, HEBREW)
    for a in letters:
        for b in (*letters, NUMERIC, LINK):
            join[a, b] = True
    for b in (*letters, NUMERIC, LINK):
        join[NUMERIC, b] = True
    for b in (KATAKANA, LINK):
        join[KATAKANA, b] = True
    for b in (*letters, NUMERIC, KATAKANA, LINK):
        join[LINK, b] = True
    join[HEBREW, SINGLE] = True
    return join


@lru_cache(maxsize=16)
def _classes(alphabet: str) -> np.ndarray:
    classes = _tables()[0]
    if alphabet:
        classes = classes.copy()
        classes[[ord(c) for c in alphabet]] = LETTER
    return classes


@dataclass(frozen=True)
class Segments:
    """All segments of a run of texts: byte places in ``data``, the text each is of, and
    whether it holds a letter or number."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    wordy: np.ndarray


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each begins."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[lead].astype(np.int32)
    for floor, keep, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        longer = np.flatnonzero(points >= floor) if more == 1 else longer[data[lead[longer]] >= floor]  # noqa: F821
        if not len(longer):
            break
        at = lead[longer]
        value = data[at].astype(np.int32) & keep
        for j in range(1, more + 1):
            value = (value << 6) | (data[np.minimum(at + j, len(data) - 1)] & 0x3F)
        points[longer] = value
    return points, lead


def segments(data: np.ndarray, offsets: np.ndarray, alphabet: str = "") -> Segments:
    """Segments of the texts that ``offsets`` cut out of UTF-8 ``data``."""
    points, lead = _code_points(data)
    n = len(points)
    if not n:
        none = np.zeros(0, np.int64)
        return Segments(data, none, none, none, np.zeros(0, bool))
    classes = _classes(alphabet)[points]
    _, wordy, picture = _tables()
    filled = offsets[:-1][np.diff(offsets) > 0]
    opens = np.zeros(n, bool)
    opens[np.searchsorted(lead, filled)] = True
    # characters that extend the one before, unless nothing is before them
    extends = (classes == EXTEND) | (classes == FORMAT) | (classes == ZWJ)
    lines = (classes >= CR) & (classes <= NEWLINE)
    after_line = np.concatenate([[True], lines[:-1]]) | opens
    base = np.flatnonzero(~extends | after_line)
    c = classes[base]
    c[extends[base]] = OTHER
    fresh = opens[base]

    def at(shift: int) -> np.ndarray:
        """Classes of the base characters before (or after) each; OTHER beyond the text."""
        out = np.zeros(len(c), np.uint8)
        if shift < 0:
            out[-shift:] = c[:shift]
            for k in range(-shift):
                out[k:][fresh[: len(c) - k]] = OTHER
        else:
            out[:-shift] = c[shift:]
            out[:-shift][fresh[shift:]] = OTHER
        return out

    before, two_before, after = at(-1), at(-2), at(1)
    letter = lambda x: (x == LETTER) | (x == HEBREW)
    mid_letter = lambda x: (x == MID_LETTER) | (x == MID_BOTH) | (x == SINGLE)
    mid_number = lambda x: (x == MID_NUMBER) | (x == MID_BOTH) | (x == SINGLE)
    join = _joins()[before, c]
    join |= letter(before) & mid_letter(c) & letter(after)
    join |= letter(two_before) & mid_letter(before) & letter(c)
    join |= (before == HEBREW) & (c == DOUBLE) & (after == HEBREW)
    join |= (two_before == HEBREW) & (before == DOUBLE) & (c == HEBREW)
    join |= (two_before == NUMERIC) & mid_number(before) & (c == NUMERIC)
    join |= (before == NUMERIC) & mid_number(c) & (after == NUMERIC)
    flags = c == REGIONAL
    if flags.any():
        place = np.arange(len(c))
        first = np.maximum.accumulate(np.where(~flags | (before != REGIONAL), place, 0))
        join |= flags & ((place - first) % 2 == 1)
    # a pictograph right after a joiner
    join |= picture[points[base]].astype(bool) & (classes[np.maximum(base - 1, 0)] == ZWJ)
    cuts = base[~join | fresh]
    start = lead[cuts].astype(np.int64)
    end = np.append(start[1:], len(data))
    owner = np.searchsorted(offsets, start, side="right") - 1
    return Segments(data, start, end, owner, np.add.reduceat(wordy[points], cuts, dtype=np.int64) > 0)


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string array; nulls are empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _pieces(texts: pa.Array, alphabet: str):
    """(rows, their segments) in pieces of bounded bytes, a long text by itself."""
    data, offsets = _buffer(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        own = offsets[at : end + 1]
        yield end - at, own - own[0], segments(data[own[0] : own[-1]], own - own[0], alphabet)
        at = end


def _listed(texts: pa.Array, counts: list[np.ndarray], values: pa.Array) -> pa.Array:
    """List array of ``values`` with the given counts; null where the text is null."""
    total = np.concatenate([[0], np.cumsum(np.concatenate(counts or [np.zeros(0, np.int64)]))])
    mask = texts.is_null() if texts.null_count else None
    return pa.ListArray.from_arrays(pa.array(total, pa.int32()), values, mask=mask)


def _cut_out(s: Segments, chosen: np.ndarray) -> pa.Array:
    """The chosen segments as strings."""
    flags = np.zeros(2 * len(chosen) + 1, bool)
    flags[1::2] = True
    edges = np.empty(2 * len(chosen) + 2, np.int64)
    edges[0], edges[-1] = 0, len(s.data)
    edges[1:-1:2], edges[2:-1:2] = s.start[chosen], s.end[chosen]
    inside = np.repeat(flags, np.diff(edges))
    size = np.concatenate([[0], np.cumsum(s.end[chosen] - s.start[chosen])])
    return pa.LargeStringArray.from_buffers(len(chosen), pa.py_buffer(size.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(s.data[inside])))


def _counts(s: Segments, chosen: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(s.text[chosen], minlength=rows)


def list_words(texts: pa.Array, alphabet: str = "") -> pa.Array:
    counts, parts = [], []
    for rows, _, s in _pieces(texts, alphabet):
        chosen = np.flatnonzero(s.wordy)
        counts.append(_counts(s, chosen, rows))
        parts.append(_cut_out(s, chosen).cast(pa.string()))
    return _listed(texts, counts, pa.concat_arrays(parts) if parts else pa.array([], pa.string()))


def list_indices(texts: pa.Array, alphabet: str = "", *, every: bool = False) -> pa.Array:
    """Words (or, with ``every``, all segments) with byte offsets."""
    counts, idx, word = [], [], []
    for rows, offsets, s in _pieces(texts, alphabet):
        chosen = np.arange(len(s.start)) if every else np.flatnonzero(s.wordy)
        counts.append(_counts(s, chosen, rows))
        idx.append(s.start[chosen] - offsets[s.text[chosen]])
        word.append(_cut_out(s, chosen).cast(pa.string()))
    values = pa.StructArray.from_arrays([pa.array(np.concatenate(idx or [np.zeros(0, np.int64)]), pa.int64()), pa.concat_arrays(word) if word else pa.array([], pa.string())], names=["idx", "word"])
    return _listed(texts, counts, values)


def list_starts(texts: pa.Array, alphabet: str = "") -> pa.Array:
    """Byte offsets of the words alone."""
    counts, idx = [], []
    for rows, offsets, s in _pieces(texts, alphabet):
        chosen = np.flatnonzero(s.wordy)
        counts.append(_counts(s, chosen, rows))
        idx.append(s.start[chosen] - offsets[s.text[chosen]])
    return _listed(texts, counts, pa.array(np.concatenate(idx or [np.zeros(0, np.int64)]), pa.int64()))


def count_words(texts: pa.Array, alphabet: str = "") -> pa.Array:
    counts = [_counts(s, np.flatnonzero(s.wordy), rows) for rows, _, s in _pieces(texts, alphabet)]
    mask = texts.is_null().to_numpy(zero_copy_only=False) if texts.null_count else None
    return pa.array(np.concatenate(counts or [np.zeros(0, np.int64)]), pa.int64(), mask=mask)
