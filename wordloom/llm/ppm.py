"""Prediction by partial matching over bytes, with frozen statistics.

One variable-order context tree per language is counted from labelled
sentences.  Coding byte ``b`` after context ``c`` costs

* ``-log2 n(c,b) / (n(c)+d(c))`` when the tree has seen ``b`` after ``c``;
* otherwise the escape ``-log2 d(c) / (n(c)+d(c))`` (nothing if ``c`` itself is
  unseen) plus the cost of ``b`` after ``c`` without its first byte;
* ``log2 256`` below order 0.

(``n`` counts occurrences, ``d`` distinct successors: escape method C, without
exclusions.)  As the statistics never change while coding, each cost is a
function of the n-gram alone: the trees of all languages are flattened into one
hash table per order, and an n-gram that misses at one order adds the escapes of
its context and is looked up one order lower.  Each distinct full-order n-gram
of a text goes through that once; its costs are then kept in a memo, from which
whole buffers are scored with array lookups.  Costs are doubles throughout: none is
clipped or rounded.
"""

from __future__ import annotations

import uuid

import numpy as np

PAD = 10  # newline; the context before the first byte of a text
_MULT = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

# Digits carry no language and capitals little: both are folded before coding.
_FOLD = bytes(
    ord("0") if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 if b in (9, 13) else b
    for b in range(256)
)


def fold(data: bytes) -> bytes:
    """Map digits to 0, ASCII capitals to small letters, tabs to blanks."""
    return data.translate(_FOLD)


class _Table:
    """Open-addressed map from 64-bit keys to rows of doubles, filled and looked up in bulk."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, room: int = 0):
        """``rows``: one row a key; ``room``: keys that are to come."""
        self.bits = max(10, int(np.ceil(np.log2((len(keys) + room + 1) * 2.5))))
        self.keys = np.full((1 << self.bits) + 256, _EMPTY, np.uint64)
        self.rows = np.zeros((len(self.keys), rows.shape[1]))
        self.n, self.probes = 0, 1
        self.add(keys, rows)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> np.uint64(64 - self.bits)).view(np.int64)

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Insert keys that are distinct and not there yet."""
        todo, at = np.arange(len(keys)), self._home(keys)
        step = 0
        while len(todo):
            slot = at[todo] + step
            free = np.flatnonzero(self.keys[slot] == _EMPTY)
            _, first = np.unique(slot[free], return_index=True)
            take = free[first]
            self.keys[slot[take]] = keys[todo[take]]
            self.rows[slot[take]] = rows[todo[take]]
            stay = np.ones(len(todo), bool)
            stay[take] = False
            todo = todo[stay]
            step += 1
            if step > 200:
                raise OverflowError("the table is too full")
        self.probes = max(self.probes, step)
        self.n += len(keys)

    @property
    def room(self) -> int:
        return (1 << self.bits) // 2 - self.n

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, and which keys are absent (their slot is meaningless)."""
        at = self._home(keys)
        there = self.keys[at]
        todo = np.flatnonzero(there != keys)
        if not len(todo):
            return at, todo
        absent = [todo[there[todo] == _EMPTY]]
        todo = todo[there[todo] != _EMPTY]
        for step in range(1, self.probes):
            if not len(todo):
                break
            slot = at[todo] + step
            there = self.keys[slot]
            ok = there == keys[todo]
            at[todo[ok]] = slot[ok]
            absent.append(todo[there == _EMPTY])
            todo = todo[~ok & (there != _EMPTY)]
        absent.append(todo)
        return at, np.concatenate(absent)


def _grams(texts: list[str]) -> np.ndarray:
    """The eight bytes that end at each byte of the texts (and at the newline after each),
    the oldest lowest; what lies before a text is padding."""
    data = np.frombuffer(b"".join(bytes([PAD]) * 8 + fold(t.encode()) + b"\n" for t in texts) or bytes(8), np.uint8)
    words = np.ndarray((len(data) - 7,), np.uint64, data, 0, (1,))
    sizes = np.array([len(t.encode()) + 9 for t in texts], np.int64)
    place = np.arange(len(words)) + 7
    begin = np.cumsum(sizes) - sizes
    return words[place - np.repeat(begin, sizes)[7:] >= 8] if len(texts) else words[:0]


class PPM:
    """Frozen byte-level PPM models of several languages, scored together."""

    def __init__(self, samples: dict[str, list[str]], order: int = 5, memo: int = 1 << 19):
        """``samples``: sentences by language; ``order``: longest context (at most 6
        bytes); ``memo``: most n-grams whose costs are kept (a matter of speed only)."""
        if not 0 <= order <= 6:
            raise ValueError("order must be between 0 and 6")
        self.order, self.langs, self.memo_limit = order, sorted(samples), memo
        self.key = uuid.uuid4().hex
        n_lang = len(self.langs)
        grams = [_grams(samples[lang]) for lang in self.langs]
        lower_keys, lower = np.zeros(1, np.uint64), np.full((1, n_lang), 8.0)
        self.cost, self.escape = [], []
        for k in range(order + 1):
            # keys: the oldest byte lowest, the coded byte on top
            counted = [np.unique(g >> np.uint64(8 * (7 - k)), return_counts=True) for g in grams]
            keys = np.unique(np.concatenate([c[0] for c in counted] or [np.zeros(0, np.uint64)]))
            n = np.zeros((len(keys), n_lang))
            for l, (own, times) in enumerate(counted):
                n[np.searchsorted(keys, own), l] = times
            contexts, owner = np.unique(keys & np.uint64((1 << (8 * k)) - 1), return_inverse=True)
            total, kinds = np.zeros((len(contexts), n_lang)), np.zeros((len(contexts), n_lang))
            np.add.at(total, owner, n)
            np.add.at(kinds, owner, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(n / (total + kinds)[owner])
            shorter = np.searchsorted(lower_keys, keys >> np.uint64(8)) if k else np.zeros(len(keys), np.int64)
            cost = np.where(n > 0, seen, lower[shorter] + escape[owner])
            self.cost.append(_Table(keys, cost))
            self.escape.append(_Table(contexts, escape))
            lower_keys, lower = keys, cost

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each full-order n-gram (key) in each language."""
        out = np.zeros((len(keys), len(self.langs)))
        todo, k = np.arange(len(keys)), self.order
        while len(todo):
            w = keys[todo] >> np.uint64(8 * (self.order - k))
            at, absent = self.cost[k].find(w)
            hit = np.ones(len(todo), bool)
            hit[absent] = False
            out[todo[hit]] += self.cost[k].rows[at[hit]]
            todo, w = todo[~hit], w[~hit]
            at, absent = self.escape[k].find(w & np.uint64((1 << (8 * k)) - 1))
            seen = np.ones(len(todo), bool)
            seen[absent] = False
            out[todo[seen]] += self.escape[k].rows[at[seen]]
            if k == 0:
                out[todo] += 8.0
                break
            k -= 1
        return out

    def __reduce__(self):
        # a worker that has these models already keeps them, with the memo it has filled
        return _restored, (self.key, {k: v for k, v in self.__dict__.items() if k != "memo"})

    def code_lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits per segment and language.  ``data``: folded bytes, beginning with 8
        pad bytes; ``starts``: ascending segment starts (the first at 8 or later);
        a segment ends where the next begins, the last at the end of the data."""
        if not len(starts):
            return np.zeros((0, len(self.langs)))
        if getattr(self, "memo", None) is None:
            self.memo = _Table(np.zeros(0, np.uint64), np.zeros((0, len(self.langs))))
        # the eight bytes that end at each position, then those of the n-gram
        words = np.ndarray((len(data) - 8,), np.uint64, data, 1, (1,)) >> np.uint64(8 * (7 - self.order))
        at, absent = self.memo.find(words)
        over = None
        if len(absent):
            new = np.unique(words[absent])
            fits = self.memo.n + len(new) <= self.memo_limit
            if fits and len(new) > self.memo.room:
                used = self.memo.keys != _EMPTY
                self.memo = _Table(self.memo.keys[used], self.memo.rows[used], 2 * (self.memo.n + len(new)))
            if fits:
                self.memo.add(new, self.costs(new))
                at, absent = self.memo.find(words)
            if len(absent):
                over = self.costs(new)[np.searchsorted(new, words[absent])]
        rows = self.memo.rows.take(at, axis=0)
        if over is not None:
            rows[absent] = over
        return np.add.reduceat(rows, starts - 8, axis=0)


_KEPT: dict[str, PPM] = {}


def _restored(key: str, state: dict) -> PPM:
    if key not in _KEPT:
        _KEPT.clear()
        model = PPM.__new__(PPM)
        model.__dict__.update(state)
        _KEPT[key] = model
    return _KEPT[key]
