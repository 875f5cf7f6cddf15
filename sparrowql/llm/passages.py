"""Words with their places, seeds of known passages, and banded alignment.

Shared by the operators that look for known passages. Texts without a word have
no place, repeated passages and words are found each, and of places that are
equally good the first is taken.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np

WORD = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)


def lowered(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def words(text: str) -> list[str]:
    return WORD.findall(lowered(text))


def word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in WORD.finditer(lowered(text))]


class Vocabulary:
    """Numbers, from 1, for the words of known passages; 0 for every other word."""

    def __init__(self, passages: list[list[str]]):
        self.ids: dict[str, int] = {}
        for p in passages:
            for w in p:
                self.ids.setdefault(w, len(self.ids) + 1)

    def encode(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, tokens, repeat(0)), np.int64, len(tokens))


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k numbers."""
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    v = x.astype(np.uint64)
    for i in range(k):
        h = (h ^ v[i : i + n]) * _P
        h ^= h >> np.uint64(31)
    return h


class Seeds:
    """An inverted index from gram hashes to (passage, offset of the gram)."""

    def __init__(self, entries: list[tuple[int, int, int]], k: int):
        """entries: (hash, passage, offset)."""
        self.k = k
        entries = sorted(entries)
        self.hashes = np.array([e[0] for e in entries], np.uint64)
        self.passage = np.array([e[1] for e in entries], np.int64)
        self.offset = np.array([e[2] for e in entries], np.int64)

    def starts(self, x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, passage, start of the passage in the text) that grams point to, and how many do.

        ``x``: word numbers of texts, each followed by a 0; ``ends``: where each ends in x.
        """
        if len(x) < self.k or not len(self.hashes):
            return np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        known = x > 0
        run = known[: len(x) - self.k + 1].copy()
        for i in range(1, self.k):
            run &= known[i : i + len(run)]
        at = np.flatnonzero(run)
        h = np.full(len(at), self.k, np.uint64)
        v = x.astype(np.uint64)
        for i in range(self.k):
            h = (h ^ v[at + i]) * _P
            h ^= h >> np.uint64(31)
        low = np.searchsorted(self.hashes, h)
        some = self.hashes[np.minimum(low, len(self.hashes) - 1)] == h
        at, low = at[some], low[some]
        n = np.searchsorted(self.hashes, h[some], side="right") - low
        entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = np.repeat(at, n)
        text = np.searchsorted(ends, at, side="right")
        begin = np.concatenate([[0], ends + 1])[text]
        found = np.stack([text, self.passage[entry], at - self.offset[entry] - begin], axis=1)
        return np.unique(found, axis=0, return_counts=True)


def joined(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' word numbers, each text followed by a 0, and where each ends."""
    zero = np.zeros(1, np.int64)
    ends = np.cumsum([len(c) + 1 for c in codes]) - 1
    return np.concatenate([part for c in codes for part in (c, zero)]) if codes else zero[:0], ends


def part_of(code: np.ndarray, start: int, end: int) -> np.ndarray:
    """Words start to end of a text, -1 outside it."""
    out = np.full(end - start, -1, np.int64)
    first, last = max(start, 0), min(end, len(code))
    if last > first:
        out[first - start : last - start] = code[first:last]
    return out


def fit_distances(items: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Word edit distance of each item to the best piece of its part, within a band.

    Rows belong together. A part has ``2 * band`` words more than its item; an
    alignment may start at its words 0 to 2 * band, and only these diagonals are
    computed. So every distance up to ``band`` from the middle one is exact, and
    no distance is too small.
    """
    n, width = items.shape[1], parts.shape[1] - items.shape[1] + 1
    step = np.arange(width, dtype=np.int32)
    row = np.zeros((len(items), width), np.int32)
    for i in range(n):
        new = row + (parts[:, i : i + width] != items[:, i : i + 1])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])  # an item's word is left out
        row = np.minimum.accumulate(new - step, axis=1) + step  # words of the part are left out
    return row.min(axis=1)


def align(item: np.ndarray, code: np.ndarray, low: int, high: int) -> tuple[int, list[int], int, int]:
    """(distance, matched positions, start, end) of the best fit of item in a text, on diagonals low to high.

    A diagonal is the position of an alignment less that in the item.
    """
    n, width = len(item), high - low + 1
    around = part_of(code, low, high + n)
    step = np.arange(width, dtype=np.int32)
    rows = np.zeros((n + 1, width), np.int32)
    for i in range(n):
        new = rows[i] + (around[i : i + width] != item[i])
        np.minimum(new[:-1], rows[i, 1:] + 1, out=new[:-1])
        rows[i + 1] = np.minimum.accumulate(new - step) + step
    d = int(rows[n].argmin())
    distance, end, i, matched = int(rows[n, d]), n + low + d, n, []
    while i:
        same = around[i - 1 + d] == item[i - 1]
        if rows[i, d] == rows[i - 1, d] + (not same):
            i -= 1
            if same:
                matched.append(i + low + d)
        elif d + 1 < width and rows[i, d] == rows[i - 1, d + 1] + 1:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return distance, matched[::-1], low + d, end
