"""Vectorised pre-tokenisation: character classes, run boundaries and run hashes.

A block of texts is one array of code points.  Pre-tokens of the two public BPE
vocabularies are runs of equal character class, corrected at English
contractions and, for the byte-level vocabulary, at blanks that belong to the
run after them.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import regex

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: What may follow an apostrophe as a token of its own.
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")

_BASE = 0x9E3779B97F4A7C15
_PRIME = (1 << 31) - 1
_BASES = (1_316_218_561, 804_637_993)
_residues: list[tuple[np.ndarray, np.ndarray]] = []


@cache
def char_classes() -> np.ndarray:
    """Class of each code point, by the Unicode categories that the patterns use."""
    at = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    every = at.tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            out[at[m.start() : m.end()]] = kind
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, and the offset of each text (one more than texts)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, "<u4"), offsets


def token_spans(points: np.ndarray, offsets: np.ndarray, blanks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of a block.

    ``blanks``: white space is kept, and a single blank joins the run after it;
    else white space is dropped and every number character stands alone.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = char_classes()[points]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:n]
    cut = first.copy()
    cut[1:] |= kind[1:] != kind[:-1]
    if not blanks:
        cut |= kind == NUMBER
    quotes = np.flatnonzero((points == 39) & cut)
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[(kind[quotes + 1] == LETTER) & ~first[quotes + 1]]
    if blanks:
        before = np.maximum(quotes - 1, 0)
        quotes = quotes[first[quotes] | (quotes == 0) | (points[before] != 32)]
    # (the letters after it are looked at one by one: contractions are rare)
    moved = []
    for q in quotes.tolist():
        head = chr(points[q + 1])
        if head in ONE_LETTER:
            moved.append((q, 1))
        elif q + 2 < n and not first[q + 2] and head + chr(points[q + 2]) in TWO_LETTERS:
            moved.append((q, 2))
    for q, length in moved:
        cut[q + 1] = False
        if q + 1 + length < n:
            cut[q + 1 + length] = True
    if blanks:
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:])
        cut[last] = True
        joins = last[points[last] == 32]
        cut[joins + 1] = False
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    if not blanks:
        kept = kind[starts] != SPACE
        starts, ends = starts[kept], ends[kept]
    return starts, ends


_held: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``size`` of them; the longest made are kept."""
    if len(_held[0]) < size:
        length = 1 << max(16, (size - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(length, base, np.uint64)
            out[0] = 1
            _held[k] = np.multiply.accumulate(out)
    return _held[0], _held[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _lanes(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of two random bases and of their inverses modulo ``_PRIME``, at least ``size`` of each; the longest made are kept."""
    if len(_residues) < 2 or len(_residues[0][0]) < size:
        length = 1 << max(16, (size - 1).bit_length())
        _residues.clear()
        for base in _BASES:
            pair = []
            for b in (base, pow(base, -1, _PRIME)):
                out = np.ones(1, np.uint64)
                while len(out) < length:
                    out = np.concatenate([out, _modulo(out * np.uint64(pow(b, len(out), _PRIME)))])
                pair.append(out.astype(np.uint32))
            _residues.append(tuple(pair))
    return _residues


def _modulo(x: np.ndarray) -> np.ndarray:
    """Least residues modulo ``_PRIME`` of numbers under 2**63."""
    p, by = np.uint64(_PRIME), np.uint64(31)
    x = (x & p) + (x >> by)
    x = (x & p) + (x >> by)
    return np.where(x >= p, x - p, x)


class SpanHashes:
    """64-bit hashes of spans' contents, independent of their place.

    Two polynomials modulo a prime: no pair of contents collides whatever the
    base, as some do modulo a power of two.  Prefix sums are made once.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        p, by = np.uint64(_PRIME), np.uint64(31)
        plain = values.astype(np.uint64) + np.uint64(1)
        self.lanes = []
        for up, down in _lanes(n + 1):
            part = plain * up[:n]
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((part & p) + (part >> by), out=total[1:])
            self.lanes.append((total, down))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = (ends - starts).astype(np.uint64) << np.uint64(40)
        for k, (total, down) in enumerate(self.lanes):
            own = _modulo(_modulo(total[ends] - total[starts]) * down[starts])
            out = mixed(out ^ own) if k else out ^ (own << np.uint64(31))
        return out


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return SpanHashes(values).of(starts, ends)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each item, distinct hashes, first item of each code)."""
    codes, found = pd.factorize(hashes)
    where = np.empty(len(found), np.int64)
    where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, found, where


def flat_places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of some spans, one span after another."""
    stops = np.cumsum(sizes)
    return np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(starts - (stops - sizes), sizes)


def differing(sizes: np.ndarray, unequal: np.ndarray) -> np.ndarray:
    """Which spans hold a value that is unequal; ``unequal`` goes over all of them, one after another."""
    out = np.zeros(len(sizes), bool)
    wrong = np.flatnonzero(unequal)
    if len(wrong):
        out[np.unique(np.searchsorted(np.cumsum(sizes), wrong, side="right"))] = True
    return out


def distinct_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each span, first span of each code, its hash): equal codes for equal contents only.

    Codes come from hashes; every span is then held against the first of its
    code, value by value, and spans of a code that differ get codes of their own.
    """
    hashes = span_hashes(values, starts, ends)
    codes, _, where = distinct(hashes)
    codes = codes.astype(np.int64)
    size, first = ends - starts, where[codes]
    differs = size != size[first]
    again = np.flatnonzero((first != np.arange(len(codes))) & ~differs)
    at = flat_places(starts[again], size[again])
    other = np.repeat(starts[first[again]] - starts[again], size[again])
    other += at
    differs[again] = differing(size[again], values[at] != values[other])
    if differs.any():
        mixed_up = np.flatnonzero(np.isin(codes, codes[differs]))
        names: dict[bytes, int] = {}
        for i in mixed_up.tolist():
            name = values[starts[i] : ends[i]].tobytes()
            codes[i] = names.setdefault(name, len(where) + len(names))
        codes, found = pd.factorize(codes)
        where = np.empty(len(found), np.int64)
        where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, where, hashes[where]


class Flat:
    """Spans of numbers in one growing array."""

    def __init__(self, kind: type):
        self.data, self.used = np.empty(1 << 16, kind), 0
        self.starts, self.sizes, self.count = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Append spans that stand one after another in ``values``."""
        n, k = self.used + len(values), self.count + len(sizes)
        while n > len(self.data):
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        while k > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.empty_like(a)]) for a in (self.starts, self.sizes))
        self.data[self.used : n] = values
        self.starts[self.count : k] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.count : k] = sizes
        self.used, self.count = n, k

    def take(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of some spans, one after another; their sizes)."""
        sizes = self.sizes[slots]
        return self.data[flat_places(self.starts[slots], sizes)], sizes


class SpanCache:
    """Numbers of contents seen before: found by hash, then held against their values.

    A content whose hash another one holds is never found, and learned anew each time.
    """

    def __init__(self):
        self.hashes, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.held = Flat(np.uint32)

    def find(self, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each span's content, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.hashes):
            return out
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        slots = self.slots[at[hit]]
        same = self.held.sizes[slots] == sizes[hit]
        hit, slots = hit[same], slots[same]
        own = values[flat_places(starts[hit], sizes[hit])]
        right = ~differing(sizes[hit], own != self.held.take(slots)[0])
        out[hit[right]] = slots[right]
        return out

    def add(self, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Number new contents; returns the numbers."""
        numbers = self.held.count + np.arange(len(hashes))
        self.held.add(values[flat_places(starts, sizes)], sizes)
        fresh, first = np.unique(hashes, return_index=True)
        at = np.searchsorted(self.hashes, fresh)
        free = np.ones(len(fresh), bool)
        inside = at < len(self.hashes)
        free[inside] = self.hashes[at[inside]] != fresh[inside]
        self.hashes = np.insert(self.hashes, at[free], fresh[free])
        self.slots = np.insert(self.slots, at[free], numbers[first[free]])
        return numbers
