"""BPE encoding by speculate and verify, and decoding.

Per distinct word a greedy longest match proposes tokens.  A sequence is what
merging would give exactly if no two neighbouring tokens would have merged
across their boundary; that is tested for all distinct neighbour pairs at once
(``MergeTable.compatible``).  Only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .pretoken import Flat, SpanCache, code_points, distinct_spans, token_spans

END = "</w>"
NONE = np.int64(1 << 40)
#: Words of up to ``WIDE`` symbols are merged side by side, ``ROWS`` at a time.
WIDE, ROWS = 48, 2048


@cache
def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte (code point -> character)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeTable:
    """Vocabulary and merges as arrays, for the pair test and for exact merging."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        size = max(vocab.values()) + 1
        self.rank = np.full(size, -1, np.int64)
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pairs.setdefault((x, y), (rank, z))
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = rank, x, y
        keys = np.asarray([(x << 20) | y for x, y in self.pairs], np.int64)
        order = np.argsort(keys)
        self._keys = keys[order]
        self._ranks, self._made = (np.asarray(v, np.int64)[order] for v in zip(*self.pairs.values(), strict=True))
        own = np.flatnonzero(self.rank >= 0)
        good = self.compatible(self.left[own], self.right[own], own=True)
        self.reachable = np.ones(size, bool)
        self.reachable[own[~good]] = False
        for t in own[np.argsort(self.rank[own])]:
            self.reachable[t] &= self.reachable[self.left[t]] and self.reachable[self.right[t]]

    def pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self._pair(x, y)[0]

    def _pair(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``NONE`` without a merge), and the token it makes."""
        key = (x << 20) | y
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NONE), self._made[at]

    def compatible(self, a: np.ndarray, b: np.ndarray, own: bool = False) -> np.ndarray:
        """Whether merging never crosses the boundary between tokens a and b.

        Seen backwards in time: both tokens stand at the end; undoing the later
        of their last merges gives the pair that stood at the boundary before,
        until both are single characters.  A pair that stood there and has a
        merge of lower rank than those that ended it (at equal ranks the left
        one goes first) would have merged.  ``own``: the merge of the two tokens
        themselves is allowed.
        """
        r, l = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        end_r = np.full(len(r), NONE)
        end_l = np.full(len(l), NONE)
        good = np.ones(len(r), bool)
        live = np.arange(len(r))
        top = own
        while len(live):
            x, y = r[live], l[live]
            if not top:
                q = self.pair_rank(x, y)
                crossed = (q < end_r[live]) & (q <= end_l[live]) & (q < NONE)
                good[live[crossed]] = False
                live, x, y = live[~crossed], x[~crossed], y[~crossed]
            top = False
            rx, ry = self.rank[x], self.rank[y]
            more = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = live[more], x[more], y[more], rx[more], ry[more]
            of_left = rx > ry
            u, v = live[of_left], live[~of_left]
            end_r[u], r[u] = rx[of_left], self.right[x[of_left]]
            end_l[v], l[v] = ry[~of_left], self.left[y[~of_left]]
        return good

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: lowest rank first, then leftmost."""
        n = len(ids)
        ids = list(ids)
        after = [*range(1, n), -1]
        before = [-1, *range(n - 1)]
        heap = []
        pairs = self.pairs
        for i in range(n - 1):
            if found := pairs.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = z, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := pairs.get((z, ids[k])):
                    heapq.heappush(heap, (found[0], i, z, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := pairs.get((ids[h], z))):
                heapq.heappush(heap, (found[0], h, ids[h], z, found[1]))
        return [t for t in ids if t >= 0]


    def merge_all(self, words: list[list[int]]) -> list[list[int]]:
        """``merge`` of many words: a round merges the lowest, leftmost pair of each."""
        out: list[list[int]] = [[] for _ in words]
        size = np.asarray([len(w) for w in words])
        for i in np.flatnonzero(size > WIDE).tolist():
            out[i] = self.merge(words[i])
        short = np.flatnonzero(size <= WIDE)
        short = short[np.argsort(size[short], kind="stable")]
        for a in range(0, len(short), ROWS):
            rows = short[a : a + ROWS]
            wide = int(size[rows].max()) + 1
            ids = np.full((len(rows), wide), -1, np.int64)
            for k, i in enumerate(rows.tolist()):
                ids[k, : size[i]] = words[i]
            rank, made = self._pair(ids[:, :-1], ids[:, 1:])
            every = np.arange(wide)
            while len(rows):
                at = rank.argmin(1)
                line = np.arange(len(rows))
                go = rank[line, at] < NONE
                if not go.all():
                    for i, left in zip(rows[~go].tolist(), ids[~go].tolist(), strict=True):
                        out[i] = left[: left.index(-1)]
                    rows, ids, rank, made, at = rows[go], ids[go], rank[go], made[go], at[go]
                    line = line[: len(rows)]
                    if not len(rows):
                        break
                ids[line, at] = made[line, at]
                shifted = np.minimum(every + (every > at[:, None]), wide - 1)
                ids = np.take_along_axis(ids, shifted, 1)
                rank = np.take_along_axis(rank, shifted[:, :-1].clip(max=wide - 2), 1)
                made = np.take_along_axis(made, shifted[:, :-1].clip(max=wide - 2), 1)
                for spot in (np.maximum(at - 1, 0), at):
                    rank[line, spot], made[line, spot] = self._pair(ids[line, spot], ids[line, spot + 1])
        return out


class WordBpe:
    """Encoder and decoder of a word BPE file (lower case, white space dropped, word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.table = MergeTable(vocab, merges)
        self.specials = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        usable = self.table.reachable
        self.inner = {t: i for t, i in vocab.items() if usable[i] and not t.endswith(END)}
        self.final = {t[: -len(END)]: i for t, i in vocab.items() if usable[i] and t.endswith(END)}
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.reach: dict[str, int] = {}  # the longest inner token by its first three characters
        for t in self.inner:
            if len(t) > 2:
                self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 0))
        self.exact = 0
        self.words = 0

    def pieces(self, word: str) -> str:
        """A word as the vocabulary's characters, one a byte."""
        raw = word.encode("utf-8", "surrogatepass").decode("latin-1")
        return raw.translate(self.letters)

    def _greedy(self, s: str) -> list[int] | None:
        out, i, n, inner, final, longest, reach = [], 0, len(s), self.inner, self.final, self.longest, self.reach
        while i < n:
            if n - i <= longest and (t := final.get(s[i:])) is not None:
                out.append(t)
                return out
            for j in range(min(n - 1, i + reach.get(s[i : i + 3], 2)), i, -1):
                if (t := inner.get(s[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                return None
        return out

    def _symbols(self, s: str) -> list[int]:
        vocab = self.table.vocab
        return [vocab[c] for c in (*s[:-1], s[-1] + END) if c in vocab]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each (normalised, non-empty) word."""
        spelled = [self.pieces(w) if not w.isascii() else w for w in words]
        spelled = [s if s.isprintable() and " " not in s else s.translate(self.letters) for s in spelled]
        guesses = [self._greedy(s) for s in spelled]
        lengths = np.asarray([len(g) if g else 0 for g in guesses], np.int64)
        flat = np.fromiter((t for g in guesses if g for t in g), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        keys, back = np.unique((flat[inside] << 20) | flat[inside + 1], return_inverse=True)
        good = self.table.compatible(keys >> 20, keys & ((1 << 20) - 1))
        failed = np.zeros(len(words), bool)
        failed[owner[inside[~good[back]]]] = True
        failed |= np.asarray([g is None for g in guesses], bool)
        exact = np.flatnonzero(failed).tolist()
        for i, ids in zip(exact, self.table.merge_all([self._symbols(spelled[i]) for i in exact]), strict=True):
            guesses[i] = ids
        self.exact += int(failed.sum())
        self.words += len(words)
        return guesses

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one blank, as the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def normalised(text: str) -> str:
    """Canonical composition, then lower case character by character."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class TextEncoder:
    """Encode whole texts through a cache of distinct words.

    The cache maps words to their tokens.  It is emptied when its words hold
    ``max_chars`` characters, so memory is bounded by that and one block.
    """

    def __init__(self, bpe: WordBpe, max_chars: int = 4_000_000):
        self.bpe, self.max_chars = bpe, max_chars
        self._clear()

    def _clear(self) -> None:
        self.words, self.ids, self.decoded = SpanCache(), Flat(np.uint8), Flat(np.uint8)
        self.counts = Flat(np.int64)

    def _learn(self, words: list[str]) -> None:
        names = self.bpe.tokens
        coded = self.bpe.encode_words(words)
        for held, strings in ((self.ids, [" ".join(map(str, ids)) for ids in coded]), (self.decoded, [" ".join([names[i] for i in ids]) for ids in coded])):
            raw = [s.encode("utf-8", "surrogatepass") for s in strings]
            held.add(np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw)))
        self.counts.add(np.fromiter(map(len, coded), np.int64, len(coded)), np.ones(len(coded), np.int64))

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Number of tokens, ids and decoded text of each text."""
        lowered = [normalised(t) for t in texts]
        points, offsets = code_points(lowered)
        starts, ends = token_spans(points, offsets, blanks=False)
        codes, where, hashes = distinct_spans(points, starts, ends)
        if self.words.held.used > self.max_chars:
            self._clear()
        first, last = starts[where], ends[where]
        slots = self.words.find(points, first, last - first, hashes)
        new = np.flatnonzero(slots < 0)
        if len(new):
            joined = "".join(lowered)
            self._learn([joined[a:b] for a, b in zip(first[new].tolist(), last[new].tolist(), strict=True)])
            slots[new] = self.words.add(points, first[new], last[new] - first[new], hashes[new])
        sizes = self.counts.data[slots][codes] if len(codes) else np.zeros(0, np.int64)
        edges = np.searchsorted(starts, offsets)
        totals = np.diff(np.concatenate([[0], np.cumsum(sizes)])[edges])
        if not sizes.all():  # words without a token leave no blank either
            edges = np.concatenate([[0], np.cumsum(sizes > 0)])[edges]
            codes = codes[sizes > 0]
        out = []
        for held in (self.ids, self.decoded):
            raw, lengths = held.take(slots)
            ends_ = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            each = pa.StringArray.from_buffers(len(slots), pa.py_buffer(ends_), pa.py_buffer(raw)).take(pa.array(codes))
            out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), each), " "))
        return totals, *out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Number of tokens, ids joined by a blank, and decoded text of each text."""
        specials = self.bpe.specials
        special = [d for d, t in enumerate(texts) if "<|" in t and any(s in t for s in specials)]
        coded = self._plain(["" if d in special else t for d, t in enumerate(texts)] if special else texts)
        if not special:
            return coded
        counts, ids, decoded = coded[0].copy(), coded[1].to_pylist(), coded[2].to_pylist()
        for d in special:
            pieces = _split_specials(texts[d], specials)
            own = list(zip(*(c.tolist() for c in self._plain([p for p in pieces if p not in specials])), strict=True))[::-1]
            got = [(1, str(specials[p]), p) if p in specials else own.pop() for p in pieces]
            got = [g for g in got if g[0]]
            counts[d] = sum(g[0] for g in got)
            ids[d], decoded[d] = (" ".join(g[k] for g in got) for k in (1, 2))
        return counts, *(pa.array(c, pa.string()) for c in (ids, decoded))


def _split_specials(text: str, specials: dict[str, int]) -> list[str]:
    """The text around special strings, and those strings."""
    return [p for p in re.split("(" + "|".join(map(re.escape, specials)) + ")", text) if p]
