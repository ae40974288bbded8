"""Elias-Fano sequences and an n-gram trie made of them, in one flat buffer that may be a memory map.

All look-ups take arrays of queries. Levels of the trie: word fingerprints; first words; pairs; triples. A pair is stored as
(number of its first word) * words + (rank of its second), a triple as (number of its pair) * words + rank: with the
context's number in front, a level ascends as a whole, and a word is sought by its successor among the children of its
context alone, whose range the pointers give.
"""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np

#: Codes to the factor of two, from 1 on; code 0 is a probability of 0.
STEP = 10
ONE = np.uint64(1)
#: Look-ups that are worked through together, so that what they need stays in a processor's cache.
BLOCK = 1 << 14


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after another, each with its type and length, aligned to eight bytes."""
    out = [struct.pack("<q", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [struct.pack("<8sq", a.dtype.str.encode(), len(a)), a.tobytes(), b"\0" * (-a.nbytes % 8)]
    return b"".join(out)


def unpack(buffer) -> list[np.ndarray]:
    """The same arrays as views of the buffer; nothing is copied."""
    (n,), at, out = struct.unpack_from("<q", buffer, 0), 8, []
    for _ in range(n):
        kind, length = struct.unpack_from("<8sq", buffer, at)
        a = np.frombuffer(buffer, np.dtype(kind.rstrip(b"\0").decode()), length, at + 16)
        at += 16 + a.nbytes + -a.nbytes % 8
        out.append(a)
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Unsigned integers in the smallest type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def ranked(x: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(distinct numbers, ascending; the place of each x among them, in 32 bits; sums of n for each of them)."""
    order = np.argsort(x)
    own = x[order]
    new = np.ones(len(x), bool)
    new[1:] = own[1:] != own[:-1]
    own, of = own[new], np.empty(len(x), np.uint32)
    of[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    if n is None:
        return own, of, None
    return own, of, np.add.reduceat(n[order], np.nonzero(new)[0], dtype=np.int64) if len(x) else np.zeros(0, np.int64)


def codes(p: np.ndarray) -> np.ndarray:
    """Probabilities as bytes, rounded down; below 2 ** -25.4 they count as 0."""
    with np.errstate(divide="ignore"):
        c = np.ceil(-np.log2(p) * STEP - 1e-9) + 1
    return np.where(c <= 255, c, 0).astype(np.uint8)


def values(c: np.ndarray) -> np.ndarray:
    return _VALUES[c]


_VALUES = np.concatenate([[0.0], 2.0 ** (-np.arange(255) / STEP)])


class EliasFano:
    """An ascending sequence of n integers below a bound, in about 2 + log2(bound / n) bits each."""

    PIECES = 4

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.head, self.low, self.high, self.ones = head, low, high, ones
        self.n, self.width = int(head[0]), np.uint64(head[1])
        self.mask = (ONE << self.width) - ONE

    @classmethod
    def of(cls, x: np.ndarray, bound: int) -> EliasFano:
        """``ones[k]``: how many bits are set before the k-th word of ``high``."""
        x, n = x.astype(np.uint64), len(x)
        width = max(0, (max(1, bound) // max(1, n)).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width:
            part = x & ((ONE << np.uint64(width)) - ONE)
            at = np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            first = np.nonzero(np.diff(word, prepend=-1))[0]
            low[word[first]] = np.bitwise_or.reduceat(part << shift, first) if n else 0
            over = shift + np.uint64(width) > 64  # at most one number goes on in each next word
            low[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        bits = np.zeros(-(-(n + (bound >> width) + 2) // 64) * 64, np.uint8)
        bits[(x >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]]).astype(np.uint32)
        return cls(np.array([n, width], np.int64), low, high, ones)

    def arrays(self) -> list[np.ndarray]:
        return [self.head, self.low, self.high, self.ones]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * self.width
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        upper = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (self.low[word] >> shift | upper) & self.mask

    @staticmethod
    def _inside(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the set bit with ``rank`` set bits below it, by halves."""
        at = np.zeros(len(word), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(word & ((ONE << np.uint64(half)) - ONE)).astype(np.int64)
            on = rank >= below
            word, rank, at = np.where(on, word >> np.uint64(half), word), np.where(on, rank - below, rank), at + half * on
        return at

    def _one(self, i: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.ones, i, side="right") - 1
        return 64 * k + self._inside(self.high[k], i - self.ones[k])

    @cached_property
    def _zeros(self) -> np.ndarray:
        return 64 * np.arange(len(self.ones)) - self.ones

    def _zero(self, i: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self._zeros, i, side="right") - 1
        return 64 * k + self._inside(~self.high[k], i - self._zeros[k])

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        i = np.asarray(i, np.int64)
        return ((self._one(i) - i).astype(np.uint64) << self.width) | self._low(i)

    def find(self, x: np.ndarray, start: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """Place of x in [start, end), -1 where it is not: the successor of x there, if it is x."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        x = x.astype(np.uint64)
        h = (x >> self.width).astype(np.int64)
        known = h < 64 * len(self.high) - int(self.ones[-1]) - int(np.bitwise_count(self.high[-1]))
        h = np.where(known, h, 0)
        lo = np.maximum(np.where(h > 0, self._zero(np.maximum(h - 1, 0)) - (h - 1), 0), start)
        hi = np.minimum(self._zero(h) - h, self.n if end is None else end)
        stop, want = hi.copy(), x & self.mask
        open_ = np.nonzero(lo < hi)[0]
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        hit = known & (lo < stop)
        hit[hit] = self._low(lo[hit]) == want[hit]
        return np.where(hit, lo, -1)


class Trie:
    """Smoothed probabilities of words after one and two words, a byte each, and the weight left to shorter contexts."""

    LEVELS = 6

    def __init__(self, buffer):
        found = unpack(buffer)
        of = [EliasFano(*found[EliasFano.PIECES * k : EliasFano.PIECES * (k + 1)]) for k in range(self.LEVELS)]
        self.words, self.first, self.to_pairs, self.pairs, self.to_triples, self.triples = of
        self.pair_code, self.rest_code, self.triple_code = found[EliasFano.PIECES * self.LEVELS :]

    @staticmethod
    def build(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, heavy: dict[int, int], pair_mass: float, triple_mass: float, none: int) -> bytes:
        """The levels of distinct, sorted triples (u, v, w) with counts n; w is ``none`` where nothing follows.

        ``heavy``: counts of first words whose triples are spread over several tries. Probabilities are Dirichlet-smoothed:
        count / (count of the context + mass); the rest of the mass goes to the shorter context.
        """
        new_u = np.concatenate([[True], u[1:] != u[:-1]]) if len(u) else np.zeros(0, bool)
        new_v = new_u | np.concatenate([[True], v[1:] != v[:-1]]) if len(u) else new_u
        at_u, at_v, follows = np.nonzero(new_u)[0], np.nonzero(new_v)[0], w != none
        # Words are sought once each: what repeats them gets their ranks by place.
        (own_first, of_first, _), (own_second, of_second, _), (own_third, of_third, _) = (ranked(x) for x in (u[at_u], v[at_v], w))
        words = np.unique(np.concatenate([own_first, own_second, own_third]))
        size = max(1, len(words))
        first, second, third = (np.searchsorted(words, own).astype(np.uint64)[of] for own, of in ((own_first, of_first), (own_second, of_second), (own_third, of_third)))
        sums = lambda at: np.add.reduceat(n, at) if len(at) else np.zeros(0, np.int64)
        n_u, n_v = sums(at_u), sums(at_v)
        if heavy:
            n_u = np.array([heavy.get(int(x), int(k)) for x, k in zip(u[at_u], n_u, strict=True)], np.int64)
        own_u, own_v = np.cumsum(new_u)[at_v] - 1, np.cumsum(new_v) - 1
        starts = np.concatenate([[0], np.cumsum(np.bincount(own_v[follows], minlength=len(at_v)))])
        levels = [
            EliasFano.of(words, 1 << 32), EliasFano.of(first, size),
            EliasFano.of(np.concatenate([np.searchsorted(at_v, at_u), [len(at_v)]]), len(at_v) + 1),
            EliasFano.of(own_u.astype(np.uint64) * np.uint64(size) + second, max(1, len(at_u)) * size),
            EliasFano.of(starts, int(follows.sum()) + 1),
            EliasFano.of(own_v[follows].astype(np.uint64) * np.uint64(size) + third[follows], max(1, len(at_v)) * size),
        ]
        codes_ = [codes(n_v / (n_u[own_u] + pair_mass)), codes(triple_mass / (n_v + triple_mass)), codes(n[follows] / (n_v[own_v[follows]] + triple_mass))]
        return pack([a for level in levels for a in level.arrays()] + codes_)

    def _child(self, level: EliasFano, pointers: EliasFano, parent: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.full(len(parent), -1, np.int64)
        seen = np.nonzero((parent >= 0) & (rank >= 0))[0]
        for at in range(0, len(seen), BLOCK):
            k = seen[at : at + BLOCK]
            own = parent[k]
            out[k] = level.find(own.astype(np.uint64) * np.uint64(max(1, self.words.n)) + rank[k].astype(np.uint64), pointers.get(own).astype(np.int64), pointers.get(own + 1).astype(np.int64))
        return out

    def _rank(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for those that were never seen; each is sought once."""
        own, of, _ = ranked(words)
        return np.concatenate([np.zeros(0, np.int64), *(self.words.find(own[at : at + BLOCK]) for at in range(0, len(own), BLOCK))])[of]

    def pair(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Numbers of the pairs (u, v), -1 for those that were never seen."""
        own, of, _ = ranked(u)
        rank = self._rank(own)
        first = np.where(rank >= 0, self.first.find(np.maximum(rank, 0)), -1)
        return self._child(self.pairs, self.to_pairs, first[of], self._rank(v))

    def triple(self, pair: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Numbers of the triples made of numbered pairs and next words, -1 for those that were never seen."""
        return self._child(self.triples, self.to_triples, pair, self._rank(w))

    def lookup(self, pair: np.ndarray, triple: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the pairs, of the weight that they leave to shorter contexts (1 where never seen), and of the triples."""
        known = lambda code, at, other: np.where(at >= 0, code[np.maximum(at, 0)], other).astype(np.uint8) if len(code) else np.full(len(at), other, np.uint8)
        return known(self.pair_code, pair, 0), known(self.rest_code, pair, 1), known(self.triple_code, triple, 0)
