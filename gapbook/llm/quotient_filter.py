"""Counting quotient filters of n-grams: compact, lossless, and merged as sorted runs.

An n-gram of word numbers of ``bits`` bits each is packed into two halves. An invertible permutation
spreads n-grams evenly; of the result the top bits are the quotient and all others the remainder. A
filter holds for each quotient the sorted run of its remainders, in as few bytes as they need, and
their counts. As the permutation is inverted exactly and no bit of the remainder is dropped, a filter
counts without error, and gives back its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def permuted(a: np.ndarray, b: np.ndarray, wa: int, wb: int, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A permutation of all pairs of ``wa`` and ``wb`` bits, or its inverse: rounds of a Feistel network."""
    for r in range(len(ROUNDS) - 1, -1, -1) if back else range(len(ROUNDS)):
        if r % 2 == 0:
            b = b ^ (_mixed(a, ROUNDS[r]) & _mask(wb))
        else:
            a = a ^ (_mixed(b, ROUNDS[r]) & _mask(wa))
    return a, b


@dataclass(frozen=True)
class Layout:
    """How n-grams of ``n`` words of ``bits`` bits (32 at most) are packed; ``q`` bits are the quotient."""

    n: int
    bits: int
    q: int

    @property
    def left(self) -> int:
        return (self.n + 1) // 2

    @property
    def wa(self) -> int:
        return self.left * self.bits

    @property
    def wb(self) -> int:
        return (self.n - self.left) * self.bits

    @property
    def rest(self) -> int:
        """Bits of the remainder in the first half."""
        return self.wa - self.q

    def packed(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The permuted halves of the n-grams whose k-th words are ``words[k]``."""
        halves = []
        for part in (words[: self.left], words[self.left :]):
            half = np.zeros(len(words[0]), np.uint64)
            for w in part:
                half = half << np.uint64(self.bits) | w.astype(np.uint64)
            halves.append(half)
        return permuted(*halves, self.wa, self.wb)

    def words(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """The inverse of ``packed``."""
        a, b = permuted(a, b, self.wa, self.wb, back=True)
        out = []
        for half, many in ((a, self.left), (b, self.n - self.left)):
            out += [half >> np.uint64(self.bits * (many - 1 - k)) & _mask(self.bits) for k in range(many)]
        return out


def grouped(a: np.ndarray, b: np.ndarray, wb: int, wa: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sorted order of pairs, where in it each distinct pair begins, and each pair's place among the
    distinct ones."""
    if wa + wb <= 64:
        key = a << np.uint64(wb) | b
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]])
    else:
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        new = np.concatenate([np.ones(min(len(x), 1), bool), (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), place


def shrunk(values: np.ndarray) -> bytes:
    """A byte that says the width, then the values in 1, 2, 4 or 8 bytes each."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.uint64)


class CountingQuotientFilter:
    """The distinct n-grams of ``a, b`` (permuted halves) and their counts, in sorted runs."""

    def __init__(self, layout: Layout, a: np.ndarray, b: np.ndarray):
        self.layout = layout
        order, starts, self.place = grouped(a, b, layout.wb, layout.wa)
        self.a, self.b = a[order[starts]], b[order[starts]]
        self.counts = np.diff(np.append(starts, len(a)))

    def runs(self) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
        """For each quotient that occurs: where its run begins, and its remainders and counts as bytes."""
        high = (self.a >> np.uint64(self.layout.rest)).astype(np.int64)
        starts = np.flatnonzero(np.diff(high, prepend=-1))
        low = self.a & _mask(self.layout.rest)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(high)], strict=True):
            yield int(high[s]), s, shrunk(low[s:e]), shrunk(self.b[s:e]), shrunk(self.counts[s:e])


def merged(layout: Layout, quotient: int, runs: list[tuple[bytes, bytes, bytes]], least: int) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """One quotient's runs of several filters in one: the words and counts of n-grams that occur ``least``
    times or more in all, and for each run which of its entries these are."""
    a = np.concatenate([widened(r[0]) for r in runs]) | np.uint64(quotient << layout.rest)
    b = np.concatenate([widened(r[1]) for r in runs])
    counts = np.concatenate([widened(r[2]) for r in runs]).astype(np.int64)
    order, starts, place = grouped(a, b, layout.wb, layout.wa)
    total = np.add.reduceat(counts[order], starts)
    often = total >= least
    first = order[starts[often]]
    sizes = np.cumsum([(len(r[2]) - 1) // r[2][0] for r in runs])
    return layout.words(a[first], b[first]), total[often], np.split(often[place], sizes[:-1])
