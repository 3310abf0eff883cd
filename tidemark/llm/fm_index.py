"""A compressed FM-index over word passages: wavelet matrix, backward search, matching statistics."""

from __future__ import annotations

import numpy as np


class BitRank:
    """A bit vector with rank: packed words and the running count of their ones."""

    def __init__(self, bits: np.ndarray):
        size = len(bits) // 64 + 1
        padded = np.zeros(size * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.depth = max(1, int(alphabet - 1).bit_length())
        self.levels: list[tuple[BitRank, int]] = []
        for level in range(self.depth - 1, -1, -1):
            bits = ((symbols >> level) & 1).astype(np.uint8)
            zeros = len(symbols) - int(bits.sum())
            self.levels.append((BitRank(bits), zeros))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.starts = np.zeros(alphabet, np.int64)
        if len(symbols):
            first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
            self.starts[symbols[first]] = first

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        at = at.copy()
        for level, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            ones = bits.rank(at)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at - self.starts[symbol]


def suffix_order(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order, by doubling; every suffix is told apart within ``longest`` symbols."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while step <= longest:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        step *= 2
    return order


class FmIndex:
    """Over passages, in text order; earlier passages are those that come first."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        """Of passages of these lengths, one after the other in ``flat``; none is empty."""
        lengths = lengths.astype(np.int64)
        passages = lengths
        self.start = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        self.length = lengths
        words, codes = np.unique(flat, return_inverse=True)
        self.text = np.zeros(int(lengths.sum() + len(passages)), np.int64)  # 0 ends a passage
        inner = np.ones(len(self.text), bool)
        inner[self.start + lengths] = False
        self.text[inner] = codes + 1
        told_apart = self.text + len(passages)
        told_apart[~inner] = np.arange(len(passages))
        order = suffix_order(told_apart, int(lengths.max()) + 1)
        self.alphabet = len(words) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=self.alphabet))])
        self.tree = WaveletMatrix(self.text[order - 1], self.alphabet)
        # Least text position of any interval of suffixes: minima over runs of doubling length.
        self.least = [order.astype(np.int32)]
        width = 1
        while 2 * width <= len(order):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one symbol more in front: one step of backward search."""
        found = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.before[symbol]
        return base + found[: len(low)], base + found[len(low) :]

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least text position in each interval that isn't empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            run = self.least[k]
            out[at] = np.minimum(run[low[at]], run[high[at] - (1 << int(k))])
        return out

    def repeated_windows(self, window: int, passages: np.ndarray | None = None, anywhere: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, first window, windows): runs of windows that also occur earlier in the text, or ``anywhere``.

        Each passage is streamed against the index from its end. A match grows to the left as long as
        it occurs there; where it stops, all its windows are reported and the next one starts at the
        last end whose window lies further left.
        """
        found = []
        passage = np.flatnonzero(self.length >= window) if passages is None else passages[self.length[passages] >= window]
        end = self.length[passage] - 1  # of the present match, within the passage
        at = end + 1  # where it starts
        low, high = np.zeros(len(passage), np.int64), np.full(len(passage), len(self.text), np.int64)
        while len(passage):
            base = self.start[passage]
            symbol = self.text[base + at - 1]
            lower, higher = self.extend(low, high, symbol)
            grows = lower < higher
            if not anywhere:
                some = np.flatnonzero(grows)
                grows[some] = self.earliest(lower[some], higher[some]) < (base + at - 1)[some]
            at = np.where(grows, at - 1, at)
            low, high = np.where(grows, lower, low), np.where(grows, higher, high)
            stopped = ~grows | (at == 0)
            held = np.flatnonzero(stopped & (end - at + 1 >= window))
            found.append((passage[held], at[held], (end - at + 2 - window)[held]))
            turn = np.flatnonzero(stopped)
            end[turn] = np.minimum(end[turn] - 1, at[turn] + window - 2)
            at[turn] = end[turn] + 1
            low[turn], high[turn] = 0, len(self.text)
            going = (end >= window - 1) & ~(stopped & (at == 0))
            if not going.all():
                passage, end, at, low, high = (x[going] for x in (passage, end, at, low, high))
        return tuple(np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
