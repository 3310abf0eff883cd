"""Words of an Arrow text column as 64-bit hashes, computed over whole blocks of bytes.

Words are runs of bytes other than white space (9-13 and 32), as in ``[^\\x20\\x09-\\x0D]+``. A word's
hash is a polynomial over random values of its bytes, from differences of one running sum; hashes of
n consecutive words come the same way from the words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_VALUES = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Powers that a worker keeps of each base, for blocks of usual size; a longer text's are made for it alone.
_KEPT = 1_200_000


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least n of each."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        n = max(n, 1 << 17)
        up, down = (np.full(n, b, np.uint64) for b in (base, pow(base, -1, 2**64)))
        up[0] = down[0] = 1
        held = (np.cumprod(up), np.cumprod(down))
        if n <= _KEPT:
            _POWERS[base] = held
    return held


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of consecutive rows: byte starts and ends in ``data``, hash, and the first word of each row."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(rows) + 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    text = pc.fill_null(text.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    return data, offsets


def word_blocks(text: pa.Array, lower: bool = False, block: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """Runs of whole rows of about ``block`` bytes: first row, end row, their words. A null has no words."""
    data, offsets = _buffers(text)
    row = 0
    while row < len(text):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block, side="right")) - 1)
        yield row, stop, _words(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], lower)
        row = stop


def _words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    if lower:
        data = _LOWER[data]
    word = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=word[1:-1])
    step = word[1:] != word[:-1]
    start, end = np.flatnonzero(step & word[1:]), np.flatnonzero(step & word[:-1])
    inner = np.unique(offsets[1:-1])
    inner = inner[(inner > 0) & (inner < len(data))]
    cut = inner[word[inner] & word[inner + 1]]  # a word never joins two rows
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    up, down = powers(_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return Words(data, start, end, mix((sums[end] - sums[start]) * down[start]), np.searchsorted(start, offsets))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place; n-1 fewer than words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(_STEP, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def span_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from each start to before each end."""
    up, down = powers(_STEP, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def row_ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that lie within one row, and the first n-gram of each row.

    A row of fewer than n words, but of some, has one n-gram: all its words.
    """
    counts = np.diff(words.first)
    per_row = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(per_row)])
    out = np.empty(first[-1], np.uint64)
    left = np.repeat(words.first[1:], counts) - np.arange(words.first[-1])  # words from here to the row's end
    out[np.repeat(counts >= n, per_row)] = ngrams(words.hash, n)[np.flatnonzero(left >= n)]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        out[first[i]] = ngrams(words.hash[words.first[i] : words.first[i + 1]], int(counts[i]))[0] ^ np.uint64(counts[i])
    return out, first
