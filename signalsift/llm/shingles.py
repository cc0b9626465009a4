"""Hashes of words and of shingles (runs of words), for whole columns at once.

A word's hash is a polynomial over its bytes, each byte standing for a random
64-bit number, taken from running sums over the whole buffer; a shingle's hash
mixes those of its words. Different shingles get the same 64-bit number with a
probability of about 2**-63 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from signalsift.llm.batches import slices, sole_cache, text_bytes

#: Bytes that are hashed at once; a longer text is one slice.
SLICE_BYTES = 1 << 20

_RANDOM = np.random.default_rng(20_240_229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

_SPACES = b" \t\n\v\f\r"
#: What separates words: white space, or all ASCII but letters and digits.
SPACED, LETTERS = np.ones(256, bool), np.ones(256, bool)
SPACED[list(_SPACES)] = False
LETTERS[[b for b in range(128) if not chr(b).isalnum()]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        out = np.ones(size, np.uint64)
        out[1:] = np.uint64(base)
        return np.multiply.accumulate(out)

    return powers(_BASE), powers(_INVERSE)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z as a-z) and the number of words before each row (and in all)."""
    rows = len(offsets) - 1
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(rows + 1, np.int64)
    data = _LOWER[data]
    word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate([word[1:], [False]])
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    size = 1 << max(20, int(len(data) - 1).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)


def hashed_shingles(words: np.ndarray, before: np.ndarray, size: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles, with repeats, and the number before each row (and in all).

    ``whole``: a row of fewer than ``size`` words is one shingle; without words it has none.
    """
    counts = np.diff(before)
    made = np.maximum(counts - size + 1, 0)
    if whole:
        short = (counts > 0) & (counts < size)
        made = np.where(short, 1, made)
    at = np.concatenate([[0], np.cumsum(made)])
    first = np.repeat(before[:-1] - at[:-1], made) + np.arange(at[-1])
    total = np.full(len(first), np.uint64(size) * _PLACES[-1])
    held = np.repeat(np.minimum(counts, size), made)
    for k in range(size):
        if whole and (held <= k).any():
            use = held > k
            total[use] += words[first[use] + k] * _PLACES[k]
        else:
            total += words[first + k] * _PLACES[k]
    if whole:
        total += (np.uint64(size) - held.astype(np.uint64)) * _PLACES[-2]
    return mixed(total), at


def shingled(column: pa.Array, size: int, inside: np.ndarray = SPACED, whole: bool = True) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Row number of each slice of a text column and, per row, the shingle hashes in order of the text."""
    sole_cache("shingles", _powers.cache_clear)
    data, offsets = text_bytes(column)
    for start, stop in slices(offsets, SLICE_BYTES):
        low, high = offsets[start], offsets[stop]
        words, before = hashed_words(data[low:high], offsets[start : stop + 1] - low, inside)
        hashes, at = hashed_shingles(words, before, size, whole)
        yield start, [hashes[at[i] : at[i + 1]] for i in range(stop - start)]
