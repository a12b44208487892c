"""Vectorised 64-bit hashes of words and word sequences in UTF-8 buffers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so every power has an inverse modulo 2**64
#: Bytes that are hashed at once; a longer text is cut at blanks.
PIECE = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of a well-known public hash (fmix64); a bijection of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    factors = np.full(size, _BASE, np.uint64)
    factors[0] = 1
    inverse = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    return np.multiply.accumulate(factors), np.multiply.accumulate(inverse)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and inverse powers: ``(sums[j] - sums[i]) * inverse[i]`` is a hash of ``data[i:j]`` wherever it stands."""
    size = PIECE if len(data) < PIECE else 1 << (len(data) + 1).bit_length()
    powers, inverse = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return sums, inverse


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of ``data``, with A-Z read as a-z."""
    blank = _BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    sums, inverse = prefix_sums(_LOWER[data])
    words = (sums[ends] - sums[starts]) * inverse[starts]
    return mix64(words + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of non-blank bytes) of all texts in turn, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts])
    found, places, at = [], [], 0
    while at < len(data):
        stop = at + PIECE - 1
        if stop < len(data):
            cut = np.flatnonzero(_BLANK[data[at:stop]])
            if len(cut):
                stop = at + int(cut[-1]) + 1
            else:
                rest = np.flatnonzero(_BLANK[data[stop:]])
                stop += int(rest[0]) + 1
        words, starts = _word_hashes(data[at:stop])
        found.append(words)
        places.append(starts + at)
        at = stop
    counts = np.diff(np.searchsorted(np.concatenate(places), firsts))
    return np.concatenate(found), counts


def shingles(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles of consecutive texts and their number per text.

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    ends = np.cumsum(counts)
    end = np.repeat(ends, counts)
    place = np.arange(len(words))
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    total = np.zeros(len(words), np.uint64)
    for k in range(width):
        factor = mix64(np.array([2 * k + 1], np.uint64)) | np.uint64(1)
        total += np.where(place + k < end, padded[k : k + len(words)] * factor, np.uint64(0))
    keep = (place + width <= end) | ((place == end - np.repeat(counts, counts)) & (np.repeat(counts, counts) < width))
    numbers = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    return mix64(total[keep]), numbers
