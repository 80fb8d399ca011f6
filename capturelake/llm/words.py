"""Words, shingles and window minima of many texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

from capturelake.llm.common import pieces

WHITE = " \t\n\x0b\x0c\r"


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of every word, byte where it starts, words before each text) of texts cut at ASCII white space."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    cut = ~gap
    cut[1:] &= gap[:-1]
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    which, distinct = pieces(data, starts)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if lower else {}
    hashes = np.zeros(len(distinct), np.uint64)
    digest = xxhash.xxh3_64_intdigest
    for i, piece in enumerate(distinct):
        word = piece.strip(WHITE)
        hashes[i] = digest((word.translate(low) if lower and not word.islower() else word).encode()) if word else 0
    values = hashes[which]
    word = ~gap[starts]  # a text may begin with white space, which is a piece without a word
    starts = starts[word]
    return values[word], starts, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (k - 1 fewer than words)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j:j + n]
    return mixed(out)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from each position on (width - 1 fewer than values)."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:n], values[rest:rest + n])
