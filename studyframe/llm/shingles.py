"""Hashes of word shingles, for many texts at once in numpy.

Words are runs of bytes other than space and 0x09-0x0D of the text with A-Z in lower
case. A word's hash is a sum of random numbers by byte, weighted by powers of an odd
number, taken from running sums; a shingle's hash mixes the hashes of its five words.
All hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np

WORDS = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, 256 + 2 * WORDS + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE, _PLACE, _COUNT = _RANDOM[:256], _RANDOM[256:256 + WORDS], _RANDOM[256 + WORDS:256 + 2 * WORDS]
_BASE = int(_RANDOM[-1])
_BASE_BACK = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, kept as long as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full(n, _BASE, np.uint64), np.full(n, _BASE_BACK, np.uint64)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up, self.down


_POWERS = _Powers()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, words of each text) of texts laid end to end."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    low = _LOWER[data]
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_GAP[low]
    edge = inside[1:] != inside[:-1]  # edge[i]: a word starts or ends before byte i
    start = edge[:n] & inside[1:-1]
    cut = offsets[:-1][np.diff(offsets) > 0]
    start[cut[inside[cut + 1]]] = True  # a text's first word does not go on from the text before
    start = np.flatnonzero(start)
    end = np.append(start[1:], n)
    gap_after = np.flatnonzero(edge[1:] & inside[1:-1]) + 1  # ends by a gap or the end of all
    stop = np.minimum(end, gap_after[np.searchsorted(gap_after, start, side="right")])
    up, down = _POWERS.get(n)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[low] * up[:n], out=running[1:])
    words = mix((running[stop] - running[start]) * down[start] + (stop - start).astype(np.uint64) * _COUNT[0])
    return words, np.diff(np.searchsorted(start, offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text of fewer than five words has its whole sequence as one, one without words none.
    """
    words, counts = word_hashes(data, offsets)
    at = np.append(0, np.cumsum(counts))
    long = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        long += words[k:k + len(long)] * _PLACE[k]
    long = mix(long)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(long[a:b - WORDS + 1]))
        elif b > a:
            out.append(mix(np.sum(words[a:b] * _PLACE[:b - a], keepdims=True, dtype=np.uint64) + _COUNT[b - a:b - a + 1]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
