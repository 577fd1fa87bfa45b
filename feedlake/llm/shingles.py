"""Sets of word shingles as 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from feedlake.llm.batches import joined_bytes

WORDS = 5
#: Bytes hashed in one step; longer words are taken whole.
_STEP = 1 << 21

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # only these letters are lower-cased
_BASE = _rng.integers(1 << 60, 1 << 63, dtype=np.uint64) | np.uint64(5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True  # fixed values: blank, tab to carriage return


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of the texts ``data[bounds[i]:bounds[i+1]]``, and each text's first word."""
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < bounds[1:]]
    start[edges] = inside[edges]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | start[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    hashes = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + _STEP, side="right")))
        a, b = int(starts[low]), int(ends[high - 1])
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[data[a:b]] * _powers(_BASE, b - a - 1), out=sums[1:])
        s, e = starts[low:high] - a, ends[low:high] - a
        hashes[low:high] = mixed((sums[e] - sums[s]) * _powers(_INVERSE, b - a)[s] + (e - s).astype(np.uint64))
        low = high
    return hashes, starts, ends, np.searchsorted(starts, bounds)


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    A shingle is ``words`` words in a row, words being `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. A
    text of fewer words has one shingle, all of them; a text without words, or null, has none.
    """
    data, bounds = joined_bytes(column)
    hashes, _, _, first = word_hashes(data, bounds)
    n = len(hashes)
    full = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        full += hashes[k : k + len(full)] * _PLACE[k]
    full = mixed(full + np.uint64(words))
    out = []
    for low, high in zip(first[:-1], first[1:], strict=True):
        if high - low >= words:
            out.append(np.unique(full[low : high - words + 1]))
        elif high > low:
            few = (hashes[low:high] * _PLACE[: high - low]).sum(dtype=np.uint64) + np.uint64(high - low)
            out.append(mixed(np.asarray([few], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
