"""Vectorised word and shingle hashes of whole texts, batch by batch, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(20240229)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: A random 64-bit value for each byte; A-Z have those of a-z.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads them evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes that are no white space, A-Z as a-z), and where each text's words begin."""
    buf = np.frombuffer(b" ".join(texts), np.uint8)
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    word = ~_WHITE[buf]
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = np.flatnonzero(word)
    first = np.cumsum(lengths) - lengths
    at = np.arange(len(inside)) - np.repeat(first, lengths)
    values = _BYTE[buf[inside]] * _powers(int(lengths.max()))[at]
    hashes = mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _PLACE[63])
    return hashes, np.concatenate(([0], np.searchsorted(starts, ends_at)))


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams; of all its words together if it has fewer."""
    words, bounds = word_hashes(texts)
    grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        grams = grams + words[k : k + len(grams)] * _PLACE[k]
    grams = mixed(grams)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield mixed(np.array([(words[a:b] * _PLACE[32 : 32 + b - a]).sum(dtype=np.uint64)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
