"""Vectorised hashing of words and word n-grams over whole batches of texts.

A word is a maximal run of bytes other than U+0020 and U+0009 to U+000D, after lower-casing A-Z.
Hashes are 64 bits; equal sequences hash alike everywhere.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [np.uint64(x) for x in (_RNG.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1))]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0xD1342543DE82EF93 & ~7 | 3)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Base to the powers 0 to n-1, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        size = 1 << max(10, (n - 1).bit_length())
        out = np.full(size, _BASE, np.uint64)
        out[0] = 1
        _powers = np.multiply.accumulate(out)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the batch, and where each text's words begin and end (n + 1 offsets)."""
    data = np.frombuffer(b" ".join(raws).lower() + b" ", np.uint8)
    solid = ~_SPACE[data]
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0))
    first = np.flatnonzero(edge == 1)
    size = np.flatnonzero(edge == -1) - first
    lengths = np.fromiter(map(len, raws), np.int64, len(raws))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    offsets = np.searchsorted(first, begins)
    if not len(first):
        return np.zeros(0, np.uint64), offsets
    where = np.flatnonzero(solid)
    inside = where - np.repeat(first, size)
    part = _BYTE[data[where]] * powers(int(size.max()))[inside]
    total = np.add.reduceat(part, np.concatenate([[0], np.cumsum(size)[:-1]]))
    return mix(total + size.astype(np.uint64)), offsets


def grams(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; positions too near the end are left out."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(k))
    for j in range(k):
        total += word[j : j + n] * _STEP[j]
    return mix(total)


def sequence(word: np.ndarray) -> np.uint64:
    """Hash of a whole sequence shorter than an n-gram."""
    return mix((word * np.array(_STEP[: len(word)], np.uint64)).sum(keepdims=True) + np.uint64(len(word)))[0]


def sets(raws: list[bytes], k: int) -> list[np.ndarray]:
    """Per text the sorted distinct k-word shingles; a shorter text is one shingle; one without words is empty."""
    word, offsets = words(raws)
    every = grams(word, k)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            got = np.sort(every[a : b - k + 1])
            keep = np.empty(len(got), bool)
            keep[0] = True
            np.not_equal(got[1:], got[:-1], out=keep[1:])
            out.append(got[keep])
        else:
            out.append(np.array([sequence(word[a:b])], np.uint64) if b > a else np.zeros(0, np.uint64))
    return out
