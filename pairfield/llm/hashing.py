"""Vectorised 64-bit hashes of words and byte ranges, shared by the operators that work on shingles."""

from __future__ import annotations

import numpy as np

from .common import blocks

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's first n powers and their inverses, mod 2^64."""
    if len(_POWERS[0]) < n:
        for at, r in enumerate((_R, _R_INVERSE)):
            p = np.full(max(n, 1 << 19), r, np.uint64)
            p[0] = 1
            _POWERS[at] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = sum of byte * power over [i, j); see ``range_hash``."""
    p, _ = powers(len(data))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p, dtype=np.uint64)])


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for many ranges; depends on the bytes alone, not on where they stand."""
    _, inverse = powers(len(h))
    return mix((h[end] - h[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash per whitespace-delimited word of all texts in a row, and where each text's words begin."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    start, end = edge[0::2], edge[1::2]
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return range_hash(prefix_hash(data), start, end), np.searchsorted(start, begin)


def shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Per text its distinct k-word shingles as sorted hashes; shorter texts give their whole word sequence as one."""
    out: list[np.ndarray] = []
    for a, b in blocks(texts):
        out += _shingles(texts[a:b], k)
    return out


def _shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    w, begin = word_hashes(texts)
    s = w.copy()
    for j in range(1, min(k, len(w))):
        s[: len(s) - j] = mix(s[: len(s) - j] * np.uint64(0x9FB21C651E98DF25) + w[j:])
    out = []
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif b > a:
            x = w[a : a + 1]
            for i in range(a + 1, b):
                x = mix(x * np.uint64(0x9FB21C651E98DF25) + w[i : i + 1])
            out.append(x ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
