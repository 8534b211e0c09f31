"""Word shingles of whole texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20_240_607)
#: A random number per byte, capital letters A-Z as their lower-case forms.
_TABLE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[0x41:0x5B] = _TABLE[0x61:0x7B]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_ROLES = _RANDOM.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word, a run of bytes that are not ASCII white space."""
    codes = np.frombuffer(data, dtype=np.uint8)
    inside = ~_SPACE[codes]
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[codes] * _powers(_ODD, len(codes)), out=sums[1:])
    back = _powers(_INVERSE, len(codes) + 1)
    return starts, mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct ``width``-word shingles of each text, sorted; with fewer words the whole sequence is one, without words none."""
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts, hashes = word_hashes(b" ".join(texts))
    first = np.searchsorted(starts, offsets)
    n = len(hashes) - width + 1
    joined = np.zeros(max(0, n), dtype=np.uint64)
    for k in range(width if n > 0 else 0):
        joined += hashes[k : k + n] * _ROLES[k]
    joined = mix(joined)
    out = []
    for k in range(len(texts)):
        a, b = first[k], first[k + 1]
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            parts = np.r_[hashes[a:b] * _ROLES[: b - a], _ROLES[15 - (b - a)]]
            out.append(mix(parts.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
