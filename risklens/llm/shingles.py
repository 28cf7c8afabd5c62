"""Word shingles of texts as 64-bit sets, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C55
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything of ASCII but letters and digits: words without punctuation.
PUNCTUATION = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(2 * n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str, between: np.ndarray = _SPACE) -> np.ndarray:
    """A hash of each word of the text with A-Z lower-cased; ``between`` marks the
    bytes that part words (``[\\x20\\x09-\\x0D]`` by default)."""
    raw = text.encode("utf-8").lower()  # of bytes: ASCII letters only
    b = np.frombuffer(raw, np.uint8)
    inside = np.empty(len(b) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(between[b], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _grow(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:len(b)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; of fewer words, one of them all."""
    n = len(words)
    if not n:
        return words
    own = min(size, n)
    h = np.zeros(n - own + 1, np.uint64)
    for k in range(own):
        h = mix(h * np.uint64(0x94D049BB133111EB) + words[k:n - own + 1 + k])
    return h if own == size else mix(h + np.uint64(own + 1))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingles."""
    return np.unique(shingle_hashes(word_hashes(text), size)) if text else np.empty(0, np.uint64)


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    h = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return h - (1 << 64) if h >> 63 else h


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    if not len(y):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())
