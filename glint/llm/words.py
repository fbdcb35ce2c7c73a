"""Words and shingles of a text as 64-bit hashes, in numpy, for use inside tasks.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z may be folded to a-z. Hashes depend only on a word's
bytes: a polynomial over the bytes in arithmetic modulo 2**64, then mixed.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least n places."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64))), dtype=np.uint64) for b in (np.uint64(_BASE), np.uint64(_INVERSE))]
    return _powers[0], _powers[1]


def _block_hashes(a: np.ndarray, prefix: int | None = None) -> np.ndarray:
    white = _WHITE[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], white, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    if prefix:
        ends = np.minimum(ends, starts + prefix)
    up, down = _power(len(a))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(text: str | None, lower: bool = True, prefix: int | None = None) -> np.ndarray:
    """One hash for each word of the whole text (or for its first ``prefix`` bytes), in order; none for a null text."""
    if not text:
        return np.empty(0, np.uint64)
    a = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if lower:
        a = _LOWER[a]
    if len(a) <= _BLOCK:
        return _block_hashes(a, prefix)
    found, at = [], 0
    while at < len(a):  # long texts in blocks that end before white space
        end = min(len(a), at + _BLOCK)
        while end < len(a):
            stop = np.flatnonzero(_WHITE[a[end : end + _BLOCK]])
            if len(stop):
                end += int(stop[0])
                break
            end = min(len(a), end + _BLOCK)
        found.append(_block_hashes(a[at:end], prefix))
        at = end
    return np.concatenate(found)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of the runs of ``size`` words; of fewer words, the whole sequence is one run."""
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(size, len(w))
    h = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(_BASE) + w[k : len(w) - size + 1 + k])
    return np.unique(h)
