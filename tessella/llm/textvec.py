"""Words of a UTF-8 text as arrays, for operators that run in Arrow batches.

A text is cut into segments at white space, so that the arrays beside it stay small however
long it is. Hashes are of 64 bits and the same in every process.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 19
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _P and of its inverse modulo 2**64."""
    if len(_powers.get("p", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
            a = np.full(size, base, _U)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of words."""
    word = np.empty(len(b) + 2, np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = ~_SPACE[b]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _segments(b: np.ndarray):
    """(offset, segment) pairs that cut no word."""
    at = 0
    while at < len(b):
        end = min(len(b), at + SEGMENT)
        while end < len(b):
            back = np.flatnonzero(_SPACE[b[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
                break
            end = min(len(b), end + SEGMENT)  # a single word: it has to come whole
        yield at, b[at:end]
        at = end


def words(text: bytes | None, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts and byte ends of the words; lower: A-Z count as a-z."""
    b = np.frombuffer(text or b"", np.uint8)
    out = []
    for at, seg in _segments(b):
        s, e = spans(seg)
        if not len(s):
            continue
        p, q = _power(len(seg))
        c = np.zeros(len(seg) + 1, _U)
        np.cumsum((_LOWER[seg] if lower else seg).astype(_U) * p[: len(seg)] + p[: len(seg)], out=c[1:])
        out.append((mix((c[e] - c[s]) * q[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)), s + at, e + at))
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(_U), z, z
    return tuple(np.concatenate(x) for x in zip(*out)) if len(out) > 1 else out[0]


_COEF = [int(x) | 1 for x in mix(np.arange(1, 257, dtype=_U))]


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k elements."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = h[:n] * _U(_COEF[0])
    for j in range(1, k):
        out += h[j : n + j] * _U(_COEF[j])
    return mix(out + _U(k))


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles, lower case; the whole sequence if it is shorter."""
    h, _, _ = words(text, lower=True)
    if not len(h):
        return h
    return np.unique(windows(h, k) if len(h) >= k else windows(h, len(h)))
