"""Five-word shingle sets as sorted 64-bit hashes, by numpy, for use inside Python workers.

A-Z are lower-cased; words are runs of bytes other than white space (32 and 9 to 13).  A text of fewer than five
words has the whole sequence as its one shingle; a text without words has none.  Sets are equal up to collisions
of 64-bit hashes.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
#: Bytes hashed at once; longer texts are cut at white space, so memory beyond the text itself is bounded.
SLICE = 1 << 21

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20240607).integers(1 << 63, size=256, dtype=np.uint64) * _U(2) + _U(1)
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> _U(32)
    x = x * _STEP
    x = x ^ x >> _U(29)
    x = x * _BASE
    return x ^ x >> _U(32)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = np.concatenate(([_U(1)], np.cumprod(np.full(size, _BASE, dtype=np.uint64))))
    return _powers


def _slice_hashes(b: np.ndarray) -> np.ndarray:
    space = (b == 32) | ((b >= 9) & (b <= 13))
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    ends = np.flatnonzero(inside & np.concatenate((space[1:], [True]))) + 1
    lengths = ends - starts
    at = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))[-len(b) :] if starts[0] == 0 else None
    if at is None:
        b, space, starts = b[starts[0] :], space[starts[0] :], starts - starts[0]
        at = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    values = _BYTE[b] * _power_table(int(at.max()) + 1)[at]
    values[space] = 0
    return mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64) * _STEP)


def word_hashes(text: str) -> np.ndarray:
    raw = text.encode().lower()
    if len(raw) <= SLICE:
        return _slice_hashes(np.frombuffer(raw, np.uint8)) if raw else np.empty(0, dtype=np.uint64)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + SLICE)
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        out.append(_slice_hashes(np.frombuffer(raw, np.uint8, end - at, at)))
        at = end
    return np.concatenate(out)


def shingle_set(text: str) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(WIDTH, len(h))
    s = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        s = s * _BASE + h[k : len(h) - width + 1 + k]
    return np.unique(mix(s + _U(width)))


def set_identities(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set and its size, from sums over different mixes of its elements."""
    if not len(s):
        return 0, 0
    one, two = mix(s ^ _STEP), mix(s + _BASE)
    n = np.array([len(s)], dtype=np.uint64)
    first = np.add.reduce(one) ^ np.bitwise_xor.reduce(two) + n
    second = np.add.reduce(two ^ one >> _U(7)) + n * _STEP
    return tuple(mix(np.concatenate([first, second])).view(np.int64).tolist())


def set_identity(s: np.ndarray) -> int:
    return set_identities(s)[0]
