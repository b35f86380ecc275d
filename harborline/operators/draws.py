"""The library's random draws in numpy: the same rows of a part come into a sample as in its own boosters."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LANES = 1024  # stretches of a stream that are drawn side by side
_MASK = (1 << 64) - 1


def _mixed(data: bytes, seed: int) -> int:
    """MurmurHash3 (32 bits) of bytes whose number divides by four."""
    h = seed & 0xFFFFFFFF
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) & 0xFFFFFFFF
        h ^= k * 0x1B873593 & 0xFFFFFFFF
        h = (h << 13 | h >> 19) & 0xFFFFFFFF
        h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def first_state(seed: int) -> int:
    """What a stream starts from: the seed's bytes hashed twice."""
    data = (seed & _MASK).to_bytes(8, "big")
    low = _mixed(data, 0x3C074A61)
    return _mixed(data, low) << 32 | low


def first_int(seed: int) -> int:
    """The first whole number of a stream, with its sign."""
    low = int(_next(np.array([first_state(seed)], np.uint64))[0]) & 0xFFFFFFFF
    return low - (1 << 32) if low >> 31 else low


def _next(states: np.ndarray) -> np.ndarray:
    states = states ^ states << np.uint64(21)
    states ^= states >> np.uint64(35)
    states ^= states << np.uint64(4)
    return states


def _applied(matrix: np.ndarray, states: np.ndarray) -> np.ndarray:
    """States after the steps of a matrix, whose n-th entry is where the n-th bit alone leads."""
    out = np.zeros_like(states)
    for bit, column in enumerate(matrix):
        out ^= (states >> np.uint64(bit) & np.uint64(1)) * column
    return out


@lru_cache(maxsize=64)
def _doubled(k: int) -> np.ndarray:
    """The matrix of 2 to the power of k steps."""
    if k == 0:
        return _next(np.uint64(1) << np.arange(64, dtype=np.uint64))
    half = _doubled(k - 1)
    return _applied(half, half)


@lru_cache(maxsize=64)
def _steps(n: int) -> np.ndarray:
    """The matrix of ``n`` steps."""
    matrix = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for k in range(n.bit_length()):
        if n >> k & 1:
            matrix = _applied(_doubled(k), matrix)
    return matrix


def drawn(seed: int, start: int, n: int, share: float) -> np.ndarray:
    """Which of ``n`` rows, from row ``start`` of a stream on, a sample of that share takes.

    A row takes two steps of the generator, whose steps are linear in its bits; so a stream is
    cut into stretches that begin where the steps before them lead, and all are drawn at once.
    """
    if not n:
        return np.zeros(0, bool)
    each = -(-n // LANES)
    states = _applied(_steps(2 * start), np.array([first_state(seed)], np.uint64))
    jump = _steps(2 * each)
    while len(states) < LANES:
        states = np.concatenate([states, _applied(jump, states)])
        jump = _applied(jump, jump)
    taken = np.empty((each, LANES), bool)
    for i in range(each):
        high = _next(states)
        states = _next(high)
        whole = ((high & np.uint64((1 << 26) - 1)) << np.uint64(27)) + (states & np.uint64((1 << 27) - 1))
        taken[i] = whole * 2.0**-53 < share
    return taken.T.reshape(-1)[:n]
