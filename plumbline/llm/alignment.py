"""Longest common subsequence of two lists of line hashes, by bit rows."""

from __future__ import annotations

import numpy as np

#: Bits that the rows of one alignment may hold before it is divided.
_MOST_BITS = 1 << 27


def _step(v: int, hits: int, full: int) -> int:
    """The next bit row: a zero bit at j says that the common length grows at b[j]."""
    u = v & hits
    return ((v + u) | (v - u)) & full


def _places(b: list[int]) -> dict[int, int]:
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    return at


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Common length of `a` with each prefix of `b`, from 0 to len(b) lines."""
    at, full = _places(b), (1 << len(b)) - 1
    v = full
    for x in a:
        if hits := at.get(x):
            v = _step(v, hits, full)
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _aligned(a: list[int], b: list[int], first: int, found: list[int]) -> None:
    """Adds the indices (from `first`) of a's lines in one longest common subsequence."""
    if not a or not b:
        return
    if len(a) == 1:
        if a[0] in b:
            found.append(first)
        return
    if len(a) * len(b) > _MOST_BITS:  # in two halves of a, at the cut of b where their common lengths add up to most
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        _aligned(a[:half], b[:cut], first, found)
        _aligned(a[half:], b[cut:], first + half, found)
        return
    at, full = _places(b), (1 << len(b)) - 1
    rows = [full]
    for x in a:
        rows.append(_step(rows[-1], at[x], full) if x in at else rows[-1])
    i, j = len(a), len(b)
    while i and j:
        if rows[i] >> j - 1 & 1:
            j -= 1
        elif not rows[i - 1] >> j - 1 & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append(first + i)


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indices of the lines of `a`, ascending, that one longest common subsequence with `b` takes.

    Equal beginnings and ends belong to it, and lines that only one side has don't. What is left is
    aligned with one bit for each pair of lines, and divided where that would be more than 16 MB, so
    memory is bounded for lists of any length.
    """
    low, high = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    known_a, known_b = set(a), set(b)
    inner = [i for i in range(low, len(a) - high) if a[i] in known_b]
    found: list[int] = []
    _aligned([a[i] for i in inner], [x for x in b[low : len(b) - high] if x in known_a], 0, found)
    return [*range(low), *(inner[i] for i in sorted(found)), *range(len(a) - high, len(a))]
