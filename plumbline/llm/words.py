"""Vectorised words, shingles and windows of whole texts, for use inside Arrow tasks.

A word is a maximal run of bytes other than space and 0x09-0x0D; in UTF-8 that equals the pattern
``[^\\x20\\x09-\\x0D]+`` over characters. Everything works on the Arrow buffers of one batch: no
Python string is made, and memory follows the batch, in blocks of at most BLOCK bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2**64 and of its inverse, made once in each worker."""
    if 0 not in _powers:
        up = np.full(BLOCK + 1, _BASE, np.uint64)
        down = np.full(BLOCK + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[0] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (n + 1) and null flags of a string column; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    nulls = np.asarray(texts.is_null())
    if nulls.any():
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0], nulls


class Words:
    """Words of a batch of texts: byte spans, index of the text, first word of each text, hash."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.raw, self.at, self.nulls = text_buffer(texts)
        raw, at = self.raw, self.at
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)
        n = len(raw)
        inside = ~_SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1] | edge[1:-1]
            last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, at)  # of text i: first[i] to first[i + 1]
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.hash = _hashes(raw, self.start, self.end)

    def windows(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of k words within one text, in order of position."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        here = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        total = np.zeros(n, np.uint64)
        factors = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed * 7919 + 1)) | np.uint64(1)
        for j in range(k):
            total += self.hash[j : j + n] * factors[j]
        return here, mix(total[here])


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span, by differences of prefix sums within a block."""
    out = np.empty(len(start), np.uint64)
    up, down = _tables()
    i = 0
    while i < len(start):
        lo = start[i]
        j = int(np.searchsorted(end, lo + BLOCK, "right"))
        if j <= i:  # one word longer than a block
            out[i] = int.from_bytes(hashlib.blake2b(raw[lo : end[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        part = raw[lo : end[j - 1]].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out
