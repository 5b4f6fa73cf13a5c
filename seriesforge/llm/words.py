"""Hashes of words, windows and shingles, on NumPy arrays inside tasks.

A word is ``[^\\x20\\x09-\\x0D]+``, which on UTF-8 bytes is the same thing. Its 64-bit hash is a
polynomial over random byte values, taken from running sums and then mixed; a window's is a
polynomial over its words' hashes. Texts are worked on in pieces, so memory follows the piece and
the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = _VALUES.copy()
_LOWER[65:91] = _VALUES[97:123]
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0][:n], _powers[1][:n]


def _piece(data: np.ndarray, first: np.ndarray, values: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of ``data``; ``first`` marks where a text begins."""
    ink = ~space[data]
    edge = first[: len(data)].copy()
    edge[0] = True
    fresh = ink.copy()
    fresh[1:] &= edge[1:] | ~ink[:-1]
    starts = np.flatnonzero(fresh)
    stop = ink.copy()
    stop[:-1] &= edge[1:] | ~ink[1:]
    ends = np.flatnonzero(stop) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def word_hashes(texts: pa.Array, lower: bool = False, space: np.ndarray = _SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole texts in groups of about a piece: yields (index of the group's first text, bounds of
    each text's words in the arrays, hashes, starts, ends); positions are bytes from the start of
    the array's data. A null text is the empty text. ``space`` marks the bytes between words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    values = _LOWER if lower else _VALUES
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        lo, hi = int(at[i]), int(at[j])
        parts, a = [], lo
        while a < hi:
            b = min(a + PIECE, hi)
            while b < hi and not space[data[b]]:
                ahead = np.flatnonzero(space[data[b : b + PIECE]])
                b = b + int(ahead[0]) if len(ahead) else min(b + PIECE, hi)
            first = np.zeros(b - a + 1, bool)
            inside = at[i:j][(at[i:j] >= a) & (at[i:j] < b)]
            first[inside - a] = True
            h, s, e = _piece(data[a:b], first, values, space)
            parts.append((h, s + a, e + a))
            a = b
        h, s, e = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield i, np.searchsorted(s, at[i : j + 1], "left"), h, s, e
        i = j


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """The hash of every run of ``size`` consecutive word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    own = mixed(hashes + np.uint64(seed * 0x9E3779B97F4A7C15 & _MASK)) if seed else hashes
    up, down = powers(len(own) + 1)
    sums = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(own * up[:-1], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * down[:n])
