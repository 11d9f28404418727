"""Vectorised tokens and hashes over a column of texts: numpy over the column's bytes, no loop over rows.

Polynomial hashes are taken modulo 2**64 over values from a seeded random table and mixed at the end, so that
equal sequences always agree and others only by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_T = np.random.default_rng(20240229).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * U(2) + U(1)
BASES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are hashed at a time, and words. Hashing takes some 50 bytes of memory for each byte of these words.
SLICE, WORDS = 512 << 10, 1 << 15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (one more than rows); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> list[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each; a longer row stands alone."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (one more than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACES[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([True], space[:-1])) | edge[:-1]
    after = np.concatenate((space[1:], [True])) | edge[1:]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, k: int = 0) -> np.ndarray:
    """A 64-bit hash of every word; ``k`` picks one of two independent hashes. Words are taken ``WORDS`` at a time."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(0, len(starts), WORDS):
        out[i : i + WORDS] = _hashed(data, starts[i : i + WORDS], ends[i : i + WORDS], lower, k)
    return out


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, k: int) -> np.ndarray:
    lens = ends - starts
    power = np.cumprod(np.concatenate(([U(1)], np.full(int(lens.max()), BASES[k]))))
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    within = np.arange(int(lens.sum())) - np.repeat(first, lens)
    chars = data[within + np.repeat(starts, lens)]
    if lower:
        chars = _LOWER[chars]
    return mixed(np.add.reduceat(_T[k][chars] * power[within], first) + lens.astype(np.uint64) * BASES[1 - k])


def rolled(h: np.ndarray, n: int, k: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive values; shorter than ``h`` by n - 1."""
    return mixed(polynomials(h, n, k))


def polynomials(h: np.ndarray, n: int, k: int = 0) -> np.ndarray:
    """What ``rolled`` mixes, by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    powers, width = {1: h}, 1
    base = {1: int(BASES[k])}
    while width * 2 <= n:
        p = powers[width]
        powers[width * 2] = p[:-width] * U(base[width])
        powers[width * 2] += p[width:]
        base[width * 2] = base[width] * base[width] % (1 << 64)
        width *= 2
    out, done = None, 0
    for w in sorted(powers, reverse=True):
        while done + w <= n:
            part = powers[w][done:]
            if out is None:
                out = part.copy()
            else:
                out = out[: len(part)]
                out *= U(base[w])
                out += part[: len(out)]
            done += w
    return out[: len(h) - n + 1]


def row_of(first: np.ndarray) -> np.ndarray:
    """For each word the row it stands in."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
