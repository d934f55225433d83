"""Vectorised word tokens of UTF-8 text held in Arrow buffers.

A word is a maximal run of bytes other than 9-13 and 32; A-Z count as a-z.  Words become 64-bit hashes, so
whole batches are handled in numpy without a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at once; a longer single text is handled alone.
CHUNK = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, U64), np.ones(0, U64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODE = mix(np.arange(256, dtype=U64))[LOWER]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n of each at least."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            both.append(np.cumprod(p))
        _powers = (both[0], both[1])
    return _powers


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a (large) binary or string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about `limit` bytes: first row, row after the last, bytes, offsets from 0."""
    data, at = binary_parts(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the place of its first word (n + 1 places)."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    word = ~WHITE[data]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    power, inverse = powers(n)
    total = np.zeros(n + 1, U64)
    np.cumsum(BYTE_CODE[data] * power[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(U64)), np.searchsorted(starts, at).astype(np.int64)


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and their texts' numbers; a text of 1 to k - 1 words is one shingle."""
    doc, n = owners(first), len(h)
    length = np.diff(first)
    whole = np.zeros(n, U64)
    ok = np.zeros(n, bool)
    if n >= k:
        m = n - k + 1
        for j in range(k):
            whole[:m] += mix(h[j : j + m] + U64(j + 1))
        ok[:m] = doc[:m] == doc[k - 1 :]
    short = np.flatnonzero((length > 0) & (length < k))
    for t in short:
        lo, hi = first[t], first[t + 1]
        whole[lo] = mix(h[lo:hi] + (U64(1) + np.arange(hi - lo, dtype=U64))).sum(dtype=U64) + U64(int(hi - lo))
        ok[lo] = True
    return mix(whole[ok]), doc[ok]
