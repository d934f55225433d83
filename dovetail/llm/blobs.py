"""Numpy arrays as compact binary values: the rows that operators exchange in place of one row for each word."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import struct

import numpy as np
import pyarrow as pa
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one dimension as bytes: byte planes, compressed with zstandard."""
    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<4sQ", a.dtype.str.encode(), len(a)) for a in arrays)
    raw = np.empty(len(head) + sum(a.nbytes for a in arrays), np.uint8)
    raw[: len(head)] = np.frombuffer(head, np.uint8)
    at = len(head)
    for a in arrays:
        raw[at : at + a.nbytes].reshape(a.dtype.itemsize, len(a))[:] = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
        at += a.nbytes
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + 12 * n, []
    for i in range(n):
        kind, size = struct.unpack_from("<4sQ", raw, 4 + 12 * i)
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        width = dtype.itemsize
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype) if size else np.zeros(0, dtype))
        at += size * width
    return out


def gaps(sorted_keys: np.ndarray) -> np.ndarray:
    """Differences of ascending keys, which compress better; undone by a running sum."""
    return np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0)) if len(sorted_keys) else sorted_keys


def ungap(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=differences.dtype)


def trim() -> None:
    """Gives freed memory back to the system: a task's worker lives on, idle, beside those of the next stage."""
    with contextlib.suppress(Exception):
        pa.default_memory_pool().release_unused()
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@functools.cache
def map_large() -> None:
    """From now on this process maps each array of a megabyte on its own, so its memory goes back with it; malloc else raises that
    limit as it goes and keeps the arrays in its heap."""
    with contextlib.suppress(Exception):
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)


def tidy(run):
    """A generator over batches that trims when it ends."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


def tidied(function):
    """A function of one frame that trims when it ends."""

    def inner(pdf):
        try:
            return function(pdf)
        finally:
            trim()

    return inner


def tidied_pair(function):
    """A function of two frames that trims when it ends."""

    def inner(left, right):
        try:
            return function(left, right)
        finally:
            trim()

    return inner
