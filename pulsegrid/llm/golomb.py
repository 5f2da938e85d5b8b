"""Golomb-Rice codes of sorted integers: quotients in unary, remainders in fixed width, each in its own stream."""
from __future__ import annotations

import struct

import numpy as np


def encode(values: np.ndarray) -> bytes:
    """Code a sorted array of unsigned 64-bit integers (repeats allowed)."""
    n = len(values)
    if not n:
        return struct.pack("<IB", 0, 0)
    gap = np.diff(values, prepend=np.zeros(1, np.uint64)).astype(np.uint64)
    mean = max(1.0, float(values[-1]) / n)
    k = min(57, max(0, int(np.log2(mean))))
    q = (gap >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(q.sum()) + n, np.uint8)
    unary[np.cumsum(q + 1) - 1] = 0
    rest = gap & np.uint64((1 << k) - 1)
    low = ((rest[:, None] >> np.arange(k, dtype=np.uint64)[::-1]) & np.uint64(1)).astype(np.uint8)
    head = np.packbits(unary).tobytes()
    return struct.pack("<IBI", n, k, len(head)) + head + np.packbits(low.ravel()).tobytes()


def decode(blob: bytes) -> np.ndarray:
    n, k = struct.unpack_from("<IB", blob)
    if not n:
        return np.zeros(0, np.uint64)
    size, = struct.unpack_from("<I", blob, 5)
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, size, 9))
    ends = np.flatnonzero(unary == 0)[:n]
    q = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    low = np.unpackbits(np.frombuffer(blob, np.uint8, offset=9 + size))[:n * k].reshape(n, k)
    rest = np.zeros(n, np.uint64)
    for j in range(k):
        rest = (rest << np.uint64(1)) | low[:, j]
    return np.cumsum((q << np.uint64(k)) | rest, dtype=np.uint64)
