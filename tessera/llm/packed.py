"""Sets of 64-bit keys as small byte strings, for shuffles.

A sorted array is kept as differences, laid out byte plane by byte plane and
compressed; the planes of high bytes are nearly all zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def squeeze(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unsqueeze(blob: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), np.dtype(dtype).itemsize
    raw = pa.Codec("zstd").decompress(blob[8:], decompressed_size=n, asbytes=True) if n else b""
    return np.frombuffer(np.frombuffer(raw, np.uint8).reshape(width, -1).T.tobytes(), dtype)


def pack(sorted_keys: np.ndarray) -> bytes:
    return squeeze(np.diff(sorted_keys, prepend=np.uint64(0)))


def unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(blob, np.uint64), dtype=np.uint64)


def narrow(a: np.ndarray) -> bytes:
    """64-bit integers that don't compress, in as many bytes each as the largest needs."""
    raw = np.ascontiguousarray(a, "<i8").view(np.uint8).reshape(-1, 8)
    top = int(a.view(np.uint64).max(initial=0)) if len(a) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    return bytes([width]) + raw[:, :width].tobytes()


def unnarrow(blob: bytes) -> np.ndarray:
    out = np.zeros(((len(blob) - 1) // blob[0], 8), np.uint8)
    out[:, : blob[0]] = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, blob[0])
    return out.view("<i8").ravel()


def small(counts: np.ndarray) -> bytes:
    """Counts, in as few bytes each as the largest needs."""
    most = int(counts.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    return bytes([width]) + squeeze(counts.astype(f"<u{width}"))


def unsmall(blob: bytes) -> np.ndarray:
    return unsqueeze(blob[1:], f"<u{blob[0]}").astype(np.int64)


def bounds(n: int) -> np.ndarray:
    """Where each of n equal ranges of 64-bit keys begins."""
    return np.array([(i << 64) // n for i in range(n)], np.uint64)


def buckets(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of keys begins in a sorted array, and its end."""
    return np.append(np.searchsorted(sorted_keys, bounds(n)), len(sorted_keys))


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the keys, where each group of equal keys begins, and the group of each sorted key."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1
