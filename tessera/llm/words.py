"""Words of many texts at once, as NumPy arrays over their UTF-8 bytes.

A word is a maximal run of bytes of one class inside a text. Its 64-bit hash
depends on its bytes alone, so equal words have equal hashes on any executor.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LONG_WORD = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Alphabet:
    """inside: which bytes belong to words; to: what each byte counts as."""

    inside: np.ndarray
    to: np.ndarray

    @classmethod
    def of(cls, outside: bytes, lower: bool = False) -> Alphabet:
        inside = np.ones(256, bool)
        inside[list(outside)] = False
        to = np.arange(256, dtype=np.uint8)
        if lower:
            to[65:91] += 32
        return cls(inside, to)


_SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Words [^\x20\x09-\x0D]+, as they are and with A-Z lower-cased.
SPACED = Alphabet.of(_SPACE)
SPACED_LOWER = Alphabet.of(_SPACE, lower=True)
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM_LOWER = Alphabet.of(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins and the last ends; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of texts with at most so many bytes, or of one text."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


@dataclass
class Words:
    """All words of texts: bytes [start, end) of data, and the text of each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # index of each text's first word; one more entry at the end

    def hashes(self, seed: int = 0) -> np.ndarray:
        size = self.end - self.start
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(self.data) + 1,), "<u8", padded, 0, (1,))
        h = mix(size.astype(np.uint64) * _ODD + np.uint64(seed * 2 + 1))
        live, at = np.arange(len(size)), self.start
        left = size
        if len(size) and int(size.max()) > LONG_WORD:
            long = np.flatnonzero(size > LONG_WORD)
            for i in long:
                digest = hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest()
                h[i] = int.from_bytes(digest, "little")
            live = np.flatnonzero(size <= LONG_WORD)
            at, left = self.start[live], size[live]
        while len(live):
            v = eights[at]
            short = left < 8
            v[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            h[live] = mix(h[live] ^ (v * _ODD))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        return h


def words(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> Words:
    inside, n = alphabet.inside[data], len(data)
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True  # a text ends words; empty texts at the end point past the data
    begins = begins[:n]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | begins))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:] & ~begins[1:]
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(alphabet.to[data], start, end, text, first)


_BASE = 0xD6E8FEB86659FD93


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of each run of ``size`` values, modulo 2**64, put together
    from runs of powers of two; fewer values than ``size`` give none."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    run, width, out, have = h, 1, None, 0
    while True:
        if size & width:
            if out is None:
                out, have = run, width
            else:
                n = len(h) - (have + width) + 1
                out = out[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + run[have : have + n]
                have += width
        if width * 2 > size:
            break
        n = len(h) - 2 * width + 1
        run = run[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + run[width : width + n]
        width *= 2
    return mix(out)


def whole(text: np.ndarray, size: int) -> np.ndarray:
    """Which runs of ``size`` words lie in one text."""
    if len(text) < size:
        return np.zeros(0, bool)
    return text[: len(text) - size + 1] == text[size - 1 :]


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in a run of ``size`` that begins at a marked start."""
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[np.minimum(at + size, n)] -= 1
    return np.cumsum(edge[:n]) > 0
