"""Minima of exponential variates, for MinHash and SetSketch registers.

Each element of a set starts a Poisson process; each of its points falls into
one of m registers at random, and a register keeps its earliest point. A
register's value is then the minimum of independent exponential variates, one
for each element, and two sets agree on a register with a probability of their
Jaccard similarity. Points come in order, so only those before the time by
which all registers are filled need be made: a few for each element instead of
m. What an element makes depends on its hash alone.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from .words import mix

_STEP = np.uint64(0xA0761D6478BD642F)
#: Fixed values of SetSketch: base of the registers' scale, rate, largest register.
BASE, RATE, LIMIT = 1.001, 20.0, 65535


def minima(h: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """An n x m array; h: hashes of elements, owner: the set of each, ascending; m: a power of two or less than 2048. An element may repeat. Sets without elements have infinite minima."""
    out = np.full(n * m, np.inf)
    size = np.bincount(owner, minlength=n)
    until = np.where(size > 0, (np.log(m) + 4) / np.maximum(size, 1), 0.0)
    pending = np.arange(len(h))
    while len(pending):
        for a in range(0, len(pending), 1 << 18):
            at = pending[a : a + (1 << 18)]
            x, own, time, j, width = h[at], owner[at], np.zeros(len(at)), 0, 2
            while len(at):
                u = mix(x[:, None] + _STEP * np.arange(j + 1, j + width + 1, dtype=np.uint64))
                gaps = np.log((u >> np.uint64(11)).astype(np.float64) + 0.5)
                gaps = (53 * np.log(2) - gaps) / m
                t = time[:, None] + np.cumsum(gaps, axis=1)
                ok = t <= until[own][:, None]
                r = ((u & np.uint64(2047)) * np.uint64(m) >> np.uint64(11)).astype(np.int64)
                np.minimum.at(out, (own[:, None] * m + r)[ok], t[ok])
                live = ok[:, -1]
                at, x, own, time = at[live], x[live], own[live], t[live, -1]
                j, width = j + width, min(width * 2, 256)
        # sets with an empty register need more time; all points are made again, to the same values
        short = np.isinf(out.reshape(n, m)).any(axis=1) & (size > 0)
        until[short] *= 2
        pending = pending[short[owner[pending]]]
    return out.reshape(n, m)


def signatures(h: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """MinHash signatures of m values with one hash for each element, an n x m array.

    An element falls into one of m places and brings a value; a place keeps the
    smallest. A place that none of a set's elements falls into takes the value
    of another one, in an order of places that is the same for all sets. Two
    sets agree on a place with a probability of their Jaccard similarity.
    h, owner: as for minima. Sets without elements have all places alike.
    """
    empty = np.uint32(0xFFFFFFFF)
    out = np.full(n * m, empty)
    for a in range(0, len(h), 1 << 17):
        u = mix(h[a : a + (1 << 17)] ^ _STEP)
        place = owner[a : a + (1 << 17)] * m + ((u & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out, place, (u >> np.uint64(32)).astype(np.uint32))
    out = out.reshape(n, m)
    some = np.zeros(n, bool)
    some[owner] = True
    row, column = np.nonzero((out == empty) & some[:, None])
    if len(row):
        first, turns = out.copy(), _others(m)
        for turn in range(8):
            value = first[row, turns[turn, column]]
            out[row, column] = value
            left = value == empty
            row, column = row[left], column[left]
        for a in range(0, len(row), 1 << 12):  # few elements: look at all places at once
            r, c = row[a : a + (1 << 12)], column[a : a + (1 << 12)]
            values = first[r[:, None], turns[:, c].T]
            out[r, c] = values[np.arange(len(r)), (values != empty).argmax(axis=1)]
    return out


@cache
def _others(m: int) -> np.ndarray:
    """For each of m places (a column) the order in which others stand in for it."""
    at = np.arange(m, dtype=np.uint64)
    return np.argsort(mix(at[:, None] * np.uint64(m) + at[None, :] + np.uint64(1)), axis=0)


def registers(minimum: np.ndarray) -> np.ndarray:
    """SetSketch registers: minima on an exponential scale, truncated to 16 bits. The registers of a union are the larger of two. 0 for empty sets."""
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(minimum / RATE) / np.log(BASE))
    return np.clip(np.where(np.isinf(minimum), 0, k), 0, LIMIT).astype(np.uint16)


def bands(values: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of the bands of ``rows`` values each; values: n x m of any fixed-size type."""
    n, m = values.shape
    raw = np.ascontiguousarray(values).view(f"u{values.dtype.itemsize}").astype(np.uint64).reshape(n, m // rows, rows)
    key = np.broadcast_to(mix(np.arange(1, m // rows + 1, dtype=np.uint64)), (n, m // rows)).copy()
    for r in range(rows):
        key = mix(key ^ (raw[:, :, r] * _STEP + np.uint64(r)))
    return key


def likeliest(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, base: float = BASE) -> np.ndarray:
    """Jaccard similarity of pairs of sets that makes their registers' order likeliest.

    x, y: registers, a row for each pair; nx, ny: sizes of the sets. Counts how
    often x is larger, y is larger, and they agree.
    """
    over, under = (x > y).sum(axis=1), (x < y).sum(axis=1)
    same = x.shape[1] - over - under
    u, v = nx / (nx + ny), ny / (nx + ny)

    def p(z):
        return -np.log1p(-np.clip(z, 0, 1) * (base - 1) / base) / np.log(base)

    def value(j):
        a, b = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return over * np.log(np.maximum(a, tiny)) + under * np.log(np.maximum(b, tiny)) + same * np.log(np.maximum(1 - a - b, tiny))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = value(a) < value(b)
        lo, hi = np.where(left, a, lo), np.where(left, hi, b)
    return (lo + hi) / 2
