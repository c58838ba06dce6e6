"""Suffix sorting by induction, with queues and arrays that go to disk.

The suffixes of many short strings are sorted, and neighbours get the length of
their common prefix. The strings between local minima get ranks, and the runs
of these ranks, a third as long as the text, are sorted first, by doubling.
Suffixes that begin a minimum then induce the order of all falling suffixes,
and these that of all rising ones: whenever a suffix leaves the queue, the
suffix one place before it joins the queue of its own first symbol.
Queues are first in, first out, one for each symbol, so each holds its suffixes
in order, and together they are a priority queue. Its entries are a place and a
common-prefix length: one more than the least among the entries that left since
the queue's last one joined. Entries beyond a memory limit wait in a temporary
file, and so do the shard's text, the falling suffixes and the result: beyond
the limit they are mapped files, which the system writes out as it needs room.

A suffix ends with its string; order and prefixes are exact for ``DEPTH``
symbols, more than any caller compares.
"""

from __future__ import annotations

import tempfile

import numpy as np

DEPTH = 64
MEMORY = 64 << 20
#: Larger than any common prefix that is kept; those are cut at MOST.
_FAR, _MOST = 255, 200


def room(n: int, kind, memory: int) -> np.ndarray:
    """An array of zeros, a mapped file if it is larger than ``memory``."""
    kind = np.dtype(kind)
    if n * kind.itemsize <= memory:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile() as f:  # has no name already; the mapping keeps it alive
        f.truncate(n * kind.itemsize)
        return np.memmap(f, kind, "r+", shape=(n,))


def lowest(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each range [a, b) of x, none of them empty, from ranges of powers of two."""
    size = b - a
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(a), x.dtype)
    run = x
    for k in range(int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(run[a[at]], run[b[at] - (1 << k)])
        run = np.minimum(run[: -(1 << k)], run[1 << k :])
    return out


class Queues:
    """A first-in-first-out queue of (place, common prefix) for each symbol."""

    def __init__(self, symbols: int, memory: int = MEMORY) -> None:
        self.held: list[list] = [[] for _ in range(symbols)]
        self.least = np.full(symbols, _FAR, np.uint8)  # smallest common prefix since a queue's last entry joined
        self.memory, self.used, self.file = memory, 0, None

    def join(self, symbol: int, place: np.ndarray, common: np.ndarray) -> None:
        if self.used + 5 * len(place) > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(0, 2)
            self.held[symbol].append((self.file.tell(), len(place)))
            self.file.write(place.tobytes())
            self.file.write(common.tobytes())
        else:
            self.used += 5 * len(place)
            self.held[symbol].append((place, common))

    def leave(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All entries that wait now."""
        if not self.held[symbol]:
            return None
        parts = []
        for x, y in self.held[symbol]:
            if isinstance(x, int):
                self.file.seek(x)
                parts.append((np.frombuffer(self.file.read(4 * y), np.int32), np.frombuffer(self.file.read(y), np.uint8)))
            else:
                self.used -= 5 * len(x)
                parts.append((x, y))
        self.held[symbol] = []
        return parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts)))

    def induce(self, text: np.ndarray, place: np.ndarray, common: np.ndarray, joins: np.ndarray) -> None:
        """Entries leave in this order, each with its common prefix with the one before; those marked send the place before theirs."""
        at = np.flatnonzero(joins)
        since = np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint8(_FAR))
        if not len(at):
            self.least = np.minimum(self.least, since[0])
            return
        symbol = text[place[at] - 1]
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        heads = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        ends = np.append(heads[1:], len(at))
        begin = np.append(0, at[:-1] + 1)
        begin[heads] = 0
        shared = lowest(common, begin, at + 1)
        own = symbol[heads]
        shared[heads] = np.minimum(shared[heads], self.least[own])
        shared = np.minimum(shared, _MOST) + np.uint8(1)
        self.least = np.minimum(self.least, since[0])
        self.least[own] = since[at[ends - 1] + 1]
        before = (place[at] - 1).astype(np.int32)
        for s, a, b in zip(own.tolist(), heads.tolist(), ends.tolist()):
            self.join(s, before[a:b], shared[a:b])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Shard:
    """Strings one after another, a separator before, between and after them."""

    def __init__(self, strings: np.ndarray, sizes: np.ndarray, memory: int) -> None:
        k, total = len(sizes), int(sizes.sum())
        n = total + k + 1
        if n >= 1 << 31:
            raise ValueError("a shard must have less than 2 GB")
        self.begins = np.cumsum(sizes) - sizes + np.arange(k) + 1
        self.text, self.raw, self.left = room(n, np.int16, memory), room(n + DEPTH + 8, np.uint8, memory), room(n, np.int32, memory)
        step = max(1, (1 << 20) // max(1, total // max(1, k)))
        firsts = np.cumsum(sizes) - sizes
        for a in range(0, k, step):  # a few strings at a time
            b = min(k, a + step)
            size, begin = sizes[a:b], self.begins[a:b]
            own = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            at = own + np.repeat(begin, size)
            part = strings[firsts[a] : firsts[a] + len(at)]
            self.text[at], self.raw[at], self.left[at] = part.astype(np.int16) + 1, part, np.repeat(size, size) - own
        self.words = np.ndarray((n + DEPTH,), "<u8", self.raw, 0, (1,))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes, up to a string's end or DEPTH."""
        out, live = np.full(len(a), DEPTH, np.int32), np.arange(len(a))
        x, y = a, b
        for d in range(0, DEPTH, 8):
            differ = self.words[x + d] ^ self.words[y + d]
            some = differ != 0
            low = differ[some] & (~differ[some] + np.uint64(1))
            out[live[some]] = d + ((np.frexp(low.astype(np.float64))[1] - 1) >> 3)
            live = live[~some]
            if not len(live):
                break
            x, y = a[live], b[live]
        return np.minimum(out, np.minimum(self.left[a], self.left[b])).astype(np.uint8)

    def minima(self, rising: np.ndarray) -> np.ndarray:
        """Places of local minima in the order of their suffixes' first DEPTH symbols.

        The string from one minimum to the next gets a rank, by symbols and by
        whether they rise, so that none is the beginning of another. A string
        is then a run of ranks, a third of its length, and runs are ranked by
        doubling.
        """
        text = self.text
        place = (np.flatnonzero(rising[1:] & ~rising[:-1]) + 1).astype(np.int32)
        place = place[text[place] > 0]
        n = len(place)
        if n < 2:
            return place
        last = np.append(np.diff(place) >= self.left[place[:-1]], True)  # of its string
        size = np.where(last, self.left[place], np.append(np.diff(place), 0)) + 1
        six = np.concatenate([(text.astype(np.uint64) << np.uint64(1)) | rising.astype(np.uint64), np.zeros(6, np.uint64)])
        two = (six[:-1] << np.uint64(10)) | six[1:]
        six = (((two[:-4] << np.uint64(20)) | two[2:-2]) << np.uint64(20)) | two[4:]
        del two

        def word(i: np.ndarray, d: int) -> np.ndarray:
            gone = (np.clip(6 - (size[i] - d), 0, 6) * 10).astype(np.uint64)
            return (six[place[i] + d] >> gone) << gone

        rank, live, d = np.zeros(n, np.int64), np.arange(n), 0
        while len(live):  # those with more symbols to compare
            self.refine(rank, live, word(live, d))
            d += 6
            live = live[size[live] > d] if d < DEPTH else live[:0]
        ends = np.flatnonzero(last)[np.searchsorted(np.flatnonzero(last), np.arange(n))]
        step = 1
        while step * 2 <= DEPTH:  # minima are two places apart at least
            live = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
            if not len(live):
                break
            after = live + step
            self.refine(rank, live, np.where(after <= ends[live], rank[np.minimum(after, n - 1)] + 1, 0).astype(np.uint64))
            step *= 2
        return place[np.argsort(rank, kind="stable")]

    @staticmethod
    def refine(rank: np.ndarray, live: np.ndarray, key: np.ndarray) -> None:
        """Ranks are the number of smaller ones; equal ranks, all of them live, are told apart by key."""
        if int(key.max()) >> 32:
            order = np.argsort(key)
            k = key[order]
            key = np.empty(len(order), np.int64)
            key[order] = np.cumsum(np.append(False, k[1:] != k[:-1]))
        both = (rank[live] << 32) | key.astype(np.int64)
        order = np.argsort(both)
        b = both[order]
        at = np.arange(len(b))
        group = np.maximum.accumulate(np.where(np.append(True, b[1:] >> 32 != b[:-1] >> 32), at, 0))
        first = np.maximum.accumulate(np.where(np.append(True, b[1:] != b[:-1]), at, 0))
        rank[live[order]] = (b >> 32) + first - group


def _drain(queues: Queues, symbol: int, send) -> tuple[np.ndarray, np.ndarray]:
    """Lets a symbol's entries leave, those included that join meanwhile. The first has nothing in common with the symbol before."""
    parts = []
    while (got := queues.leave(symbol)) is not None:
        place, common = got
        if not parts:
            common = common.copy()
            common[0] = 0
        parts.append((place, common))
        send(place, common)
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.uint8)
    return tuple(map(np.concatenate, zip(*parts)))


def sorted_suffixes(strings: np.ndarray, sizes: np.ndarray, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of strings of bytes, given one after another, in order.

    Returns the string of each suffix, its place there, and its common prefix
    with the suffix before it.
    """
    shard = Shard(strings, sizes, memory)
    text, n = shard.text, len(shard.text)
    # rising: smaller than the next different symbol's suffix
    run_ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    rises = np.append(text[run_ends[:-1]] < text[run_ends[:-1] + 1], True)
    rising = np.repeat(rises, np.diff(np.append(-1, run_ends)))
    rising[text == 0] = True
    minima = shard.minima(rising)
    seed_at = np.searchsorted(text[minima], np.arange(258))

    falling_place, falling_common = room(n, np.int32, memory), room(n, np.uint8, memory)
    falling_at = np.zeros(258, np.int64)
    queues, have = Queues(257, memory), 0
    for c in range(257):
        place, common = _drain(queues, c, lambda p, q, c=c: queues.induce(text, p, q, text[p - 1] >= c))
        falling_place[have : have + len(place)], falling_common[have : have + len(place)] = place, common
        have += len(place)
        falling_at[c + 1] = have
        if c:
            seeds = minima[seed_at[c] : seed_at[c + 1]]
            last = place[-1:] if len(place) else seeds[:0]
            shared = np.append(shard.common(last, seeds[:1]) if len(last) and len(seeds) else np.zeros(min(1, len(seeds)), np.uint8), shard.common(seeds[:-1], seeds[1:]))
        else:  # separators have nothing in common
            seeds = np.flatnonzero(text == 0).astype(np.int32)
            shared = np.zeros(len(seeds), np.uint8)
        if len(seeds):
            joins = seeds > 0
            joins[joins] = text[seeds[joins] - 1] > c
            queues.induce(text, seeds, shared, joins)
    queues.close()

    total = n - len(sizes) - 1
    places, commons, free = room(total, np.int32, memory), room(total, np.uint8, memory), total
    queues = Queues(257, memory)
    for c in range(256, 0, -1):
        up, up_common = _drain(queues, c, lambda p, q, c=c: queues.induce(text, p, q, rising[p - 1] & (text[p - 1] > 0) & (text[p - 1] <= c)))
        down, down_common = falling_place[falling_at[c] : falling_at[c + 1]], falling_common[falling_at[c] : falling_at[c + 1]]
        gap = shard.common(down[-1:], up[-1:]) if len(down) and len(up) else np.zeros(1, np.uint8)
        if len(down):
            # leaving in falling order: an entry's common prefix is with the one above it
            back, before = np.append(gap, down_common[:0:-1]), down[::-1] - 1
            queues.induce(text, down[::-1], back, rising[before] & (text[before] > 0) & (text[before] < c))
        # in rising order each risen entry's common prefix belongs to its successor
        a, b = free - len(up) - len(down), free - len(up)
        places[a:b], commons[a:b] = down, down_common
        places[b:free], commons[b:free] = up[::-1], np.append(gap, up_common[:0:-1])[: len(up)]
        free = a
    queues.close()
    which = room(n, np.int32, memory)
    which[shard.begins] = 1
    np.cumsum(which, out=which)
    which = which[places] - 1
    return which, places - shard.begins[which], commons
