"""Benchmark passages in training documents, found with suffix arrays.

Each shard of training documents, a few megabytes inside one task, gets the
suffix array of its word sequence, cut off after ``size`` words. Every suffix
of the benchmark is then looked up in it by binary search, which yields all
places of all verbatim matches; matches that follow one another on a diagonal
are one longer match. Shards need no shuffle, and a document lies in one shard.

Only suffixes that begin with enough benchmark words can match, so the array
holds no others. The benchmark is sent to executors in blocks of a bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import light
from .words import ALNUM_LOWER, buffers, slices, words

SHARD_BYTES = 4 << 20
#: Bytes of benchmark text of a block. What is built of it takes some 25 times as much, and a third of that is sent.
BLOCK_BYTES = 4 << 20


class Tests:
    """The windows of some benchmark items, sorted, as packed word numbers."""

    def __init__(self, items: list[tuple[object, str | None]], size: int) -> None:
        self.size = size
        self.names = sorted({str(i) for i, _ in items})
        number = {x: k for k, x in enumerate(self.names)}
        w = words(*buffers(pa.array([t or "" for _, t in items], pa.large_string())), ALNUM_LOWER)
        h = w.hashes()
        self.vocabulary = np.unique(h)
        ids = np.searchsorted(self.vocabulary, h) + 1
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        count = np.diff(w.first)
        many = np.where(count > 0, np.maximum(count - size, 0) + 1, 0)
        place, item = _ragged(np.zeros(len(many), np.int64), many)
        length = np.minimum(count, size)[item]
        begin, top = w.first[item] + place, (1 << self.bits) - 1
        rows = np.zeros((len(begin), size), np.uint64)
        for j in range(size):
            inside = length > j
            rows[inside, j] = ids[begin[inside] + j]
        low = self.packed(rows)
        for j in range(size):
            rows[length <= j, j] = top
        high = self.packed(rows)
        who = np.array([number[str(i)] for i, _ in items], np.int64)[item]
        order = np.lexsort((place, who, *low[::-1]))
        low, high, place, who, length = [x[order] for x in low], [x[order] for x in high], place[order], who[order], length[order]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for x in low:
            new[1:] |= x[1:] != x[:-1]
        heads = np.flatnonzero(new)
        self.low, self.high, self.length = [x[heads] for x in low], [x[heads] for x in high], length[heads]
        self.least = int(self.length.min(initial=size))
        # each window's places in items, and the items it is in
        again = ~new
        again[1:] &= (who[1:] == who[:-1]) & (place[1:] == place[:-1])
        self.who, self.place = who[~again], place[~again]
        self.places_at = np.append(np.searchsorted(np.flatnonzero(~again), heads), len(self.who))
        other = np.ones(len(self.who), bool)
        other[1:] = self.who[1:] != self.who[:-1]
        other[self.places_at[:-1]] = True
        self.items = self.who[other]
        self.items_at = np.append(np.searchsorted(np.flatnonzero(other), self.places_at[:-1]), len(self.items))

    def packed(self, rows: np.ndarray) -> list[np.ndarray]:
        """Word numbers as a few 64-bit integers in the same order."""
        per = 64 // self.bits
        out = []
        for a in range(0, self.size, per):
            key = np.zeros(len(rows), np.uint64)
            for c in range(a, a + per):
                key <<= np.uint64(self.bits)
                if c < self.size:
                    key |= rows[:, c].astype(np.uint64)
            out.append(key)
        return out


def _search(array: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of every wanted key in sorted keys of several integers."""
    n = len(array[0])
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n, np.int64)
    while (live := lo < hi).any():
        mid = np.minimum((lo + hi) // 2, n - 1)
        less, equal = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for have, want in zip(array, wanted):
            v = have[mid]
            less |= equal & (v < want)
            equal &= v == want
        down = (less | equal) if right else less
        lo = np.where(live & down, mid + 1, lo)
        hi = np.where(live & ~down, mid, hi)
    return lo


def _ragged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and the range of each."""
    size = end - begin
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + begin[which], which


def search_shard(data: np.ndarray, offsets: np.ndarray, tests: Tests) -> tuple:
    """For the texts of a shard: words of each, hit words (text, place), pairs (text, item), longest match of each."""
    w, n, size = words(data, offsets, ALNUM_LOWER), len(offsets) - 1, tests.size
    counts, none = np.diff(w.first), np.zeros(0, np.int64)
    nothing = counts, none, none, none, none, np.zeros(n, np.int64)
    if not len(tests.length) or not len(w.start):
        return nothing
    h = w.hashes()
    k = np.minimum(np.searchsorted(tests.vocabulary, h), len(tests.vocabulary) - 1)
    ids = np.where(tests.vocabulary[k] == h, k + 1, 0)
    # the suffix array: places whose first words are all benchmark words, in order of their next words
    known = np.flatnonzero(ids)
    last = w.first[w.text[known] + 1]
    live = known + tests.least <= last
    for j in range(1, tests.least):
        live &= ids[np.minimum(known + j, len(ids) - 1)] > 0
    known, last = known[live], last[live]
    if not len(known):
        return nothing
    rows = np.zeros((len(known), size), np.uint64)
    for j in range(size):
        at = known + j
        ok = at < last
        rows[ok, j] = ids[at[ok]]
    keys = tests.packed(rows)
    order = np.lexsort(keys[::-1])
    keys, suffixes = [x[order] for x in keys], known[order]
    begin, end = _search(keys, tests.low, False), _search(keys, tests.high, True)
    found = np.flatnonzero(end > begin)
    if not len(found):
        return nothing
    at, which = _ragged(begin[found], end[found])
    place, window = suffixes[at], found[which]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + tests.length[window], -1)
    hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    pick, of = _ragged(tests.items_at[window], tests.items_at[window + 1])
    pairs = np.unique(w.text[place[of]] * len(tests.names) + tests.items[pick])
    # a match goes on while the next place matches the item's next window
    pick, of = _ragged(tests.places_at[window], tests.places_at[window + 1])
    spots = np.stack([tests.who[pick], tests.place[pick]], axis=1)
    diagonal = np.lexsort((place[of], place[of] - spots[:, 1], spots[:, 0], w.text[place[of]]))
    p, d, t = place[of][diagonal], (place[of] - spots[:, 1])[diagonal], w.text[place[of]][diagonal]
    i = spots[:, 0][diagonal]
    new = np.append(True, (p[1:] != p[:-1] + 1) | (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (t[1:] != t[:-1]))
    heads = np.flatnonzero(new)
    runs = np.diff(np.append(heads, len(p))) - 1 + tests.length[window[of][diagonal][heads]]
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, t[heads], runs)
    return counts, w.text[hit], hit - w.first[w.text[hit]], pairs // len(tests.names), pairs % len(tests.names), longest


def _matches(tests, first: bool, last: bool):
    """Adds to each row: n_words, hits (places of hit words), items, longest."""

    def matches(batches):
        t = tests.value
        for batch in batches:
            data, offsets = buffers(batch["text"])
            for a, b in slices(offsets, SHARD_BYTES):
                n_words, text, place, owner, item, longest = search_shard(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], t)
                rows, m = batch.slice(a, b - a), b - a
                hits = np.split(place, np.searchsorted(text, np.arange(1, m)))
                items = np.split(item, np.searchsorted(owner, np.arange(1, m)))
                names = [[t.names[i] for i in x] for x in items]
                if not first:
                    hits = [np.union1d(np.array(x or [], np.int64), y) for x, y in zip(rows["hits"].to_pylist(), hits)]
                    names = [sorted({*x, *y}) for x, y in zip(rows["items"].to_pylist(), names)]
                    longest = np.maximum(longest, rows["longest"].to_numpy(zero_copy_only=False))
                text = {} if last else {"text": rows["text"].cast(pa.string())}
                found = {"n_words": pa.array(n_words, pa.int64()), "hits": pa.array([x.astype(np.int32) for x in hits], pa.list_(pa.int32())), "items": pa.array(names, pa.list_(pa.string())), "longest": pa.array(longest, pa.int64())}
                yield pa.RecordBatch.from_pydict({"doc_id": rows["doc_id"].cast(pa.int64()), **text, **found})

    return matches


def _marked(tests, mark: str, first: bool):
    """Adds to each row the items that match."""

    def marked(batches):
        t = tests.value
        for batch in batches:
            data, offsets = buffers(batch.column(batch.schema.names.index("text")))
            for a, b in slices(offsets, SHARD_BYTES):
                *_, owner, item, _ = search_shard(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], t)
                rows = batch.slice(a, b - a)
                names = [[t.names[i] for i in x] for x in np.split(item, np.searchsorted(owner, np.arange(1, b - a)))]
                if not first:
                    names = [sorted({*x, *y}) for x, y in zip(rows.column(rows.num_columns - 1).to_pylist(), names)]
                columns = rows.columns if first else rows.columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.list_(pa.string()))], [*rows.schema.names[: len(columns)], mark])

    return marked


def _blocks(spark: SparkSession, benchmark: DataFrame, size: int):
    """The benchmark's windows in broadcast blocks of a bounded size, and whether each is the last."""
    items = benchmark.select(F.col("item_id"), F.col("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()  # a block's text is bounded
        yield spark.sparkContext.broadcast(Tests([tuple(x) for x in block], size)), k == blocks - 1


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, size: int = 8) -> DataFrame:
    """Verbatim matches of benchmark windows in each document.

    Returns for each row of ``docs`` (doc_id, text): doc_id, n_words,
    hits (places of the words inside a match), items (item_id of each item
    with a match, as sorted strings) and longest (words of the longest match).
    Null and empty texts have no words. An item with fewer than ``size`` words
    is one window, one without words none; items of one item_id count as one.
    An empty benchmark matches nothing.

    The benchmark goes to executors in blocks of about ``BLOCK_BYTES`` by a
    hash of item_id, and the documents pass the blocks one after another.
    """
    out = docs.select("doc_id", "text")
    schema = "doc_id long, text string, n_words long, hits array<int>, items array<string>, longest long"
    for k, (tests, last) in enumerate(_blocks(docs.sparkSession, benchmark, size)):
        out = out.mapInArrow(light(_matches(tests, k == 0, last)), schema.replace("text string, ", "") if last else schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 8, items: int = 1) -> DataFrame:
    """The rows of ``docs`` in which fewer than ``items`` benchmark items match, with all their columns.

    Decided row by row, so rows with equal or null doc_id are judged on their
    own texts; null and empty texts stay. Columns other than text pass through,
    whatever their names.
    """
    mark = "matched_items"
    while mark.lower() in {c.lower() for c in docs.columns}:
        mark += "_"
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs
    for k, (tests, _) in enumerate(_blocks(docs.sparkSession, benchmark, size)):
        out = out.mapInArrow(light(_marked(tests, mark, k == 0)), f"{fields}, {mark} array<string>")
    return out.filter(F.size(mark) < items).drop(mark)
