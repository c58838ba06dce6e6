"""Removal of byte strings that occur in an earlier document, by suffix sorting.

Suffixes are dealt into shards in such a way that all places of a repeated
string of ``size`` bytes meet: a string goes by its anchor, the run of bytes in
it with the smallest hash, which is the same wherever the string stands. Strings
at neighbouring places mostly share their anchor; what they cover together is a
span. A first exchange finds which anchors have several spans, and which
document first has each span: later documents lose the whole span, and a span
can't share a string with anything unless another one with its anchor agrees
with it on one side of the anchor as well.

The spans left, one copy of each, are the shards' text, of which a shard leaves
out the ends and the texts without any string whose hash another document's text
has there. The suffixes of the rest are sorted by external induction (see ``induced``), whose queues go to disk beyond a
memory limit and carry common prefixes; neighbours that share ``size`` bytes are
one string, and the smallest doc_id among them keeps it. An anchor with many
spans would make one shard large, so its strings go by their own hash instead.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import packed, session
from .induced import DEPTH, sorted_suffixes
from .session import light
from .words import buffers, covered, mix, windows

ANCHOR = 24
#: An anchor with more different spans than this is a hot one.
MANY = 64
_NO_ID = np.iinfo(np.int64).max

#: Bits that stand for an anchor. Anchors that share them are told apart by what stands on their sides.
KEY = 38

ANCHORS = "bucket int, piece int, keys binary, spans binary, sides binary, unclear binary, docs binary"
STATES = "kind int, piece int, bucket int, a binary"
SPANS = "bucket int, piece int, bytes binary, sizes binary, docs binary"
OUT = "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>"

#: Places are looked at in blocks whose arrays fit a processor's cache.
_BLOCK = 1 << 15
_LOW = np.uint64(63)
_SHIFT = np.uint64(64 - KEY)


def slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from runs of powers of two."""
    if len(x) < width:
        return x[:0]
    run, step = x, 1
    while step * 2 <= width:
        run = np.minimum(run[:-step], run[step:])
        step *= 2
    n = len(x) - width + 1
    return np.minimum(run[:n], run[width - step : width - step + n])


def _scan(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the string at each place: its anchor's hash, its own, and where in it its anchor is, looked for from either side."""
    m = max(len(data) - size + 1, 0)
    anchor, strings, low, high = np.empty(m, np.uint64), np.empty(m, np.uint64), np.empty(m, np.uint8), np.empty(m, np.uint8)
    for a in range(0, m, _BLOCK):
        b = min(m, a + _BLOCK)
        raw = data[a : b + size - 1].astype(np.uint64) + np.uint64(1)
        strings[a:b] = windows(raw, size)
        grams = windows(raw, ANCHOR) & ~_LOW
        at = np.arange(a, a + len(grams), dtype=np.uint64)
        near = at & _LOW
        first, last = slide_min(grams | near, size - ANCHOR + 1), slide_min(grams | (_LOW - near), size - ANCHOR + 1)
        anchor[a:b] = first & ~_LOW
        at = at[: b - a]
        low[a:b], high[a:b] = ((first - at) & _LOW).astype(np.uint8), ((_LOW - (last & _LOW) - at) & _LOW).astype(np.uint8)
    return anchor, strings, low, high


def _order(key: np.ndarray, name: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Order by key, name and doc; few keys are equal."""
    order = np.argsort(key)
    k = key[order]
    same = np.append(False, k[1:] == k[:-1])
    at = np.flatnonzero(same | np.append(same[1:], False))
    own = order[at]
    order[at] = own[np.lexsort((doc[own], name[own], key[own]))]
    return order


class Spans:
    """A piece's spans, and the distinct ones in order of anchor and hash."""

    def __init__(self, rows: pa.Table, size: int, n: int) -> None:
        self.size = size
        self.data, self.offsets = data, offsets = buffers(rows["text"])
        ids = rows["doc_id"].cast(pa.int64()).fill_null(_NO_ID).to_numpy()
        anchor, self.strings, low, high = _scan(data, size)
        m = len(anchor)
        inside = np.ones(m, bool)
        for a, b in zip(np.maximum(offsets[:-1], offsets[1:] - size + 1).tolist(), offsets[1:].tolist()):
            inside[a:b] = False
        new = np.ones(m, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], m)[: len(heads)]
        begin, ends = heads[inside[heads]], ends[inside[heads]]
        # two strings cover at most twice their size, so longer runs are cut
        parts = -(-(ends - begin) // size)
        which = np.repeat(np.arange(len(begin)), parts)
        part = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.begin = begin = begin[which] + part * size
        self.count = np.minimum(ends[which] - begin, size)  # strings that start in a span
        self.doc = ids[np.searchsorted(offsets, begin, side="right") - 1] if len(begin) else np.zeros(0, np.int64)
        # an anchor is a minimum, so its hash is low; mixed again, it falls anywhere
        key, last = mix(anchor[begin]) >> _SHIFT << _SHIFT, begin + self.count - 1
        name = mix(self.strings[begin] ^ mix(self.strings[last] + self.count.astype(np.uint64)))
        self.low, self.high = (low[begin], low[last]), (high[begin], high[last])
        order = _order(key, name, self.doc)
        k, s = key[order], name[order]
        head = np.ones(len(order), bool)
        head[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        self.first = order[head]  # of each distinct span, where its smallest doc_id has it
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(head) - 1
        self.key, self.name, self.least = key[self.first], name[self.first], self.doc[self.first]
        self.at = packed.buckets(self.key, shards(n))

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the distinct spans; see _sides."""
        begin, f = self.begin[self.first], self.first
        return _sides(self.data, begin, begin + self.count[f] - 1, tuple(x[f] for x in self.low), tuple(x[f] for x in self.high), self.name, self.size)

    def states(self, answers: pa.Table) -> np.ndarray:
        out = np.zeros(len(self.first), np.uint8)
        for kind, b, a in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["a"]):
            if kind == 0:
                out[self.at[b] : self.at[b + 1]] = packed.unsqueeze(a.as_py(), np.uint8)
        return out


def _sides(data: np.ndarray, begin: np.ndarray, last: np.ndarray, low: tuple, high: tuple, name: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What stands on both sides of each span's anchor, 16 bits of a hash each, and whether that can't be told.

    A string that two spans share reaches at least half of what it has besides
    the anchor to one side of it, so the spans agree there. A side that no
    string of the span fills so far has a value of the span's own. An anchor
    that occurs again in its span says nothing. low, high: where the anchor is
    in a span's first and in its last string.
    """
    half = (size - ANCHOR) // 2
    place = begin + low[0]
    unclear = (place != last + high[1]) | (low[0] != high[0]) | (low[1] != high[1])
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))

    def side(at: np.ndarray, own: np.ndarray, fits: np.ndarray) -> np.ndarray:
        found = mix(eights[np.where(fits, at, 0)] ^ mix(eights[np.where(fits, at + half - 8, 0)] + np.uint64(1))) if half >= 8 else own
        return np.where(fits, found, own) & np.uint64(0xFFFF)

    left = side(place - half, name, place - half >= begin)
    right = side(place + ANCHOR, ~name, place + half + ANCHOR <= last + size)
    return ((left << np.uint64(16)) | right).astype(np.uint32), unclear | (half < 8)


def shards(n: int) -> int:
    """Buckets of n pieces' anchors, and shards of their text: fewer than pieces, as each piece sends each a
    message, and of its text only repeated anchors' spans are sorted."""
    return -(-n // 4)


def _send(size: int, n: int):
    def send(rows: pa.Table) -> pa.Table:
        x = Spans(rows, size, n)
        piece, out = rows["piece"][0].as_py(), []
        side, unclear = x.sides()
        name, low = (x.name >> np.uint64(32)).astype(np.uint32), packed.bounds(shards(n))
        for b in np.flatnonzero(np.diff(x.at)):
            s = slice(x.at[b], x.at[b + 1])
            out.append((int(b), piece, packed.narrow((np.diff(x.key[s] >> _SHIFT, prepend=low[b] >> _SHIFT)).view(np.int64)), name[s].tobytes(), side[s].tobytes(), np.packbits(unclear[s]).tobytes(), packed.narrow(x.least[s])))
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["bucket", "piece", "keys", "spans", "sides", "unclear", "docs"])

    return send


#: States of a distinct span of a piece: nothing to do; an earlier document has it; compare its strings; compare them one by one.
ALONE, EARLIER, COMPARE, HOT = range(4)


def _judge(rows: pa.Table) -> pa.Table:
    keys = [np.cumsum(packed.unnarrow(x.as_py())).view(np.uint64) for x in rows["keys"]]  # from the bucket's lower bound
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    key, doc = np.concatenate(keys), np.concatenate([packed.unnarrow(x.as_py()) for x in rows["docs"]])
    name, side = (np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in rows[c]]) for c in ("spans", "sides"))
    unclear = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(k)).astype(bool) for x, k in zip(rows["unclear"], keys)])
    name = (name.astype(np.uint64) << np.uint64(32)) | side  # equal spans have equal sides
    order = _order(key, name, doc)
    k, s, d = key[order], name[order], doc[order]
    new_key = np.append(True, k[1:] != k[:-1])
    head = new_key | np.append(True, s[1:] != s[:-1])
    number = np.cumsum(head) - 1
    at = order[head]
    least = d[head][number]
    group = (np.cumsum(new_key) - 1)[head]
    spans = np.bincount(group)
    # only an anchor with several spans asks for more
    many = np.flatnonzero(spans[group] > 1)
    own, side = group[many], side[at[many]]
    near = (np.bincount(own, weights=unclear[at[many]], minlength=len(spans)) > 0)[own]
    for shift in (16, 0):
        _, which, times = np.unique((own << 16) | ((side >> shift) & 0xFFFF).astype(np.int64), return_inverse=True, return_counts=True)
        near |= times[which] > 1
    compare = np.full(len(at), ALONE, np.uint8)
    compare[many] = np.where(near, np.where(spans[own] > MANY, HOT, COMPARE), ALONE)
    state = np.where(d > least, EARLIER, compare[number]).astype(np.uint8)
    back = np.empty(len(order), np.uint8)
    back[order] = state
    parts = np.split(back, cuts)
    some = [i for i, p in enumerate(parts) if p.any()]
    return pa.table({
        "kind": pa.array([0] * len(some), pa.int32()),
        "piece": rows["piece"].take(pa.array(some, pa.int64())),
        "bucket": rows["bucket"].take(pa.array(some, pa.int64())),
        "a": pa.array([packed.squeeze(parts[i]) for i in some], pa.binary()),
    })


def _texts(x: Spans, state: np.ndarray, n: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """What a piece sends to each shard, in order: begin, number of strings, and doc_id of each text."""
    whole = np.flatnonzero(state == COMPARE)
    hot = np.flatnonzero(state == HOT)
    many = x.count[x.first[hot]]
    single = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(x.begin[x.first[hot]], many)
    doc = np.repeat(x.least[hot], many)
    name = x.strings[single]
    order = np.lexsort((doc, name))
    new = np.append(True, name[order][1:] != name[order][:-1])[: len(order)]
    single, doc = single[order][new], doc[order][new]
    begin = np.concatenate([x.begin[x.first[whole]], single])
    count = np.concatenate([x.count[x.first[whole]], np.ones(len(single), np.int64)])
    docs = np.concatenate([x.least[whole], doc])
    shard = (mix(np.concatenate([x.key[whole], x.strings[single]])) >> np.uint64(32)).astype(np.int64) * n >> 32
    order = np.argsort(shard, kind="stable")
    at = np.searchsorted(shard[order], np.arange(n + 1))
    return [(int(b), begin[o], count[o], docs[o]) for b in np.flatnonzero(np.diff(at)) for o in [order[at[b] : at[b + 1]]]]


def _send_texts(size: int, n: int):
    def send(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows:
            x = Spans(rows, size, n)
            piece = rows["piece"][0].as_py()
            for b, begin, count, docs in _texts(x, x.states(answers), shards(n)):
                long = count + size - 1
                take = np.arange(int(long.sum())) + np.repeat(begin - np.cumsum(long) + long, long)
                out.append((b, piece, packed.squeeze(x.data[take]), packed.small(count), packed.narrow(docs)))
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 3
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["bucket", "piece", "bytes", "sizes", "docs"])

    return send


def _shared(data: np.ndarray, count: np.ndarray, docs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which texts have strings whose hash another document's texts have too, the first of these, and how many strings there are from it to the last."""
    m = max(len(data) - size + 1, 0)
    hashes = np.empty(m, np.uint64)
    for a in range(0, m, _BLOCK):
        b = min(m, a + _BLOCK)
        hashes[a:b] = windows(data[a : b + size - 1].astype(np.uint64) + np.uint64(1), size)
    start = np.cumsum(count) - count
    text = np.repeat(np.arange(len(count), dtype=np.int32), count)
    hashes = hashes[np.arange(len(text)) + text.astype(np.int64) * (size - 1)]
    order = np.argsort(hashes)
    hashes = hashes[order]
    same = hashes[1:] == hashes[:-1]
    again = np.append(same, False) | np.append(False, same)
    order, hashes = order[again], hashes[again]
    if not len(order):
        return order, order, order
    doc = docs[text[order]]
    heads = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    several = np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads)
    found = np.sort(order[np.repeat(several, np.diff(np.append(heads, len(order))))])
    own = text[found]
    new = np.append(True, own[1:] != own[:-1])[: len(own)]
    first, last = found[new], found[np.append(new[1:], True)[: len(own)]]
    which = own[new].astype(np.int64)
    return which, first - start[which], last - first + 1


def _sort(size: int):
    def sort(rows: pa.Table) -> pa.Table:
        raw = [packed.unsqueeze(x.as_py(), np.uint8) for x in rows["bytes"]]
        counts = [packed.unsmall(x.as_py()) for x in rows["sizes"]]
        docs = np.concatenate([packed.unnarrow(x.as_py()) for x in rows["docs"]])
        sent, data = np.concatenate(counts), np.concatenate(raw)
        # what a text shares with no other need not be sorted
        which, first, count = _shared(data, sent, docs, size)
        if not len(which):
            return pa.table({c: pa.array([], pa.binary() if c == "a" else pa.int32()) for c in ("kind", "piece", "bucket", "a")})
        docs, long = docs[which], count + size - 1
        begin = (np.cumsum(sent + size - 1) - (sent + size - 1))[which] + first
        data = data[np.arange(int(long.sum())) + np.repeat(begin - np.cumsum(long) + long, long)]
        text, place, common = sorted_suffixes(data, long)
        real = place < count[text]  # suffixes that hold a whole string
        # a suffix that is left out passes its common prefix on to the next
        heads = np.flatnonzero(common < size)
        group = np.searchsorted(heads, np.arange(len(common)), side="right") - 1
        text, place, group = text[real], place[real], group[real]
        least = np.full(len(heads), _NO_ID)
        np.minimum.at(least, group, docs[text])
        gone = least[group] < docs[text]
        start = (np.cumsum(sent) - sent)[which] + first
        bits = np.zeros(int(sent.sum()), bool)
        bits[start[text[gone]] + place[gone]] = True
        parts = np.split(bits, np.cumsum([int(c.sum()) for c in counts])[:-1])
        some = [i for i, p in enumerate(parts) if p.any()]
        return pa.table({
            "kind": pa.array([1] * len(some), pa.int32()),
            "piece": rows["piece"].take(pa.array(some, pa.int64())),
            "bucket": rows["bucket"].take(pa.array(some, pa.int64())),
            "a": pa.array([np.packbits(parts[i]).tobytes() for i in some], pa.binary()),
        })

    return sort


def _remove(size: int, n: int):
    def remove(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "kept": pa.array([], pa.binary()), "spans": pa.array([], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})
        x = Spans(rows, size, n)
        state = x.states(answers)
        bits = {b: a.as_py() for kind, b, a in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["a"]) if kind == 1}
        total = len(x.data)
        starts = np.zeros(total + 1, np.int32)
        # a span that an earlier document has, here or elsewhere, goes whole
        gone = np.flatnonzero((state[x.of] == EARLIER) | (x.doc > x.least[x.of]))
        np.add.at(starts, x.begin[gone], 1)
        np.add.at(starts, x.begin[gone] + x.count[gone], -1)
        starts = np.cumsum(starts[:total]) > 0
        hot = []
        for b, begin, count, _ in _texts(x, state, shards(n)):
            if b in bits:
                own = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=int(count.sum())).astype(bool)
                at = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
                starts[at[own]] = True
                hot.append(at[own & np.repeat(count == 1, count)])
        # a span was sent for one place; its other places in that document lose the same strings
        again = np.flatnonzero((state[x.of] == COMPARE) & (x.doc == x.least[x.of]) & (x.first[x.of] != np.arange(len(x.of))))
        many = x.count[again]
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        starts[np.repeat(x.begin[again], many) + step] |= starts[np.repeat(x.begin[x.first[x.of[again]]], many) + step]
        hot_spans = np.flatnonzero(state[x.of] == HOT)
        if len(hot_spans):  # strings sent for one place stand for all equal ones; a later document here loses them anyway
            many = x.count[hot_spans]
            at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(x.begin[hot_spans], many)
            name, doc = x.strings[at], np.repeat(x.doc[hot_spans], many)
            order = np.lexsort((doc, name))
            head = np.append(True, name[order][1:] != name[order][:-1])
            least = doc[order][np.flatnonzero(head)][np.cumsum(head) - 1]
            found = np.unique(x.strings[np.concatenate(hot)]) if hot else np.zeros(0, np.uint64)
            starts[at[order][(doc[order] > least) | np.isin(name[order], found)]] = True
        lost = covered(starts, size, total)
        offsets, m = x.offsets, rows.num_rows
        text = np.repeat(np.arange(m), np.diff(offsets))
        opens = lost & np.append(True, ~lost[:-1] | (text[1:] != text[:-1]))[:total]
        closes = lost & np.append(~lost[1:] | (text[1:] != text[:-1]), True)[:total]
        a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        own = text[a]
        spans = pa.StructArray.from_arrays([pa.array(a - offsets[own], pa.int64()), pa.array(b - offsets[own], pa.int64())], ["start", "end"])
        kept = np.concatenate([[0], np.cumsum(~lost)])[offsets]
        flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), m, [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(x.data[~lost])])
        return pa.table({
            "doc_id": pc.cast(rows["doc_id"], pa.int64()),
            "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "kept": flat.cast(pa.binary()),
            "spans": pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(m + 1)), pa.int32()), spans),
        })

    return remove


def suffix_dedup(docs: DataFrame, size: int = 50) -> DataFrame:
    """Remove each byte covered by a string of ``size`` bytes that also starts in a document with a smaller doc_id.

    size: from ``ANCHOR + 1`` to ``induced.DEPTH``. Returns for each row of
    ``docs`` (doc_id, text; other columns are not read): doc_id, n_bytes, kept
    (the remaining bytes) and spans (removed runs, in bytes). A null or empty
    text has no bytes. Rows of one doc_id are the same document in the order of
    documents, so they lose nothing to each other; rows without doc_id come
    after all others. An empty table gives an empty result.
    """
    if not ANCHOR < size <= DEPTH:
        raise ValueError(f"size must be from {ANCHOR + 1} to {DEPTH}")
    n = session.pieces(docs)
    pieces = session.in_pieces(docs, "doc_id", "text", n=n)
    by_piece = pieces.groupBy("piece")
    sent = by_piece.applyInArrow(light(_send(size, n)), ANCHORS)
    states = session.cut(sent.groupBy("bucket").applyInArrow(light(_judge), STATES))
    texts = by_piece.cogroup(states.groupBy("piece")).applyInArrow(light(_send_texts(size, n)), SPANS)
    bits = texts.groupBy("bucket").applyInArrow(light(_sort(size)), STATES)
    return by_piece.cogroup(states.union(bits).groupBy("piece")).applyInArrow(light(_remove(size, n)), OUT)
