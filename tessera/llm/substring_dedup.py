"""Removal of repeated token windows.

Every window of ``size`` consecutive words gets a Rabin-Karp hash. A first
shuffle counts the hashes: documents are dealt into pieces by doc_id, each
piece sends its sorted distinct hashes to buckets by value, and a bucket, which
sees a value's whole count, answers each piece with one bit for each hash. The
piece then merges repeated windows into maximal removal intervals.

A value that a third of all rows share reaches its bucket once from each piece,
so no task gathers a group of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import packed, session
from .session import light
from .words import SPACED, Words, buffers, covered, whole, windows, words

COUNTED = "bucket int, piece int, keys binary, again binary"
FLAGS = "piece int, bucket int, flags binary"
OUT = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>"


def _windows(texts: pa.ChunkedArray, size: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words, which places begin a window inside one text, and these windows' hashes."""
    data, offsets = buffers(texts)
    w = words(data, offsets, SPACED)
    inside = whole(w.text, size)
    return w, inside, windows(w.hashes(), size)[inside]


def _send(size: int, n: int):
    def send(rows: pa.Table) -> pa.Table:
        keys, counts = np.unique(_windows(rows["text"], size)[2], return_counts=True)
        at = packed.buckets(keys, n)
        full = np.flatnonzero(np.diff(at))
        return pa.table({
            "bucket": pa.array(full, pa.int32()),
            "piece": pa.array(np.full(len(full), rows["piece"][0].as_py()), pa.int32()),
            "keys": pa.array([packed.pack(keys[at[b] : at[b + 1]]) for b in full], pa.binary()),
            "again": pa.array([np.packbits(counts[at[b] : at[b + 1]] > 1).tobytes() for b in full], pa.binary()),
        })

    return send


def count_again(rows: pa.Table) -> pa.Table:
    """A bit for each key of each piece: whether it occurs again, in the piece or in another."""
    keys = [packed.unpack(x.as_py()) for x in rows["keys"]]
    own = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(k)).astype(bool) for x, k in zip(rows["again"], keys)]
    order, begins, group = packed.grouped(np.concatenate(keys))
    again = np.logical_or.reduceat(np.concatenate(own)[order], begins) | (np.diff(np.append(begins, len(order))) > 1)
    flags = np.empty(len(order), bool)
    flags[order] = again[group]
    parts = np.split(flags, np.cumsum([len(k) for k in keys])[:-1])
    some = [i for i, f in enumerate(parts) if f.any()]
    return pa.table({
        "piece": rows["piece"].take(pa.array(some, pa.int64())),
        "bucket": rows["bucket"].take(pa.array(some, pa.int64())),
        "flags": pa.array([np.packbits(parts[i]).tobytes() for i in some], pa.binary()),
    })


def joined(w: Words, kept: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each text's kept words with one space between them."""
    n = len(w.data)
    edge = np.zeros(n + 1, np.int8)
    edge[w.start[kept]] += 1
    np.subtract.at(edge, w.end[kept], 1)
    take = np.cumsum(edge[:n], dtype=np.int8) > 0
    own = w.text[kept]
    inner = w.end[kept][:-1][own[1:] == own[:-1]]
    out = w.data.copy()
    out[inner] = 0x20
    take[inner] = True
    where = np.concatenate([[0], np.cumsum(take)])[offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(where.astype(np.int64)), pa.py_buffer(out[take])).cast(pa.string())


def _merge(size: int, n: int):
    def merge(rows: pa.Table, answers: pa.Table) -> pa.Table:
        w, inside, h = _windows(rows["text"], size)
        keys, inverse = np.unique(h, return_inverse=True)
        at, flags = packed.buckets(keys, n), np.zeros(len(keys), bool)
        for b, x in zip(answers["bucket"].to_pylist(), answers["flags"]):
            flags[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=at[b + 1] - at[b])
        starts = np.zeros(len(inside), bool)
        starts[inside] = flags[inverse]
        gone = covered(starts, size, len(w.start))
        offsets = buffers(rows["text"])[1]
        # a removal interval begins at a removed word after a kept one or at a text's start
        opens = gone & np.append(True, ~gone[:-1] | (w.text[1:] != w.text[:-1]))[: len(gone)]
        closes = gone & np.append(~gone[1:] | (w.text[1:] != w.text[:-1]), True)[: len(gone)]
        a, b = np.flatnonzero(opens), np.flatnonzero(closes)
        own = w.text[a]
        spans = pa.StructArray.from_arrays([pa.array(a - w.first[own], pa.int32()), pa.array(b + 1 - w.first[own], pa.int32())], ["start", "end"])
        m = len(offsets) - 1
        return pa.table({
            "doc_id": pc.cast(rows["doc_id"], pa.int64()),
            "n_words": pa.array(np.diff(w.first), pa.int64()),
            "n_removed": pa.array(np.bincount(w.text[gone], minlength=m), pa.int64()),
            "kept_text": joined(w, ~gone, offsets),
            "spans": pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(m + 1)), pa.int32()), spans),
        })

    return merge


def substring_dedup(docs: DataFrame, size: int = 35) -> DataFrame:
    """Remove each word covered by a window of ``size`` words that also starts elsewhere.

    Returns for each row of ``docs`` (doc_id, text; other columns are not
    read): doc_id, n_words, n_removed, kept_text (kept words joined by one
    space) and spans (removed intervals, counted in words). A null or empty
    text, and one of fewer than ``size`` words, loses nothing; rows with equal
    or null doc_id are rows of their own, and a repeated row loses whatever
    windows it has. An empty table gives an empty result.

    Windows are told apart by 64 bits: among n distinct windows about
    n * n / 2**65 pairs are expected to be taken for each other.
    """
    n = session.pieces(docs)
    pieces = session.in_pieces(docs, "doc_id", "text", n=n)
    counted = pieces.groupBy("piece").applyInArrow(light(_send(size, n)), COUNTED)
    flags = counted.groupBy("bucket").applyInArrow(light(count_again), FLAGS)
    return pieces.groupBy("piece").cogroup(flags.groupBy("piece")).applyInArrow(light(_merge(size, n)), OUT)
