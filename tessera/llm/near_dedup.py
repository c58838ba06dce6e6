"""Near-duplicate documents by SetSketch.

A document's set of word shingles becomes registers on an exponential scale.
Equal sets are one class; classes that share a band of registers are
candidates. The similarity that makes both registers' order likeliest, given
the sets' sizes, screens candidates with a wide margin, and the full sets
decide.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .session import cut, light
from .similarity import similar_components
from .words import SPACED_LOWER, buffers, slices, whole, windows, words

REGISTERS, ROWS = 128, 4
#: A candidate's estimate may lie this far below the threshold: over six standard deviations.
MARGIN = 0.2


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending in each text, and where each text's begin (one more entry)."""
    w = words(data, offsets, SPACED_LOWER)
    h, n, count = w.hashes(), len(offsets) - 1, np.diff(w.first)
    inside = whole(w.text, size)
    keys, owner = windows(h, size)[inside], w.text[: len(inside)][inside]
    for k in range(1, size):  # shorter texts are one shingle
        few = np.flatnonzero(count == k)
        if len(few):
            own = np.stack([h[w.first[few] + j] for j in range(k)])
            key = np.full(len(few), np.uint64(k))
            for j in range(k):
                key = sketch.mix(key ^ own[j])
            keys, owner = np.append(keys, key), np.append(owner, few)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    return keys, np.searchsorted(owner, np.arange(n + 1))


def _class(items: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketched(size: int):
    def sketched(batches):
        for batch in batches:
            data, offsets = buffers(batch["text"])
            for a, b in slices(offsets, 1 << 20):
                n = b - a
                keys, first = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                owner = np.repeat(np.arange(n), np.diff(first))
                reg = sketch.registers(sketch.minima(keys, owner, n, REGISTERS))
                some = np.diff(first) > 0
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(a, n).cast(pa.int64()),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array([_class(keys[first[k] : first[k + 1]]) if some[k] else None for k in range(n)], pa.int64()),
                    pa.array([x.tobytes() if s else None for x, s in zip(reg, some)], pa.binary()),
                ], ["doc_id", "n_shingles", "class", "registers"])

    return sketched


def _banded(batches):
    for batch in batches:
        reg = np.frombuffer(b"".join(x.as_py() for x in batch["registers"]), np.uint16).reshape(-1, REGISTERS)
        keys = sketch.bands(reg, ROWS).view(np.int64)
        per = keys.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch["class"].to_numpy(zero_copy_only=False), per))], ["band", "node"])


def _screened(least: float):
    def screened(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(v.as_py() for v in batch[c]), np.uint16).reshape(-1, REGISTERS) for c in ("a_reg", "b_reg"))
            guess = sketch.likeliest(x, y, batch["a_n"].to_numpy(zero_copy_only=False), batch["b_n"].to_numpy(zero_copy_only=False)) if len(x) else np.zeros(0)
            mask = pa.array(guess >= least)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], ["a", "b"])

    return screened


def _set_rows(size: int):
    def set_rows(batches):
        for batch in batches:
            data, offsets = buffers(batch["text"])
            for a, b in slices(offsets):
                keys, first = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                items = [keys[first[k] : first[k + 1]] for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([pa.array([_class(x) if len(x) else None for x in items], pa.int64()), pa.array([x.tobytes() for x in items], pa.binary())], ["node", "items"])

    return set_rows


def near_duplicates(docs: DataFrame, num: int = 4, den: int = 5, size: int = 5) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``num / den`` or more.

    Shingles are runs of ``size`` words, A-Z lower-cased; a shorter text is one
    shingle. Returns for each row of ``docs`` (doc_id, text; other columns are
    not read): doc_id, n_shingles, component_id (the smallest doc_id that links
    reach) and kept (doc_id = component_id). Null, empty and blank texts have no
    shingles and are linked with nothing. Rows of one doc_id are alike in this:
    each has its own text's component. A row without doc_id is linked with
    nothing, has no component_id, and is kept. An empty table gives an empty result.
    """
    seen = cut(docs.select("doc_id", "text").mapInArrow(light(_sketched(size)), "doc_id long, n_shingles long, class long, registers binary"))
    known = seen.filter("class IS NOT NULL AND doc_id IS NOT NULL")
    # a class has one set, so any row's registers are the class's
    classes = cut(known.groupBy("class").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"), F.max("registers").alias("registers")))
    bands = classes.select("class", "registers").mapInArrow(light(_banded), "band long, node long")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = classes.join(nodes, classes["class"] == nodes["node"], "left_semi").select(F.col("first").alias("doc_id"), "class")
        ids = wanted.select("doc_id").distinct()
        rows = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(light(_set_rows(size)), "node long, items binary")
        return rows.join(nodes, "node", "left_semi").dropDuplicates(["node"])

    def screen(pairs: DataFrame) -> DataFrame:
        def side(c: str) -> DataFrame:
            return classes.select(F.col("class").alias(c), F.col("n").alias(f"{c}_n"), F.col("registers").alias(f"{c}_reg"))

        return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_n", "b_n", "a_reg", "b_reg").mapInArrow(light(_screened(num / den - MARGIN)), "a long, b long")

    roots, _ = similar_components(bands, sets_of, num, den, screen)
    placed = classes.select("class", "first").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    lowest = placed.groupBy("root").agg(F.min("first").alias("component"))
    component = placed.join(lowest, "root").select("class", "component")
    out = seen.drop("registers").join(component, "class", "left")
    alone = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("component", "doc_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, num: int = 4, den: int = 5, size: int = 5) -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, with all their columns; rows of one doc_id are kept or dropped together."""
    gone = near_duplicates(docs, num, den, size).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("NOT kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")
