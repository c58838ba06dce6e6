"""Removal of repeated and nearly repeated lines across documents.

Equal lines are one node. A node's character shingles become a MinHash
signature; nodes that share a band of it are candidates. To keep shuffles
small, band keys and nodes go to buckets as packed arrays, and only keys that
different nodes have become rows. Exact Jaccard similarity then decides, links
are joined into components by distributed union-find, and the first line of a
component, by doc_id and place, stays. To take lines out, documents are dealt
into pieces by doc_id, and each piece learns of the repeated lines it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed, session, sketch
from .similarity import similar_components
from .session import light
from .words import buffers, mix, slices

#: Characters of a shingle, values of a signature, and values of a band.
SHINGLE, HASHES, ROWS = 8, 96, 4


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """All lines that aren't blank, the node of each, its text, and its place among its text's lines."""
    raw, found, text, place = data.tobytes(), [], [], []
    for t, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for k, line in enumerate(raw[a:b].split(b"\n")):
            if line and not line.isspace():
                found.append(line)
                text.append(t)
                place.append(k)
    node = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)).view(np.int64)
    return found, node, np.array(text, np.int64), np.array(place, np.int64)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _shingles(line: bytes) -> np.ndarray:
    """A word of 64 bits for each run of 8 characters, none for a shorter line.

    Characters up to U+00FF take a byte each, so a word is the run itself; a
    higher one is spread over the word.
    """
    if not line.isascii():
        s = line.decode("utf-8", "replace")
        try:
            line = s.encode("latin-1")
        except UnicodeEncodeError:
            c = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64)
            high = c > 255
            c[high] = mix(c[high])
            for step in (1, 2, 4):
                c = c[:-step] ^ _turn(c[step:], 8 * step)
            return c
    n = len(line) - SHINGLE + 1
    return np.ndarray((n,), "<u8", line, 0, (1,)) if n > 0 else np.zeros(0, np.uint64)


def _signatures(found: list[bytes], node: np.ndarray) -> np.ndarray:
    """MinHash signatures of lines; a line shorter than a shingle has one element, itself."""
    own = [_shingles(x) for x in found]
    size = np.array([len(x) for x in own], np.int64)
    few = np.flatnonzero(size == 0)
    for k in few:
        own[k] = node[k : k + 1].view(np.uint64)
    size[few] = 1
    return sketch.signatures(np.concatenate(own), np.repeat(np.arange(len(own)), size), len(own), HASHES)


def sets(column) -> list[np.ndarray]:
    """Sets that are sent as their line's text."""
    out = []
    for x in column:
        line = x.as_py()
        h = np.sort(_shingles(line))
        if not len(h):
            h = np.array([xxhash.xxh3_64_intdigest(line)], np.uint64)
        new = np.ones(len(h), bool)
        np.not_equal(h[1:], h[:-1], out=new[1:])
        out.append(h[new])
    return out


def _keys(n: int):
    """Band keys of the distinct lines of a few megabytes, packed for each bucket with their nodes."""

    def keys(batches):
        for batch in batches:
            data, offsets = buffers(batch["text"])
            for a, b in slices(offsets, 4 << 20):
                found, node, _, _ = _lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                nodes, first = np.unique(node, return_index=True)
                if not len(nodes):
                    continue
                # lines are taken together as long as their shingles fit a processor's cache
                ends = np.cumsum([len(found[k]) for k in first])
                key, at = np.empty((len(nodes), HASHES // ROWS), np.uint64), 0
                while at < len(nodes):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 17), side="right")))
                    key[at:to] = sketch.bands(_signatures([found[k] for k in first[at:to]], nodes[at:to]), ROWS)
                    at = to
                key, node = key.ravel(), np.repeat(nodes, HASHES // ROWS)
                order = np.argsort(key)
                key, node = key[order], node[order]
                at = packed.buckets(key, n)
                full = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([packed.pack(key[at[i] : at[i + 1]]) for i in full], pa.binary()), pa.array([node[at[i] : at[i + 1]].tobytes() for i in full], pa.binary())],
                    ["bucket", "keys", "nodes"],
                )

    return keys


def _meet(rows: pa.Table) -> pa.Table:
    """Band keys that different nodes have, with these nodes. A band's first row has their number and, in x and y, what stands for just these nodes."""
    key = np.concatenate([packed.unpack(x.as_py()) for x in rows["keys"]])
    node = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in rows["nodes"]])
    order = np.argsort(key)
    key, node = key[order], node[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(heads, len(key)))
    shared = np.repeat(size > 1, size)  # most keys are one line's
    key, node = key[shared], node[shared]
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    size = np.diff(np.append(heads, len(key)))
    many = np.repeat(size > 1, size)
    key, node, size = key[many], node[many], size[size > 1]
    heads = np.cumsum(size) - size
    rest = np.ones(len(key), bool)
    rest[heads] = False

    def on_first(x: np.ndarray) -> pa.Array:
        out = np.zeros(len(key), np.int64)
        out[heads] = x.view(np.int64)
        return pa.array(out, mask=rest)

    h = mix(node.view(np.uint64))
    x, y = (np.bitwise_xor.reduceat(h, heads), np.add.reduceat(mix(h + np.uint64(1)), heads)) if len(heads) else (h, h)
    return pa.table({"band": pa.array(key.view(np.int64)), "node": pa.array(node), "size": on_first(size), "x": on_first(x), "y": on_first(y)})


def _set_rows(rows: pa.Table, wanted: pa.Table) -> pa.Table:
    """The wanted nodes among a piece's lines. A set travels as its line's text, an eighth of its hashes' size."""
    data, offsets = buffers(rows["text"])
    found, node, _, _ = _lines(data, offsets)
    nodes, first = np.unique(node, return_index=True)
    pick = np.flatnonzero(np.isin(nodes, wanted["node"].to_numpy()))
    return pa.table({"node": pa.array(nodes[pick]), "items": pa.array([found[k] for k in first[pick]], pa.binary())})


def _entries(n: int):
    """For each line and piece how often it occurs and first where, packed for each bucket of lines."""

    def entries(batches):
        for batch in batches:
            data, offsets = buffers(batch["text"])
            docs, pieces = batch["doc_id"].cast(pa.int64()).to_numpy(zero_copy_only=False), batch["piece"].to_numpy(zero_copy_only=False)
            for a, b in slices(offsets, 4 << 20):
                doc, piece = docs[a:b], pieces[a:b]
                _, node, text, place = _lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(node):
                    continue
                bucket = node % n
                order = np.lexsort((place, doc[text], piece[text], node.view(np.uint64), bucket))
                m, p, d, l, k = node[order], piece[text[order]].astype(np.int64), doc[text[order]], place[order], bucket[order]
                new = np.ones(len(m), bool)
                new[1:] = (m[1:] != m[:-1]) | (p[1:] != p[:-1])
                at = np.flatnonzero(new)
                times, m, p, d, l, k = np.diff(np.append(at, len(m))), m[at], p[at], d[at], l[at], k[at]
                edge = np.searchsorted(k, np.arange(n + 1))
                full = np.flatnonzero(np.diff(edge))
                cuts = [slice(edge[i], edge[i + 1]) for i in full]
                columns = [[packed.pack(m[s].view(np.uint64)) for s in cuts], [packed.squeeze(d[s]) for s in cuts], *([packed.small(x[s]) for s in cuts] for x in (p, times, l))]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", "nodes", "docs", "pieces", "times", "places"])

    return entries


def _places(rows: pa.Table, wanted: pa.Table) -> pa.Table:
    """Lines that occur more than once or are wanted, a row for each piece that has them."""
    if not rows.num_rows:
        return pa.table({c: pa.array([], pa.int32() if c == "piece" else pa.int64()) for c in ("node", "piece", "times", "doc", "line")})
    node = np.concatenate([packed.unpack(x.as_py()) for x in rows["nodes"]]).view(np.int64)
    doc = np.concatenate([packed.unsqueeze(x.as_py(), np.int64) for x in rows["docs"]])
    piece, times, line = (np.concatenate([packed.unsmall(x.as_py()) for x in rows[c]]) for c in ("pieces", "times", "places"))
    order = np.argsort(node)
    s = node[order]
    heads = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    total = np.add.reduceat(times[order], heads)
    keep = (total > 1) | np.isin(s[heads], wanted["node"].to_numpy())
    pick = order[np.repeat(keep, np.diff(np.append(heads, len(s))))]
    return pa.table({"node": pa.array(node[pick]), "piece": pa.array(piece[pick], pa.int32()), "times": pa.array(times[pick]), "doc": pa.array(doc[pick]), "line": pa.array(line[pick])})


def _removed(columns: list[str], lost: list[str]):
    def removed(rows: pa.Table, marks: pa.Table) -> pa.Table:
        data, offsets = buffers(rows["text"])
        _, node, text, place = _lines(data, offsets)
        gone = np.zeros(len(node), bool)
        ids = rows["doc_id"]
        if marks.num_rows and len(node):
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            doc = ids.cast(pa.int64()).fill_null(0).to_numpy()
            order = np.argsort(marks["node"].to_numpy(), kind="stable")
            m = marks["node"].to_numpy()[order]
            keep_doc, keep_line = marks["doc"].to_numpy()[order], marks["line"].to_numpy()[order]
            keep_node = marks["keeper"].to_numpy()[order]
            k = np.minimum(np.searchsorted(m, node), len(m) - 1)
            gone = (m[k] == node) & known[text]
            gone &= ~((keep_doc[k] == doc[text]) & (keep_line[k] == place) & (keep_node[k] == node))
        cut = np.bincount(text[gone], minlength=rows.num_rows)
        seen = np.bincount(text, minlength=rows.num_rows)
        at, raw, texts, last = np.searchsorted(text, np.arange(rows.num_rows + 1)), data.tobytes(), [], 0
        column = rows["text"].combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        for t in np.flatnonzero(cut):
            drop = set(place[at[t] : at[t + 1]][gone[at[t] : at[t + 1]]].tolist())
            left = b"\n".join(x for i, x in enumerate(raw[offsets[t] : offsets[t + 1]].split(b"\n")) if i not in drop)
            texts += [column.slice(last, t - last), pa.array([left], column.type)]
            last = t + 1
        texts.append(column.slice(last))
        out = [pa.concat_arrays(texts) if c == "text" else rows[c] for c in columns]
        return pa.table([*out, pa.array(seen, pa.int64()), pa.array(cut, pa.int64()), pa.array(seen - cut, pa.int64())], names=[*columns, *lost])

    return removed


def line_dedup(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` without lines that repeat an earlier one, exactly or with a similarity of ``num / den`` or more.

    Lines are what line feeds separate; similarity is Jaccard's, on distinct
    runs of 8 characters (a shorter line is one), and goes from line to line.
    Of each component the line with the smallest doc_id, and in it the first,
    stays. Blank lines stay, and so do all lines of a row without doc_id, which
    count for nothing. Rows of one doc_id that have a component's first line at
    the same place all keep it. A null text stays null; an empty table gives
    an empty result.

    Returns all columns of ``docs`` with the new text, followed by lines_seen
    (lines that aren't blank), lines_removed and lines_left; underscores are
    added to these names where docs has them.
    """
    n = session.pieces(docs)
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name in taken:
            name += "_"
        return name

    lost = [free("lines_seen"), free("lines_removed"), free("lines_left")]
    ids = session.in_pieces(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL"), "doc_id", "text", n=n)
    keys = ids.mapInArrow(light(_keys(n)), "bucket int, keys binary, nodes binary")
    bands = session.cut(keys.groupBy("bucket").applyInArrow(light(_meet), "band long, node long, size long, x long, y long"))
    entries = ids.mapInArrow(light(_entries(n)), "bucket int, nodes binary, docs binary, pieces binary, times binary, places binary")
    wanted = bands.select("node").distinct().withColumn("bucket", F.pmod("node", F.lit(n)).cast("int"))
    places = session.cut(entries.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(light(_places), "node long, piece int, times long, doc long, line long"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        first = places.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("piece").alias("piece"))
        return ids.groupBy("piece").cogroup(first.groupBy("piece")).applyInArrow(light(_set_rows), "node long, items binary")

    roots, _ = similar_components(bands, sets_of, num, den, decode=sets)
    first = F.min(F.struct("doc", "line", "node")).alias("first")
    nodes = places.groupBy("node").agg(F.sum("times").alias("times"), first)
    classes = nodes.join(roots, "node", "left").withColumn("class", F.coalesce("root", "node"))
    keepers = classes.groupBy("class").agg(F.sum("times").alias("all"), F.min("first").alias("first")).filter("all > 1")
    repeated = classes.select("node", "class").join(keepers, "class").select("node", F.col("first")["doc"].alias("doc"), F.col("first")["line"].alias("line"), F.col("first")["node"].alias("keeper"))
    marks = places.select("node", "piece").distinct().join(repeated, "node")
    piece = free("piece")
    everything = docs.select("*", F.pmod(F.hash("doc_id"), F.lit(n)).cast("int").alias(piece))
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    apply = _removed(docs.columns, lost)
    return everything.groupBy(piece).cogroup(marks.groupBy("piece")).applyInArrow(light(apply), f"{fields}, " + ", ".join(f"{c} long" for c in lost))


def drop_repeated_lines(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """line_dedup with the columns of ``docs`` alone; rows all of whose lines went are dropped, blank and null texts stay."""
    out = line_dedup(docs, num, den)
    seen, removed, left = out.columns[-3:]
    return out.filter((F.col(removed) == 0) | (F.col(left) > 0)).drop(seen, removed, left)
