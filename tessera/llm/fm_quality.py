"""Quality scores by a factorisation machine.

A document's features are its hashed words, weighted by their share of the
text, and statistics of its structure cut into ranges. The score is

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2)

through a logistic function: all pairwise interactions, at a cost linear in
the document's features. The model is fitted on the driver from a sample of
labelled rows of bounded size and sent to executors; its size is fixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .session import light
from .words import SPACED_LOWER, Words, buffers, slices, words

#: Hashed words, then each statistic's ranges.
WORD_BITS = 16
STATISTICS = ("n_chars", "n_words", "mean_word", "upper_share", "digit_share", "symbol_share", "pipe_share", "punctuation_share", "space_share", "line_words", "distinct_share", "top_share", "repeat_share", "exclaim_share", "non_ascii_share", "sentence_words")
RANGES = 16
SIZE = (1 << WORD_BITS) + len(STATISTICS) * RANGES
FACTORS = 8

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&<>~^=+@\\{}[]_", "pipe": b"|",
    "punctuation": b".,;:?'\"()-", "space": b" \t\n\r\x0b\x0c", "exclaim": b"!", "non_ascii": bytes(range(0x80, 0x100)), "line": b"\n", "stop": b".",
}


def statistics(data: np.ndarray, offsets: np.ndarray, w: Words, h: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; all 0 for an empty one."""
    n, size = len(offsets) - 1, np.diff(offsets)
    per = {}
    for name, chars in _CLASSES.items():
        table = np.zeros(256, np.int64)
        table[list(chars)] = 1
        per[name] = np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets])
    count = np.diff(w.first)
    key = np.lexsort((h, w.text))
    same = np.ones(len(key), bool)
    same[1:] = (h[key][1:] != h[key][:-1]) | (w.text[key][1:] != w.text[key][:-1])
    heads = np.flatnonzero(same)
    times, owner = np.diff(np.append(heads, len(key))), w.text[key][heads]
    distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, times)
    pair = np.zeros(len(h), bool)
    pair[1:] = (h[1:] == h[:-1]) & (w.text[1:] == w.text[:-1])
    far = np.zeros(n)
    if len(h) > 8:  # words seen a few words before as well: short phrases over and over
        again = np.zeros(len(h), bool)
        for back in range(1, 9):
            again[back:] |= (h[back:] == h[:-back]) & (w.text[back:] == w.text[:-back]) & ((w.end - w.start)[back:] > 6)
        far = np.bincount(w.text[again], minlength=n)
    words_, chars_ = np.maximum(count, 1), np.maximum(size, 1)
    letters = np.bincount(w.text, weights=(w.end - w.start), minlength=n)
    lines, stops = per["line"] + 1, per["stop"] + 1
    out = np.stack([
        np.log1p(size) / 16, np.log1p(count) / 14, np.minimum(letters / words_ / 16, 1), per["upper"] / chars_, per["digit"] / chars_, per["symbol"] / chars_, per["pipe"] / chars_, per["punctuation"] / chars_, per["space"] / chars_,
        np.minimum(np.log1p(count / lines) / 8, 1), distinct / words_, top / words_, far / words_, per["exclaim"] / chars_, per["non_ascii"] / chars_, np.minimum(np.log1p(count / stops) / 8, 1),
    ], axis=1)
    return np.where(size[:, None] > 0, out, 0.0)


def features(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and value of each non-zero feature, in order of texts; word values have a squared sum of 1."""
    w = words(data, offsets, SPACED_LOWER)
    h = w.hashes()
    stats = statistics(data, offsets, w, h)
    n = len(offsets) - 1
    key, times = np.unique((w.text << WORD_BITS) | (h >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    text, value = key >> WORD_BITS, np.sqrt(times)
    value = value / np.sqrt(np.maximum(np.bincount(text, weights=value**2, minlength=n), 1e-9))[text]
    ranks = np.stack([np.searchsorted(cuts[j], stats[:, j], side="right") for j in range(len(STATISTICS))], axis=1)
    own = (1 << WORD_BITS) + np.arange(len(STATISTICS)) * RANGES + ranks
    text = np.concatenate([text, np.repeat(np.arange(n), len(STATISTICS))])
    feature = np.concatenate([key & ((1 << WORD_BITS) - 1), own.ravel()])
    value = np.concatenate([value, np.full(own.size, 0.5)])
    order = np.argsort(text, kind="stable")
    return text[order], feature[order], value[order]


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # SIZE
    factor: np.ndarray  # SIZE x FACTORS
    cuts: np.ndarray  # len(STATISTICS) x (RANGES - 1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        text, feature, value = features(data, offsets, self.cuts)
        z = self.bias + np.bincount(text, weights=self.weight[feature] * value, minlength=n)
        for f in range(self.factor.shape[1]):
            vx = self.factor[feature, f] * value
            z += 0.5 * (np.bincount(text, weights=vx, minlength=n) ** 2 - np.bincount(text, weights=vx * vx, minlength=n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str | None] | pa.Array, labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.08, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Fit by adaptive gradients on logistic loss, both classes weighing alike up to a factor. No rows give a constant score."""
    random = np.random.default_rng(seed)
    data, offsets = buffers(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    n = len(labels)
    cuts = np.zeros((len(STATISTICS), RANGES - 1))
    rows = []
    if n:
        stats = []
        for a, b in slices(offsets, 1 << 19):
            own, place = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            w = words(own, place, SPACED_LOWER)
            stats.append(statistics(own, place, w, w.hashes()))
        stats = np.concatenate(stats)
        # half of the cuts by rank, half by even steps, so that rare extremes have ranges of their own
        by_rank = np.quantile(stats, np.linspace(0, 1, RANGES // 2 + 1)[1:-1], axis=0).T
        low, high = stats.min(axis=0), stats.max(axis=0)
        even = low[:, None] + (high - low)[:, None] * np.linspace(0, 1, RANGES // 2 + 2)[1:-1]
        cuts = np.sort(np.concatenate([by_rank, even], axis=1), axis=1)
        for a, b in slices(offsets, 1 << 19):
            t, f, v = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], cuts)
            at = np.searchsorted(t, np.arange(b - a + 1))
            rows += [(f[at[k] : at[k + 1]].astype(np.int32), v[at[k] : at[k + 1]].astype(np.float32)) for k in range(b - a)]
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    m = Machine(float(np.log(share / (1 - share))), np.zeros(SIZE), random.normal(0, 0.02, (SIZE, FACTORS)), cuts)
    g0, gw, gv = 1e-8, np.full(SIZE, 1e-8), np.full((SIZE, FACTORS), 1e-8)
    for epoch in range(epochs if n else 0):
        step = rate / (1 + 0.25 * epoch)
        order = random.permutation(n)
        for a in range(0, n, batch):
            pick = order[a : a + batch]
            f = np.concatenate([rows[i][0] for i in pick])
            x = np.concatenate([rows[i][1] for i in pick])
            t = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            at = np.searchsorted(t, np.arange(len(pick)))
            vx = m.factor[f] * x[:, None]
            total = np.add.reduceat(vx, at, axis=0)
            z = m.bias + np.add.reduceat(m.weight[f] * x, at) + 0.5 * (total**2 - np.add.reduceat(vx**2, at, axis=0)).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)
            used, back = np.unique(f, return_inverse=True)
            dw = np.bincount(back, weights=err[t] * x) + decay * m.weight[used]
            dv = np.stack([np.bincount(back, weights=err[t] * x * (total[t, k] - vx[:, k])) for k in range(FACTORS)], axis=1) + decay * m.factor[used]
            d0 = err.sum()
            g0 += d0**2
            gw[used] += dw**2
            gv[used] += dv**2
            m.bias -= step * d0 / np.sqrt(g0)
            m.weight[used] -= step * dw / np.sqrt(gw[used])
            m.factor[used] -= step * dv / np.sqrt(gv[used])
    m.weight, m.factor = m.weight.astype(np.float32), m.factor.astype(np.float32)
    return m


def training_sample(docs: DataFrame, labels: DataFrame, rows: int, parts: int = 5, held_out: int = 0) -> list[tuple[str | None, int]]:
    """At most ``rows`` labelled texts and labels, picked by a hash of doc_id; rows whose crc32(doc_id) modulo ``parts`` is ``held_out`` are never among them."""
    known = labels.select("doc_id", F.col("quality").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % parts != held_out)
    total = known.count()
    # about as many as wanted are picked before texts are read; the limit keeps the bound exact
    least = int(min(1.0, 0.95 * rows / max(total, 1)) * (1 << 53))
    picked = known.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < least).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    got = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("text", "ascending"), ("label", "ascending")])
    return [(t, int(y)) for t, y in zip(got["text"].to_pylist(), got["label"].to_pylist())]


def train(docs: DataFrame, labels: DataFrame, rows: int = 8_000) -> Machine:
    """Fit on a bounded sample of labelled rows (``rows`` at most, the documented bound) outside the held-out fifth."""
    sample = training_sample(docs, labels, rows)
    y = np.array([y for _, y in sample], float)
    texts = pa.array([t for t, _ in sample], pa.large_string())
    del sample
    return fit(texts, y)


def _scored(model, name: str, columns: list[str], least: float | None):
    def scored(batches):
        m = model.value
        for batch in batches:
            names = batch.schema.names
            data, offsets = buffers(batch.column(names.index("text")))
            score = np.concatenate([np.zeros(0), *(m.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, 1 << 19))])
            out = pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in columns), pa.array(score, pa.float64())], [*columns, name])
            if least is not None:
                out = out.filter(pa.array(score >= least))
                out = out.select(columns)
            yield out

    return scored


def score(docs: DataFrame, model: Machine, name: str = "score", columns: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` with a score from 0 to 1 in a column ``name``, from text alone; null and empty texts get the score of an empty text.

    A row for each row, repeated ones included; an empty table gives an empty
    result. ``columns`` (all, if None) pass through; ``name`` must not be among
    them.
    """
    columns = docs.columns if columns is None else columns
    if name.lower() in {c.lower() for c in columns}:
        raise ValueError(f"the table has a column {name} already")
    schema = StructType([*(docs.schema[c] for c in columns), StructField(name, DoubleType())])
    return docs.mapInArrow(light(_scored(docs.sparkSession.sparkContext.broadcast(model), name, columns, None)), schema)


def quality_filter(docs: DataFrame, model: Machine, least: float = 0.3) -> DataFrame:
    """Rows of ``docs`` with a score of ``least`` or more, with all their columns; rows with a null or empty text go by the score of an empty text."""
    return docs.mapInArrow(light(_scored(docs.sparkSession.sparkContext.broadcast(model), "", docs.columns, least)), docs.schema)
