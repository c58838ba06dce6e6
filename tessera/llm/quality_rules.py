"""Quality rules learned as a decision list.

Statistics of every text are counted first. Sequential covering then learns
rules for bad documents from labelled statistics: a rule is a conjunction of
thresholds that grows, condition by condition, by information gain on two
thirds of the rows, and is pruned from its end on the rest; what it covers is
taken away, and the next rule is learned. The list becomes one ordered Spark
conditional expression over the statistics, so applying it needs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import light
from .words import SPACED, buffers, slices, whole, windows, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_exclaim", "n_lines", "n_distinct")
_BLANK = " \t\n\v\f\r"

#: What rules may look at: shares that don't depend on a text's length, and the length.
FEATURES = {
    "n_words": lambda c: c("n_words").cast("double"),
    "mean_word": lambda c: c("word_chars") / F.greatest(c("n_words"), F.lit(1)),
    "symbol_share": lambda c: c("n_symbols") / F.greatest(c("word_chars"), F.lit(1)),
    "dup_line_share": lambda c: c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
    "repeat_share": lambda c: c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)),
    "upper_share": lambda c: c("n_upper") / F.greatest(c("n_chars"), F.lit(1)),
    "exclaim_share": lambda c: c("n_exclaim") / F.greatest(c("n_words"), F.lit(1)),
    "words_per_line": lambda c: c("n_words") / F.greatest(c("n_lines"), F.lit(1)),
    "distinct_share": lambda c: c("n_distinct") / F.greatest(c("n_words"), F.lit(1)),
}


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    n = len(offsets) - 1

    def per_text(mark: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])[offsets])

    def of(chars: bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(chars)] = True
        return per_text(table[data])

    w = words(data, offsets, SPACED)
    h = w.hashes()
    points = (data & 0xC0) != 0x80
    inside = whole(w.text, 3)
    three = windows(h, 3)[inside]
    at, owner = np.flatnonzero(inside), w.text[: len(inside)][inside]
    order = np.lexsort((three, owner))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (three[order][1:] == three[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again = np.zeros(len(w.start), bool)
    for k in range(3):
        again[at[order[same[1:] | same[:-1]]] + k] = True
    order = np.lexsort((h, w.text))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (w.text[order][1:] != w.text[order][:-1])
    duplicates, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    raw = data.tobytes()
    for k in range(n):
        seen: set[bytes] = set()
        for line in raw[offsets[k] : offsets[k + 1]].split(b"\n"):
            if line.strip(_BLANK.encode()):
                lines[k] += 1
                duplicates[k] += line in seen
            seen.add(line)
    return {
        "n_words": np.diff(w.first),
        "word_chars": per_text(SPACED.inside[data] & points),
        "n_symbols": of(b"#*$%&|<>"),
        "n_dup_lines": duplicates,
        "n_repeat_words": np.bincount(w.text[again], minlength=n),
        "n_chars": per_text(points),
        "n_upper": of(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_exclaim": of(b"!"),
        "n_lines": lines,
        "n_distinct": np.bincount(w.text[order][new], minlength=n),
    }


def _counted(batches):
    for batch in batches:
        data, offsets = buffers(batch["text"])
        for a, b in slices(offsets):
            found = counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a).cast(pa.int64()), *(pa.array(found[c], pa.int64()) for c in COUNTS)], ["doc_id", *COUNTS])


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each row of ``docs`` (doc_id, text; other columns are not read). A null or empty text has 0 of all."""
    return docs.select("doc_id", "text").mapInArrow(light(_counted), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature >= value, else feature <= value
    value: float

    def column(self) -> Column:
        x = FEATURES[self.feature](F.col)
        return (x >= F.lit(self.value)) if self.above else (x <= F.lit(self.value))

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.above else x[self.feature] <= self.value


@dataclass(frozen=True)
class DecisionList:
    """Rules for bad documents, in order; what none covers is good."""

    rules: tuple[tuple[Condition, ...], ...]

    def verdict(self) -> Column:
        """False for a document that a rule covers, as an ordered conditional expression."""
        out = None
        for rule in self.rules:
            held = F.lit(True)
            for c in rule:
                held = held & c.column()
            out = F.when(held, F.lit(False)) if out is None else out.when(held, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _all(rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, conditions: int, steps: int) -> list[Condition]:
    rule: list[Condition] = []
    live = np.ones(len(bad), bool)
    while len(rule) < conditions and (~bad & live).any():
        p, n = int((bad & live).sum()), int((~bad & live).sum())
        before, best = np.log2(p / (p + n)) if p else 0.0, (1e-9, None)
        for name, v in x.items():
            order = np.argsort(v[live], kind="stable")
            s, b = v[live][order], bad[live][order]
            # thresholds lie between different values only, halfway
            edges = np.flatnonzero(s[1:] != s[:-1]) + 1
            if not len(edges):
                continue
            edges = edges[np.unique(np.linspace(0, len(edges) - 1, min(steps, len(edges))).astype(int))]
            hits = np.concatenate([[0], np.cumsum(b)])
            for above in (False, True):
                pos = p - hits[edges] if above else hits[edges]
                size = len(s) - edges if above else edges
                gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1) / size) - before), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = float(gain[k]), Condition(name, above, float((s[edges[k] - 1] + s[edges[k]]) / 2))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= best[1].holds(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, rules: int = 24, conditions: int = 5, steps: int = 400, precision: float = 0.8, cover: int = 4) -> DecisionList:
    """Sequential covering. A rule must be right on ``precision`` of the pruning rows it covers, and on all rows cover ``cover`` bad ones; no rows or no bad rows give no rules."""
    n = len(bad)
    prune = np.arange(n) % 3 == 2
    left = np.ones(n, bool)
    found: list[tuple[Condition, ...]] = []
    while len(found) < rules and (bad & left).sum() >= cover:
        g = left & ~prune
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g], conditions, steps)
        t = left & prune
        xt, bt = {k: v[t] for k, v in x.items()}, bad[t]

        def worth(r):
            held = _all(r, xt, len(bt))
            p, q = int((held & bt).sum()), int((held & ~bt).sum())
            return (p - q) / (p + q) if p + q else -1.0, p

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if not rule:
            break
        held = left & _all(rule, x, n)
        p, q = int((held & bad).sum()), int((held & ~bad).sum())
        if p < cover or p < precision * (p + q) or worth(rule)[0] < 2 * precision - 1:
            break
        found.append(tuple(rule))
        left &= ~held
    return DecisionList(tuple(found))


def train(docs: DataFrame, labels: DataFrame, rows: int = 20_000, parts: int = 5) -> DecisionList:
    """Learn from at most ``rows`` labelled documents (the documented bound), picked by a hash of doc_id.

    Documents with crc32(doc_id as text) modulo ``parts`` 0 are left for tests,
    and so are those too short or repetitive for ``base_failed``.
    """
    known = labels.select("doc_id", F.col("quality").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL").filter(F.crc32(F.col("doc_id").cast("string")) % parts != 0)
    least = int(min(1.0, 0.95 * rows / max(known.count(), 1)) * (1 << 53))
    picked = known.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < least).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    seen = text_counts(docs.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi"))
    got = seen.join(F.broadcast(picked), "doc_id").filter(~base_failed()).select("doc_id", "label", *(f(F.col).alias(k) for k, f in FEATURES.items())).collect()
    got.sort(key=lambda r: tuple(r))
    return learn({k: np.array([r[k] for r in got], float) for k in FEATURES}, np.array([r["label"] == 0 for r in got], bool))


def base_failed() -> Column:
    """Too few words, or too many of them in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def apply_rules(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """text_counts of each row with base_failed and kept: not failed, and good by the rules."""
    return text_counts(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.verdict())
