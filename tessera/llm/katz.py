"""Log-probabilities of texts under a Katz backoff bigram model.

Training counts words and word pairs over all training rows. Counts up to
``K`` are discounted after Good and Turing; what the discounts free is left to
unseen words, shared in proportion to the next lower order's probabilities, so
that every context's probabilities add up to 1:

    P(w | h) = d(c) c / (c(h) + ETA)        if the pair was seen c > 0 times
             = a(h) P(w)                    if only h was seen
             = P(w)                         if h wasn't seen
    P(w)     = d(c) c / (N + ETA)           if w was seen c > 0 times
             = 1 - the sum of those         for all unseen words together
    a(h)     = (1 - sum of P(w | h)) / (1 - sum of P(w)), both over w seen after h

ETA leaves something to unseen words where no count is small enough for a discount.

Counts live in tables of packed arrays, partitioned by a hash. Documents are
dealt into pieces by doc_id; a piece sends each bucket its distinct words (then
pairs) in order, and gets their total counts back in the same order. Pairs go
by their context, frequent contexts in as many parts as their count asks for,
so no bucket holds all that follows a frequent word; the parts' sums meet when
backoff weights are made, and a piece asks only for the weights it needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed, session
from .session import light
from .words import SPACED_LOWER, buffers, mix, words

K, ETA = 5, 0.1
_END, _BEGIN = np.uint64(0x5BF03635D1A5C1E7), np.uint64(0)
_SALT = np.uint64(0x8CB92BA72F3D8DD7)
#: Word numbers: 0 stands for the begin of a text, 1 for a word unseen in training.
_UNSEEN = np.uint64(1)


class Tokens:
    """A piece's tokens: the words of each text and its end; their distinct hashes."""

    def __init__(self, rows: pa.Table) -> None:
        data, offsets = buffers(rows["text"])
        w = words(data, offsets, SPACED_LOWER)
        n = len(offsets) - 1
        size = np.diff(w.first) + 1
        self.doc = np.repeat(np.arange(n), size)
        h = np.empty(len(self.doc), np.uint64)
        ends = np.cumsum(size) - 1
        inner = np.ones(len(h), bool)
        inner[ends] = False
        h[inner], h[ends] = w.hashes(), _END
        self.begins = ends - size + 1
        self.hash, self.word = np.unique(h, return_inverse=True)
        self.train = ~rows["held"].to_numpy()[self.doc] if n else np.zeros(0, bool)
        self.size = size


def _filled(binary) -> pa.Array:
    return pa.array(binary, pa.binary())


WORD_ROWS = "piece int, bucket int, keys binary, counts binary, docs long"
ANSWERS = "kind int, piece int, bucket int, a binary, b binary, c binary, stats array<double>"


def _answers(rows: list[tuple]) -> pa.Table:
    kinds = list(zip(*rows)) if rows else [[]] * 7
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
    return pa.table([pa.array(list(c), t) for c, t in zip(kinds, types)], names=["kind", "piece", "bucket", "a", "b", "c", "stats"])


def _send_words(n: int):
    def send(rows: pa.Table) -> pa.Table:
        t = Tokens(rows)
        counts = np.bincount(t.word, weights=t.train, minlength=len(t.hash)).astype(np.int64)
        at = packed.buckets(t.hash, n)
        full = np.flatnonzero(np.diff(at))
        piece = rows["piece"][0].as_py()
        trained = int((~rows["held"].to_numpy()).sum())
        return pa.table({
            "piece": pa.array([piece] * len(full), pa.int32()),
            "bucket": pa.array(full, pa.int32()),
            "keys": _filled([packed.pack(t.hash[at[b] : at[b + 1]]) for b in full]),
            "counts": _filled([packed.small(counts[at[b] : at[b + 1]]) for b in full]),
            "docs": pa.array([trained if i == 0 else 0 for i in range(len(full))], pa.int64()),  # once for each piece
        })

    return send


def _histogram(counts: np.ndarray) -> list[float]:
    """How many counts are 1 .. K + 1, how many are above 0, and their sum."""
    return [float((counts == r).sum()) for r in range(1, K + 2)] + [float((counts > 0).sum()), float(counts.sum())]


def _count_words(n: int):
    def count(rows: pa.Table) -> pa.Table:
        keys = [packed.unpack(x.as_py()) for x in rows["keys"]]
        bucket = rows["bucket"][0].as_py()
        order, begins, group = packed.grouped(np.concatenate(keys))
        total = np.add.reduceat(np.concatenate([packed.unsmall(x.as_py()) for x in rows["counts"]])[order], begins)
        number = np.where(total > 0, np.cumsum(total > 0) * n + bucket + 1, int(_UNSEEN))  # over 1, and different in each bucket
        all_total, all_number = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        all_total[order], all_number[order] = total[group], number[group]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        out = [(0, p, bucket, packed.small(a), packed.small(b), None, None) for p, a, b in zip(rows["piece"].to_pylist(), np.split(all_total, cuts), np.split(all_number, cuts))]
        out.append((1, None, bucket, None, None, None, [*_histogram(total), float(sum(rows["docs"].to_pylist()))]))
        return _answers(out)

    return count


def discounts(n: list[float]) -> np.ndarray:
    """Katz's factors for counts 1 .. K from how many counts are 1 .. K + 1.

    They are Good and Turing's, scaled so that counts above K keep theirs. Where
    copies in the corpus keep the raw numbers from giving factors between 0 and
    1, the numbers are taken from a line fitted to their logarithms; where that
    is too flat as well, a count loses one half.
    """
    r = np.arange(1, K + 2)
    n = np.array(n[: K + 1], float)
    candidates = [n] if (n > 0).all() else []
    if (n > 0).sum() > 1:
        slope, level = np.polyfit(np.log(r[n > 0]), np.log(n[n > 0]), 1)
        candidates.append(np.exp(level + slope * np.log(r)))
    for s in candidates:
        top = (K + 1) * s[K] / s[0]
        good = ((r[1:] * s[1:]) / (r[:-1] * s[:-1]) - top) / (1 - top) if top < 1 else np.zeros(K)
        if (good > 0).all() and (good <= 1).all():
            return good
    return (r[:-1] - 0.5) / r[:-1]


class Level:
    """The model's numbers of one order, from the sum of its histograms."""

    def __init__(self, histogram: list[float]) -> None:
        self.n, self.distinct, self.total = histogram[: K + 1], histogram[K + 1], histogram[K + 2]
        self.factor = np.concatenate([[0.0], discounts(self.n), [1.0]])

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return counts * self.factor[np.minimum(counts, K + 1)]

    def seen_mass(self) -> float:
        small = sum(r * self.n[r - 1] for r in range(1, K + 1))
        return sum(self.factor[r] * r * self.n[r - 1] for r in range(1, K + 1)) + self.total - small


class Unigrams(Level):
    def __init__(self, histogram: list[float]) -> None:
        super().__init__(histogram)
        self.docs = histogram[K + 3]
        self.unseen = 1 - self.seen_mass() / (self.total + ETA)

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.kept(counts) / (self.total + ETA), self.unseen)


class Pairs:
    """A piece's distinct pairs of a seen context and a seen word, in the order in which they are sent."""

    def __init__(self, rows: pa.Table, answers: pa.Table, model: Unigrams, n: int) -> None:
        t = self.tokens = Tokens(rows)
        total, number = np.zeros(len(t.hash), np.int64), np.full(len(t.hash), int(_UNSEEN), np.int64)
        at = packed.buckets(t.hash, n)
        for kind, b, a, c in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["a"], answers["b"]):
            if kind == 0:
                total[at[b] : at[b + 1]], number[at[b] : at[b + 1]] = packed.unsmall(a.as_py()), packed.unsmall(c.as_py())
        self.count = total[t.word]
        self.p = model.p(total)
        before = np.empty(len(t.word), np.int64)
        before[1:] = t.word[:-1]
        before[t.begins] = len(t.hash)  # the begin of a text
        self.before = before
        context = np.append(total, int(model.docs))
        self.context_count = context[before]
        both = (self.count > 0) & (self.context_count > 0)
        width = len(t.hash) + 1
        key, self.of = np.unique(before[both] * width + t.word[both], return_inverse=True)
        self.where = np.flatnonzero(both)
        c, w = key // width, key % width
        times = np.bincount(self.of, weights=t.train[both], minlength=len(key)).astype(np.int64)
        names = np.append(number, 0).astype(np.uint64)
        self.names = names
        share = max(model.total / (64 * n), 1.0)
        parts = 1 + (context[c] // share).astype(np.uint64)
        salt = mix(names[w] + _SALT) % parts
        self.bucket_all = (mix(names[c] ^ (salt * _SALT)) >> np.uint64(32)).astype(np.int64) * n >> 32
        order = np.lexsort((names[w], names[c], self.bucket_all))
        self.bucket, self.context, self.word, self.times, self.lower = self.bucket_all[order], names[c][order], names[w][order], times[order], self.p[w][order]
        self.place = np.empty(len(order), np.int64)  # of each distinct pair among those sent
        self.place[order] = np.arange(len(order))
        self.at = np.searchsorted(self.bucket, np.arange(n + 1))


def home(context: np.ndarray, n: int) -> np.ndarray:
    """The bucket where all that is known of a context meets."""
    return (mix(context) >> np.uint64(32)).astype(np.int64) * n >> 32


def _floats(x: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers of which few differ: the different ones, and which each is."""
    values, which = np.unique(x, return_inverse=True)
    return values.tobytes(), packed.small(which)


PAIR_ROWS = "piece int, bucket int, context binary, word binary, times binary, p binary, which binary"


def _send_pairs(histogram: list[float], n: int):
    def send(rows: pa.Table, answers: pa.Table) -> pa.Table:
        x = Pairs(rows, answers, Unigrams(histogram), n)
        piece, out = rows["piece"][0].as_py() if rows.num_rows else 0, []
        for b in np.flatnonzero(np.diff(x.at)):
            s = slice(x.at[b], x.at[b + 1])
            out.append((piece, int(b), packed.pack(x.context[s]), packed.squeeze(x.word[s]), packed.small(x.times[s]), *_floats(x.lower[s])))
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["piece", "bucket", "context", "word", "times", "p", "which"])

    return send


def _count_pairs(n: int):
    def count(rows: pa.Table) -> pa.Table:
        context = [packed.unpack(x.as_py()) for x in rows["context"]]
        word = [packed.unsqueeze(x.as_py(), np.uint64) for x in rows["word"]]
        times = [packed.unsmall(x.as_py()) for x in rows["times"]]
        lower = [np.frombuffer(p.as_py(), np.float64)[packed.unsmall(k.as_py())] for p, k in zip(rows["p"], rows["which"])]
        bucket = rows["bucket"][0].as_py()
        cuts = np.cumsum([len(x) for x in context])[:-1]
        c, w, t, p = map(np.concatenate, (context, word, times, lower))
        order = np.lexsort((w, c))
        c, w, p = c[order], w[order], p[order]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
        heads = np.flatnonzero(new)
        total = np.add.reduceat(t[order], heads)
        spread = np.empty(len(c), np.int64)
        spread[order] = total[np.cumsum(new) - 1]
        out = [(2, q, bucket, packed.small(x), None, None, None) for q, x in zip(rows["piece"].to_pylist(), np.split(spread, cuts))]
        out.append((3, None, bucket, None, None, None, _histogram(total)))
        # what each context needs for its weight: how many pairs have each small count, the sum of larger ones, and of lower probabilities
        seen = total > 0
        c, p, total = c[heads][seen], p[heads][seen], total[seen]
        if len(c):
            first = np.append(True, c[1:] != c[:-1])
            starts = np.flatnonzero(first)
            sums = np.stack([np.add.reduceat((total == r).astype(np.int64), starts) for r in range(1, K + 1)] + [np.add.reduceat(np.where(total > K, total, 0), starts)])
            mass, names = np.add.reduceat(p, starts), c[starts]
            target = home(names, n)
            by = np.argsort(target, kind="stable")
            at = np.searchsorted(target[by], np.arange(n + 1))
            for b in np.flatnonzero(np.diff(at)):
                s = by[at[b] : at[b + 1]]
                out.append((4, None, int(b), packed.pack(names[s]), packed.small(sums[:, s].ravel()), mass[s].tobytes(), None))
        return _answers(out)

    return count


def _partial(histogram: list[float], pairs: list[float], n: int):
    """All but the backoff weights: one row with the texts' figures, and the weights to ask for."""

    def partial(rows: pa.Table, answers: pa.Table) -> pa.Table:
        one, two = Unigrams(histogram), Level(pairs)
        x = Pairs(rows, answers, one, n)
        t, m = x.tokens, rows.num_rows
        if not m:
            return _answers([])
        got = np.zeros(len(x.times), np.int64)
        for kind, b, a in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["a"]):
            if kind == 2:
                got[x.at[b] : x.at[b + 1]] = packed.unsmall(a.as_py())
        count = np.zeros(len(t.word), np.int64)
        count[x.where] = got[x.place][x.of]
        seen = count > 0
        p = np.where(seen, two.kept(count) / (x.context_count + ETA), x.p[t.word])
        score = np.bincount(t.doc, weights=np.log10(p), minlength=m)
        base = np.bincount(t.doc, weights=np.log10((x.count + 0.1) / (one.total + 0.1 * (one.distinct + 1))), minlength=m)
        known = np.bincount(t.doc[x.count > 0], minlength=m)
        figures = pa.table({"doc_id": rows["doc_id"].cast(pa.int64()), "held_out": rows["held"], "n_tokens": pa.array(t.size, pa.int64()), "n_known": pa.array(known, pa.int64()), "base_score": pa.array(base), "score": pa.array(score)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, figures.schema) as f:
            f.write_table(figures)
        piece = rows["piece"][0].as_py()
        out = [(5, piece, None, sink.getvalue().to_pybytes(), None, None, None)]
        ask = np.flatnonzero(~seen & (x.context_count > 0))
        width = m
        key, times = np.unique(x.before[ask] * width + t.doc[ask], return_counts=True)
        context, doc = x.names[key // width], key % width
        counts = np.zeros(len(t.hash) + 1, np.int64)
        counts[x.before] = x.context_count
        target = home(context, n)
        order = np.lexsort((doc, context, target))
        at = np.searchsorted(target[order], np.arange(n + 1))
        for b in np.flatnonzero(np.diff(at)):
            s = order[at[b] : at[b + 1]]
            both = np.concatenate([doc[s], times[s], counts[key[s] // width]])
            out.append((6, piece, int(b), packed.pack(context[s]), packed.small(both), None, None))
        return _answers(out)

    return partial


def _weights(pairs: list[float]):
    """Sums of the logarithms of backoff weights, for each text that asks."""

    def weights(asked: pa.Table, sums: pa.Table) -> pa.Table:
        two = Level(pairs)
        names = [packed.unpack(x.as_py()) for x in sums["a"]]
        if names:
            size = [len(x) for x in names]
            table = np.concatenate([packed.unsmall(x.as_py()).reshape(K + 1, k) for x, k in zip(sums["b"], size)], axis=1)
            mass = np.concatenate([np.frombuffer(x.as_py(), np.float64) for x in sums["c"]])
            order, begins, _ = packed.grouped(np.concatenate(names))
            name = np.concatenate(names)[order][begins]
            table, mass = np.add.reduceat(table[:, order], begins, axis=1), np.add.reduceat(mass[order], begins)
            kept = (two.factor[1 : K + 1] * np.arange(1, K + 1)) @ table[:K] + table[K]
        else:
            name, kept, mass = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
        out = []
        for piece, a, b in zip(asked["piece"].to_pylist(), asked["a"], asked["b"]):
            context = packed.unpack(a.as_py())
            doc, times, count = packed.unsmall(b.as_py()).reshape(3, -1)
            k = np.searchsorted(name, context)
            ok = k < len(name)
            ok[ok] = name[k[ok]] == context[ok]
            left, free = np.ones(len(context)), np.ones(len(context))
            left[ok] = 1 - kept[k[ok]] / (count[ok] + ETA)
            free[ok] = 1 - mass[k[ok]]
            docs, which = np.unique(doc, return_inverse=True)
            logs = np.bincount(which, weights=times * np.log10(left / free))
            out.append((7, piece, None, packed.small(docs), logs.tobytes(), None, None))
        return _answers(out)

    return weights


def _finish(total: int):
    def finish(figures: pa.Table, weights: pa.Table) -> pa.Table:
        t = pa.ipc.open_stream(figures["a"][0].as_py()).read_all() if figures.num_rows else None
        if t is None:
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        score = t["score"].to_numpy().copy()
        for a, b in sorted(zip(weights["a"].to_pylist(), weights["b"].to_pylist())):
            score[packed.unsmall(a)] += np.frombuffer(b, np.float64)
        return pa.table({"doc_id": t["doc_id"], "held_out": t["held_out"], "n_tokens": t["n_tokens"], "n_known": t["n_known"], "train_tokens": pa.array(np.full(t.num_rows, total), pa.int64()), "base_score": t["base_score"], "score": pa.array(score)})

    return finish


def _sum(df: DataFrame, kind: int, size: int) -> list[float]:
    """The buckets' histograms added up: a few numbers, whatever the corpus' size."""
    row = df.filter(F.col("kind") == kind).agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(size)]).first()
    return [float(x or 0) for x in row]


def katz_scores(docs: DataFrame, parts: int = 10) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text; other columns are not read) after learning from part of them.

    Rows with crc32(doc_id as text) modulo ``parts`` 0 are held out; a row
    without doc_id is not. Tokens are words with A-Z lower-cased, and an end
    for each text; a null or empty text is an end alone. Returns doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigrams)
    and score (log10 of the model's probability of the text). Repeated rows
    count as often as they occur. Without any training row all words are
    unseen, and scores are 0.
    """
    n = session.pieces(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == 0, F.lit(False)).alias("held")
    pieces = session.in_pieces(docs, "doc_id", "text", held, n=n)
    by_piece = pieces.groupBy("piece")
    unigrams = session.cut(by_piece.applyInArrow(light(_send_words(n)), WORD_ROWS).groupBy("bucket").applyInArrow(light(_count_words(n)), ANSWERS))
    one = _sum(unigrams, 1, K + 4)
    answers = unigrams.filter("kind = 0")
    sent = by_piece.cogroup(answers.groupBy("piece")).applyInArrow(light(_send_pairs(one, n)), PAIR_ROWS)
    bigrams = session.cut(sent.groupBy("bucket").applyInArrow(light(_count_pairs(n)), ANSWERS))
    two = _sum(bigrams, 3, K + 3)
    answers = answers.union(bigrams.filter("kind = 2"))
    partial = session.cut(by_piece.cogroup(answers.groupBy("piece")).applyInArrow(light(_partial(one, two, n)), ANSWERS))
    asked, sums = partial.filter("kind = 6"), bigrams.filter("kind = 4")
    weights = asked.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInArrow(light(_weights(two)), ANSWERS)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return partial.filter("kind = 5").groupBy("piece").cogroup(weights.groupBy("piece")).applyInArrow(light(_finish(int(one[K + 2]))), schema)
