"""Expressions over token arrays: masked reductions, scans, padding, placement.

A row holds its sequence as arrays, so sums over tokens need no explode and no
shuffle. Masks are arrays of 0 and 1 of the same length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(values) -> Column:
    """Sum of an array; 0 for an empty one."""
    return F.aggregate(_col(values), F.lit(0.0), lambda s, x: s + x)


def masked(values, mask) -> Column:
    """Values times mask, with whatever lies outside the mask (NaN too) as 0."""
    return F.zip_with(_col(values), _col(mask), lambda v, m: F.when(m != 0, v * m).otherwise(F.lit(0.0)))


def masked_total(values, mask) -> Column:
    return total(masked(values, mask))


def count(mask) -> Column:
    return F.aggregate(_col(mask), F.lit(0.0), lambda s, m: s + m)


def masked_mean(values, mask) -> Column:
    return masked_total(values, mask) / (count(mask) + F.lit(1e-8))


def spread(scalar, mask) -> Column:
    """A row's scalar on every token of its mask."""
    return F.transform(_col(mask), lambda m: _col(scalar) * m)


def each(f, *arrays) -> Column:
    """f applied token by token to arrays of one length; f gets a column for each."""
    arrays = [_col(a) for a in arrays]
    if len(arrays) == 1:
        return F.transform(arrays[0], f)
    if len(arrays) == 2:
        return F.zip_with(*arrays, f)
    first = arrays[0]
    return F.transform(first, lambda x, i: f(x, *[F.get(a, i) for a in arrays[1:]]))


def scan_back(arrays: list, start: dict[str, Column], step, out: str) -> Column:
    """Fold from the last token to the first. step(state, *values) gives the next state; its field ``out`` is kept for each token.

    The state is a struct of doubles.
    """
    zipped = F.transform(_col(arrays[0]), lambda x, i: F.struct(x.alias("c0"), *[F.get(_col(a), i).alias(f"c{k}") for k, a in enumerate(arrays[1:], 1)]))
    zero = F.struct(*[v.cast("double").alias(k) for k, v in start.items()], F.array().cast("array<double>").alias("kept"))

    def merge(state, x):
        new = step(state, *[x[f"c{k}"] for k in range(len(arrays))])
        return F.struct(*[new[k].cast("double").alias(k) for k in start], F.concat(state["kept"], F.array(new[out].cast("double"))).alias("kept"))

    return F.reverse(F.aggregate(F.reverse(zipped), zero, merge)["kept"])


def sum_to_end(values) -> Column:
    """For each token the sum from it to the last."""
    return scan_back([values], {"s": F.lit(0.0)}, lambda st, x: {"s": st["s"] + x}, "s")


def discounted_to_end(values, mask, gamma: float) -> Column:
    """Discounted sums to the end; a token outside the mask starts anew."""

    def step(st, r, m):
        run = r + F.lit(gamma) * st["run"]
        return {"kept_run": run, "run": run * m}

    return scan_back([values, mask], {"run": F.lit(0.0), "kept_run": F.lit(0.0)}, step, "kept_run")


def sum_so_far(values) -> Column:
    return F.reverse(sum_to_end(F.reverse(_col(values))))


def place_at_end(score, mask, size: int | None = None) -> Column:
    """A row's score on its last valid token, 0 elsewhere; without a valid token it falls on the last place."""
    m = _col(mask)
    at = F.aggregate(m, F.lit(0), lambda s, x: s + x.cast("int")) - 1
    return F.transform(m, lambda x, i: F.when(i == F.when(at < 0, F.size(m) - 1).otherwise(at), _col(score)).otherwise(F.lit(0.0)))


def until_first(tokens, stop: int) -> Column:
    """1 up to and with the first ``stop`` token, 0 behind it."""
    t = _col(tokens)
    at = F.array_position(t, stop)
    return F.transform(t, lambda x, i: F.when((at == 0) | (i < at), F.lit(1)).otherwise(F.lit(0)))


def fit(tokens, size: int, fill, side: str = "right", cut: str = "error") -> Column:
    """Pad with ``fill`` on a side or cut to ``size``: left and right keep the end or the beginning, middle keeps both ends, error raises."""
    t = _col(tokens)
    filler = F.array_repeat(F.lit(fill), F.greatest(F.lit(size) - F.size(t), F.lit(0)))
    padded = F.concat(t, filler) if side == "right" else F.concat(filler, t)
    head, tail = size // 2, size - size // 2
    kept = {
        "left": lambda: F.slice(t, F.size(t) - size + 1, size),
        "right": lambda: F.slice(t, 1, size),
        "middle": lambda: F.concat(F.slice(t, 1, head), F.slice(t, F.size(t) - tail + 1, tail)),
        "error": lambda: F.raise_error(F.concat(F.lit("sequence of "), F.size(t).cast("string"), F.lit(f" tokens is longer than {size}"))).cast("array<int>"),
    }[cut]()
    return F.when(F.size(t) > size, kept).otherwise(padded)


def clip(x, low, high) -> Column:
    return F.least(F.greatest(_col(x), _col(low) if isinstance(low, (str, Column)) else F.lit(low)), _col(high) if isinstance(high, (str, Column)) else F.lit(high))


def log_sum_exp(logits) -> Column:
    x = _col(logits)
    top = F.array_max(x)
    return top + F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def entropy(logits) -> Column:
    """Entropy of the softmax of logits: log-sum-exp less the mean logit."""
    x = _col(logits)
    lse = log_sum_exp(x)
    return lse - F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - lse) * v)


def sum_squared_softmax(logits) -> Column:
    x = _col(logits)
    return F.exp(log_sum_exp(F.transform(x, lambda v: v * 2)) - log_sum_exp(x) * 2)


def log_prob(logits, index) -> Column:
    """Log-softmax at a place, counted from 0."""
    return F.get(_col(logits), _col(index)) - log_sum_exp(logits)
