"""Correction for data that an older or other policy produced."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .estimators import with_batch

BOUND = 20.0
#: Rejection criteria: what is reduced over a row's tokens, and which estimate of the divergence.
CRITERIA = {f"{level}_{k}": (level, k) for level in ("token", "seq_sum", "seq_mean") for k in ("k1", "k2", "k3")} | {f"seq_max_{k}": ("seq_max", k) for k in ("k2", "k3")}


def importance_bounds(threshold) -> tuple[float | None, float]:
    """A number is an upper bound; "lo_hi" is a band outside of which weights become 0."""
    if isinstance(threshold, str) and "_" in threshold:
        low, high = map(float, threshold.split("_"))
        if not 0 < low <= high:
            raise ValueError(f"not a band: {threshold}")
        return low, high
    high = float(threshold)
    if high <= 0:
        raise ValueError(f"not a positive bound: {threshold}")
    return None, high


def rejection_bounds(criteria: str, thresholds) -> list[tuple[str, float | None, float]]:
    """(criterion, lower, upper) of each comma-separated criterion; one threshold serves all. A k1 criterion with one number is bounded by its inverse from below."""
    names = [c.strip() for c in criteria.split(",") if c.strip()]
    unknown = [c for c in names if c not in CRITERIA]
    if unknown or not names:
        raise ValueError(f"unknown criteria {unknown}; there are {', '.join(CRITERIA)}")
    parts = [str(t).strip() for t in (thresholds if isinstance(thresholds, (list, tuple)) else str(thresholds).split(","))]
    if len(parts) == 1:
        parts *= len(names)
    if len(parts) != len(names):
        raise ValueError(f"{len(names)} criteria have {len(parts)} thresholds")
    out = []
    for name, t in zip(names, parts):
        if CRITERIA[name][1] == "k1":
            low, high = map(float, t.split("_")) if "_" in t else (1 / float(t), float(t))
            if not 0 < low <= high:
                raise ValueError(f"not a band: {t}")
            out.append((name, low, high))
        else:
            if "_" in t or float(t) <= 0:
                raise ValueError(f"{name} takes one positive bound, not {t}")
            out.append((name, None, float(t)))
    return out


def _clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-BOUND)), F.lit(BOUND))


def log_ratio(new="log_probs", rollout="old_log_probs") -> Column:
    return A.each(lambda a, b: a - b, new, rollout)


def importance_weights(df: DataFrame, new="log_probs", rollout="old_log_probs", mask="mask", level="token", threshold=2.0, normalize=False) -> DataFrame:
    """Adds is_weights: exponentials of clamped log-ratios, truncated or set to 0 outside a band, 0 outside the mask."""
    low, high = importance_bounds(threshold)
    if level == "token":
        raw = A.each(lambda a, b: F.exp(_clamp(a - b)), new, rollout)
    elif level == "sequence":
        df = df.withColumn("_r", F.exp(_clamp(A.masked_total(log_ratio(new, rollout), mask))))
        raw = F.transform(mask, lambda m: F.col("_r"))
    else:
        raise ValueError(f"no level is named {level}")

    def bounded(w):
        return F.least(w, F.lit(high)) if low is None else F.when((w >= low) & (w <= high), w).otherwise(F.lit(0.0))

    out = df.withColumn("is_weights", A.masked(F.transform(raw, bounded), mask)).drop("_r")
    if normalize:
        if level == "token":
            mean = F.sum(A.masked_total("is_weights", mask)) / F.sum(A.count(mask))
        else:
            mean = F.avg(F.when(A.count(mask) > 0, A.masked_mean("is_weights", mask)))
        out = with_batch(out, [], _mean=mean)
        out = out.withColumn("is_weights", F.transform("is_weights", lambda w: F.when(F.col("_mean") > 0, w / F.col("_mean")).otherwise(w))).drop("_mean")
    return out


def _divergence(kind: str, d: Column) -> Column:
    return {"k1": lambda: -d, "k2": lambda: d * d * 0.5, "k3": lambda: F.exp(d) - 1 - d}[kind]()


def _within(name: str, low, high, x: Column) -> Column:
    """k1 compares minus the log-ratio with the logarithms of its bounds."""
    return (x >= math.log(low)) & (x <= math.log(high)) if CRITERIA[name][1] == "k1" else x <= high


def rejection(name: str, low, high, new, rollout, mask) -> Column:
    """1 for each token that a criterion keeps; the mask isn't applied."""
    level, kind = CRITERIA[name]
    k = A.each(lambda a, b: _divergence(kind, _clamp(a - b)), new, rollout)
    if level == "token":
        return F.transform(k, lambda x: _within(name, low, high, x).cast("int"))
    if level == "seq_max":
        value = F.array_max(F.zip_with(k, mask, lambda x, m: F.when(m != 0, x).otherwise(F.lit(float("-inf")))))
        value = F.when(A.count(mask) > 0, value).otherwise(F.lit(0.0))
    else:
        value = A.masked_total(k, mask) if level == "seq_sum" else A.masked_mean(k, mask)
    keep = _within(name, low, high, value).cast("int")
    return F.transform(mask, lambda m: keep)


def rejection_mask(df: DataFrame, criteria: str, thresholds, new="log_probs", rollout="old_log_probs", mask="mask") -> DataFrame:
    """Adds new_mask: the mask of what all criteria keep, and keep_<criterion> for each."""
    kept = F.col(mask)
    for name, low, high in rejection_bounds(criteria, thresholds):
        df = df.withColumn(f"keep_{name}", rejection(name, low, high, new, rollout, mask))
        kept = F.zip_with(kept, f"keep_{name}", lambda a, b: a * b)
    return df.withColumn("new_mask", kept)


def correct(df: DataFrame, new="log_probs", rollout="old_log_probs", mask="mask", level=None, threshold=2.0, normalize=False, criteria=None, thresholds=None) -> DataFrame:
    """Weights only if a level is named, a smaller mask only if criteria are; new_mask is there in any case."""
    out = importance_weights(df, new, rollout, mask, level, threshold, normalize) if level else df
    return rejection_mask(out, criteria, thresholds, new, rollout, mask) if criteria else out.withColumn("new_mask", F.col(mask))


def divergence_metrics(df: DataFrame, new="log_probs", rollout="old_log_probs", mask="mask") -> DataFrame:
    """One row: perplexities, divergences, ratio and chi-square of new against rollout log-probabilities."""
    n = A.count(mask)
    rows = df.filter(n > 0).select(
        A.masked_mean(new, mask).alias("mn"), A.masked_mean(rollout, mask).alias("mr"), n.alias("n"),
        A.masked_total(A.each(lambda a, b: b - a, new, rollout), mask).alias("k1"),
        A.masked_total(A.each(lambda a, b: F.exp(a - b) - (a - b) - 1, new, rollout), mask).alias("k3"),
        A.masked_total(A.each(lambda a, b: F.exp(_clamp(a - b) * 2), new, rollout), mask).alias("sq"),
        F.exp(_clamp(A.masked_total(log_ratio(new, rollout), mask)) * 2).alias("seq_sq"),
    )
    return rows.agg(
        F.avg(F.exp(-F.col("mn"))).alias("training_ppl"), F.avg(-F.col("mn")).alias("training_log_ppl"), F.avg(F.exp(-F.col("mr"))).alias("rollout_ppl"), F.avg(-F.col("mr")).alias("rollout_log_ppl"),
        (F.sum("k1") / (F.sum("n") + 1e-8)).alias("kl"), (F.sum("k3") / (F.sum("n") + 1e-8)).alias("k3_kl"),
        F.avg(F.col("mn") - F.col("mr")).alias("log_ppl_diff"), F.avg(F.abs(F.col("mn") - F.col("mr"))).alias("log_ppl_abs_diff"), F.max(F.col("mr") - F.col("mn")).alias("log_ppl_diff_max"), F.avg(F.exp(F.col("mr") - F.col("mn"))).alias("ppl_ratio"),
        (F.sum("sq") / (F.sum("n") + 1e-8) - 1).alias("chi2_token"), (F.avg("seq_sq") - 1).alias("chi2_seq"),
    )


def weight_metrics(df: DataFrame, weights="is_weights", mask="mask", threshold=2.0) -> DataFrame:
    """One row: mean, extremes, deviation, effective share and how many weights lie beyond the bounds."""
    low, high = importance_bounds(threshold)
    low = 1 / high if low is None else low
    x = df.select(F.explode(F.arrays_zip(F.col(weights).alias("w"), F.col(mask).alias("m"))).alias("x")).filter("x.m != 0").select("x.w")
    w = F.col("w")
    return x.agg(
        F.avg(w).alias("mean"), F.min(w).alias("min"), F.max(w).alias("max"), F.stddev_pop(w).alias("std"), (1 / F.avg((w / F.lit(1.0)) * w) * F.avg(w) * F.avg(w)).alias("effective_share"),
        F.avg((w >= high).cast("double")).alias("share_high"), F.avg((w < low).cast("double")).alias("share_low"),
    )


def rejection_metrics(df: DataFrame, mask="mask", new_mask="new_mask") -> DataFrame:
    """One row: the share of masked tokens that were rejected, and of all rows that lost a token."""
    n, k = A.count(mask), A.count(new_mask)
    return df.agg((1 - F.sum(k) / (F.sum(n) + 1e-8)).alias("masked_fraction"), F.avg((k < n).cast("double")).alias("seq_masked_fraction"))
