"""Group-relative advantage estimators, by name.

Input rows: a group column, an array of token rewards, a mask of the same
length, and what an estimator names besides. Each adds two arrays, advantages
and returns. All statistics of a group come from one window over it, so a plan
has one shuffle on the group; batch-wide numbers are a one-row aggregate that
is broadcast (a few numbers, whatever the table's size). ``batch`` names columns
whose values make batches of their own; without it the table is one batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A

ESTIMATORS: dict = {}


def estimator(name: str):
    def register(f):
        if ESTIMATORS.get(name, f) is not f:
            raise ValueError(f"two estimators are named {name}")
        ESTIMATORS[name] = f
        return f

    return register


def advantages(df: DataFrame, name: str, **options) -> DataFrame:
    """Apply the estimator registered under a name."""
    if name not in ESTIMATORS:
        raise ValueError(f"no estimator is named {name}; there are {', '.join(sorted(ESTIMATORS))}")
    return ESTIMATORS[name](df, **options)


def with_batch(df: DataFrame, batch: list[str], **aggregates: Column) -> DataFrame:
    """Adds batch-wide aggregates to each row."""
    if batch:
        return df.join(df.groupBy(*batch).agg(*[c.alias(k) for k, c in aggregates.items()]), batch)
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(k) for k, c in aggregates.items()])))


def whiten(df: DataFrame, values: str, mask: str, batch: list[str] | None = None, shift_mean: bool = True) -> DataFrame:
    """Array column ``values`` less its masked mean, divided by its masked deviation, over a batch.

    The variance is the mean squared deviation times n / (n - 1); a mask with
    fewer than two tokens in a batch is an error.
    """
    batch = batch or []
    n, s = F.sum(A.count(mask)), F.sum(A.masked_total(values, mask))
    df = with_batch(df, batch, _n=n, _mean=s / (n + 1e-8))
    square = A.masked_total(A.each(lambda v: (v - F.col("_mean")) * (v - F.col("_mean")), values), mask)
    out = df.withColumn("_square", square)
    out = with_batch(out, [*batch], _var=F.sum("_square") / (F.first("_n") + 1e-8))
    few = F.when(F.col("_n") <= 1, F.raise_error(F.lit("whitening needs two tokens in a batch")).cast("double"))
    scale = F.coalesce(few, F.lit(1.0) / F.sqrt(F.col("_var") * F.col("_n") / (F.col("_n") - 1) + 1e-8))
    white = A.each(lambda v: (v - F.col("_mean")) * F.col("_scale") + (F.lit(0.0) if shift_mean else F.col("_mean")), values)
    return out.withColumn("_scale", scale).withColumn(values, white).drop("_n", "_mean", "_square", "_var", "_scale")


def group_stats(df: DataFrame, score: Column, group: str) -> DataFrame:
    """Adds _s, and over its group _n, _mean, _std (sample; null for one row)."""
    w = W.partitionBy(group)
    return df.withColumn("_s", score).withColumns({"_n": F.count("*").over(w), "_mean": F.avg("_s").over(w), "_std": F.stddev_samp("_s").over(w)})


def _outcome(df: DataFrame, value: Column, mask: str) -> DataFrame:
    """The same scalar on all tokens of a row, as advantages and returns."""
    out = df.withColumn("_a", value).withColumn("advantages", A.spread("_a", mask)).withColumn("returns", F.col("advantages"))
    return out.drop("_a", "_s", "_n", "_mean", "_std")


@estimator("grpo")
def grpo(df, group="uid", rewards="rewards", mask="mask", by_std=True, eps=1e-6):
    """Score less the group's mean, over its deviation; a row alone in its group keeps its score."""
    df = group_stats(df, A.total(rewards), group)
    mean = F.when(F.col("_n") == 1, F.lit(0.0)).otherwise(F.col("_mean"))
    std = F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(F.col("_std"))
    value = (F.col("_s") - mean) / (std + eps) if by_std else F.col("_s") - mean
    return _outcome(df, value, mask)


@estimator("grpo_vectorized")
def grpo_vectorized(df, group="uid", rewards="rewards", mask="mask", by_std=True, eps=1e-6):
    """As grpo, with the variance floored before the root."""
    df = group_stats(df, A.total(rewards), group)
    one = F.col("_n") == 1
    mean = F.when(one, F.lit(0.0)).otherwise(F.col("_mean"))
    std = F.when(one, F.lit(1.0)).otherwise(F.sqrt(F.greatest(F.col("_std") * F.col("_std"), F.lit(eps))))
    return _outcome(df, (F.col("_s") - mean) / (std + eps) if by_std else F.col("_s") - mean, mask)


@estimator("gdpo")
def gdpo(df, components, weights=None, group="uid", mask="mask", batch=None, eps=1e-6):
    """grpo for each named score column, weighted, summed and whitened over the batch."""
    if not components:
        raise ValueError("gdpo needs the names of reward columns")
    missing = [c for c in components if c not in df.columns]
    if missing:
        raise ValueError(f"no reward columns {missing}")
    weights = weights or [1.0] * len(components)
    w = W.partitionBy(group)
    n = F.count("*").over(w)
    parts = []
    for c, k in zip(components, weights):
        mean, std = F.when(n == 1, F.lit(0.0)).otherwise(F.avg(c).over(w)), F.when(n == 1, F.lit(1.0)).otherwise(F.stddev_samp(c).over(w))
        parts.append((F.col(c) - mean) / (std + eps) * k)
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    out = whiten(df.withColumn("_a", total).withColumn("advantages", A.spread("_a", mask)), "advantages", mask, batch)
    out = out.withColumn("advantages", A.masked("advantages", mask))
    return out.withColumn("returns", F.col("advantages")).drop("_a")


@estimator("grpo_passk")
def grpo_passk(df, group="uid", rewards="rewards", mask="mask", by_std=True, eps=1e-6, order="row_id"):
    """Only a group's best row gets something: its lead over the second; the first of equal rows, by ``order``, is best."""
    df = group_stats(df, A.total(rewards), group)
    w = W.partitionBy(group).orderBy(F.col("_s").desc(), F.col(order))
    df = df.withColumn("_rank", F.row_number().over(w)).withColumn("_second", F.lead("_s").over(w))
    lead = F.col("_s") - F.col("_second")
    value = F.when(F.col("_n") < 2, F.raise_error(F.lit("pass@k needs two rows in a group")).cast("double"))
    value = value.when(F.col("_rank") == 1, lead / (F.col("_std") + eps) if by_std else lead).otherwise(F.lit(0.0))
    return _outcome(df, value, mask).drop("_rank", "_second")


@estimator("reinforce_plus_plus_baseline")
def reinforce_plus_plus_baseline(df, group="uid", rewards="rewards", mask="mask", batch=None):
    df = group_stats(df, A.total(rewards), group)
    out = _outcome(df, F.col("_s") - F.when(F.col("_n") == 1, F.lit(0.0)).otherwise(F.col("_mean")), mask)
    out = whiten(out, "advantages", mask, batch).withColumn("advantages", A.masked("advantages", mask))
    return out.withColumn("returns", F.col("advantages"))


@estimator("rloo")
def rloo(df, group="uid", rewards="rewards", mask="mask"):
    """Score less the mean of the others; a row alone keeps its score."""
    df = group_stats(df, A.total(rewards), group)
    n = F.col("_n")
    return _outcome(df, F.when(n > 1, n / (n - 1) * (F.col("_s") - F.col("_mean"))).otherwise(F.col("_s")), mask)


@estimator("rloo_vectorized")
def rloo_vectorized(df, group="uid", rewards="rewards", mask="mask"):
    """Score less the mean of the others; a row alone gets 0."""
    df = group_stats(df, A.total(rewards), group)
    n = F.col("_n")
    return _outcome(df, (n * F.col("_s") - n * F.col("_mean")) / F.greatest(n - 1, F.lit(1)), mask)


@estimator("opo")
def opo(df, group="uid", rewards="rewards", mask="mask"):
    """Score less the group's mean weighted by length; a row alone keeps its score."""
    w = W.partitionBy(group)
    df = df.withColumns({"_s": A.total(rewards), "_len": A.count(mask)})
    base = F.sum(F.col("_s") * F.col("_len")).over(w) / F.sum("_len").over(w)
    return _outcome(df, F.col("_s") - F.when(F.count("*").over(w) == 1, F.lit(0.0)).otherwise(base), mask).drop("_len")


@estimator("reinforce_plus_plus")
def reinforce_plus_plus(df, rewards="rewards", mask="mask", gamma=1.0, batch=None):
    df = df.withColumn("returns", A.discounted_to_end(rewards, mask, gamma)).withColumn("advantages", F.col("returns"))
    return whiten(df, "advantages", mask, batch).withColumn("advantages", A.masked("advantages", mask))


@estimator("remax")
def remax(df, rewards="rewards", mask="mask", baseline="baseline"):
    """Reward to go less a baseline given with each row."""
    df = df.withColumn("returns", A.sum_to_end(A.masked(rewards, mask)))
    return df.withColumn("advantages", A.each(lambda r, m: r - F.col(baseline) * m, "returns", mask))


@estimator("gpg")
def gpg(df, group="uid", rewards="rewards", mask="mask", f_norm=1.0, batch=None):
    """Score less the group's mean, times rows over rows with a score other than 0."""
    df = group_stats(df, A.total(rewards), group)
    df = with_batch(df, batch or [], _alpha=F.count("*") / F.greatest(F.sum(F.when(F.col("_s") != 0, 1).otherwise(0)), F.lit(1)))
    mean = F.when(F.col("_n") == 1, F.lit(0.0)).otherwise(F.col("_mean"))
    return _outcome(df, F.col("_alpha") * (F.col("_s") - mean) / f_norm, mask).drop("_alpha")


@estimator("gae")
def gae(df, rewards="rewards", values="values", mask="mask", gamma=1.0, lam=1.0, batch=None):
    """Generalized advantages; tokens outside the mask pass the later value and sum on. Returns are taken before whitening."""

    def step(st, r, v, m):
        delta = r + F.lit(gamma) * st["nv"] - v
        run = delta + F.lit(gamma * lam) * st["run"]
        return {"nv": v * m + (1 - m) * st["nv"], "run": run * m + (1 - m) * st["run"]}

    df = df.withColumn("advantages", A.scan_back([rewards, values, mask], {"nv": F.lit(0.0), "run": F.lit(0.0)}, step, "run"))
    df = df.withColumn("returns", A.each(lambda a, v: a + v, "advantages", values))
    return whiten(df, "advantages", mask, batch)


@estimator("optimal_token_baseline")
def optimal_token_baseline(df, group="uid", row="row_id", rewards="rewards", mask="mask", logp="old_log_probs", squares="sum_pi_squared", is_weights=None, eps=1e-8):
    """Reward to go less a baseline for each group and token place, weighted by the path's variance so far.

    A group's single longest row gets no baseline beyond the second longest; a
    row alone in its group has none at all.
    """
    cols = [A.masked(rewards, mask), F.col(mask), F.col(logp), F.col(squares)] + ([F.col(is_weights)] if is_weights else [])
    togo = A.sum_to_end(A.masked(rewards, mask))
    var = A.each(lambda lp, q, m, *w: (F.lit(1.0) - 2 * F.exp(lp) + q) * (w[0] * w[0] if w else F.lit(1.0)) * m, *cols[2:4], cols[1], *cols[4:])
    df = df.withColumns({"returns": togo, "_path": A.sum_so_far(var), "_length": A.count(mask)})
    w = W.partitionBy(group)
    ranked = W.partitionBy(group).orderBy(F.col("_length").desc())
    df = df.withColumn("_size", F.count("*").over(w)).withColumn("_place", F.row_number().over(ranked)).withColumn("_second", F.max(F.when(F.col("_place") == 2, F.col("_length"))).over(w))
    tokens = df.select(row, group, "_size", "_length", "_second", F.posexplode(F.arrays_zip(F.col("returns").alias("g"), F.col("_path").alias("w"), F.col(mask).alias("m"))).alias("t", "x"))
    at = W.partitionBy(group, "t")
    x = lambda c: F.col("x")[c]
    base = F.sum(x("g") * x("w") * x("m")).over(at) / (F.sum(x("w") * x("m")).over(at) + eps)
    base = F.when(F.col("_size") == 1, F.lit(0.0)).otherwise(base)
    base = F.when((F.col("_length") > F.col("_second")) & (F.col("t") >= F.col("_second")), F.lit(0.0)).otherwise(base)
    rows = tokens.withColumn("a", (x("g") - base) * x("m")).groupBy(row).agg(F.array_sort(F.collect_list(F.struct("t", "a"))).alias("_a"))
    out = df.join(rows.select(row, F.transform("_a", lambda v: v["a"]).alias("advantages")), row, "left")
    return out.withColumn("advantages", F.coalesce("advantages", F.array().cast("array<double>"))).drop("_path", "_length", "_size", "_place", "_second")


@estimator("tir_optimal_token_baseline")
def tir_optimal_token_baseline(df, group="uid", row="row_id", rewards="rewards", mask="mask", logp="old_log_probs", squares="sum_pi_squared", is_weights=None, eps=1e-8):
    """As optimal_token_baseline, with places counted among a row's own tokens: those outside the mask are taken out first and left 0."""

    def own(c):
        return F.transform(F.filter(F.arrays_zip(F.col(c).alias("v"), F.col(mask).alias("m")), lambda z: z["m"] != 0), lambda z: z["v"])

    names = [rewards, mask, logp, squares] + ([is_weights] if is_weights else [])
    small = df.select(row, group, *[own(c).alias(c) for c in names])
    got = optimal_token_baseline(small, group, row, rewards, mask, logp, squares, is_weights, eps).select(row, F.col("advantages").alias("_a"), F.col("returns").alias("_g"))
    out = df.join(got, row)
    place = A.sum_so_far(mask)

    def back(c):
        return F.transform(F.arrays_zip(F.col(mask).alias("m"), F.col("_at").alias("i")), lambda z: F.when(z["m"] != 0, F.get(F.col(c), z["i"].cast("int") - 1)).otherwise(F.lit(0.0)))

    return out.withColumn("_at", place).withColumn("advantages", back("_a")).withColumn("returns", back("_g")).drop("_a", "_g", "_at")


def usable(df: DataFrame, valid: str = "valid", group: str = "uid") -> Column:
    """Whether a row's judgment is valid and its group has another valid one."""
    return (F.col(valid) == 1) & (F.sum(F.when(F.col(valid) == 1, 1).otherwise(0)).over(W.partitionBy(group)) >= 2)


def judged_grpo(df: DataFrame, valid: str = "valid", group: str = "uid", rewards: str = "rewards", mask: str = "mask") -> DataFrame:
    """grpo over usable rows alone; the others get 0 and an empty mask."""
    df = df.withColumn("_usable", usable(df, valid, group))
    w = W.partitionBy(group)
    s = F.when(F.col("_usable"), A.total(rewards))
    df = df.withColumn("_s", s).withColumns({"_mean": F.avg("_s").over(w), "_std": F.stddev_samp("_s").over(w)})
    df = df.withColumn("_a", F.when(F.col("_usable"), (F.col("_s") - F.col("_mean")) / (F.col("_std") + 1e-6)).otherwise(F.lit(0.0)))
    df = df.withColumn("usable_mask", F.transform(mask, lambda m: F.when(F.col("_usable"), m).otherwise(F.lit(0))))
    return df.withColumn("advantages", A.spread("_a", "usable_mask")).withColumn("returns", F.col("advantages")).drop("_s", "_mean", "_std", "_a", "_usable")


def kl_penalty(kind: str, logp: Column, ref: Column) -> Column:
    """Estimates of divergence from log-probabilities: k1, abs, k2, k3; a trailing + changes gradients alone."""
    d = logp - ref
    kind = kind.removesuffix("+")
    if kind in ("k1", "kl"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("k2", "mse"):
        return d * d * 0.5
    if kind in ("k3", "low_var_kl"):
        back = F.least(F.greatest(-d, F.lit(-20.0)), F.lit(20.0))
        return F.least(F.greatest(F.exp(back) - back - 1, F.lit(-10.0)), F.lit(10.0))
    raise ValueError(f"no divergence estimate is named {kind}")


def apply_kl_penalty(df: DataFrame, beta: float, kind: str = "k1", scores="rewards", logp="old_log_probs", ref="ref_log_probs", mask="mask") -> DataFrame:
    """Adds token_rewards, scores less beta times the divergence inside the mask, and kl, the row's masked mean divergence."""
    kl = A.masked(A.each(lambda a, b: kl_penalty(kind, a, b), logp, ref), mask)
    df = df.withColumn("_kl", kl)
    return df.withColumn("token_rewards", A.each(lambda s, k: s - beta * k, scores, "_kl")).withColumn("kl", A.masked_mean("_kl", mask)).drop("_kl")


class AdaptiveKL:
    """A coefficient that follows the divergence, step after step."""

    def __init__(self, value: float, target: float, horizon: float) -> None:
        self.value, self.target, self.horizon = value, target, horizon

    def update(self, kl: float, rows: int) -> float:
        self.value *= 1 + min(max(kl / self.target - 1, -0.2), 0.2) * rows / self.horizon
        return self.value


class FixedKL:
    def __init__(self, value: float) -> None:
        self.value = value

    def update(self, kl: float, rows: int) -> float:
        return self.value
