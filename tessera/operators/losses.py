"""Policy, value and distillation losses as forward values, by name.

A policy loss adds an array column ``loss`` with a number for each token (and
``clipped``, 1 where clipping took effect) to rows with log_probs,
old_log_probs, advantages and mask. ``aggregate_loss`` makes one number of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from .estimators import kl_penalty, with_batch

LOSSES: dict = {}


def policy_loss(name: str):
    def register(f):
        if LOSSES.get(name, f) is not f:
            raise ValueError(f"two losses are named {name}")
        LOSSES[name] = f
        return f

    return register


def apply_loss(df: DataFrame, name: str, **options) -> DataFrame:
    if name not in LOSSES:
        raise ValueError(f"no loss is named {name}; there are {', '.join(sorted(LOSSES))}")
    return LOSSES[name](df, **options)


def aggregate_loss(df: DataFrame, mode: str = "token-mean", loss: str = "loss", mask: str = "mask", norm: float | None = None) -> DataFrame:
    """One row with ``loss``. Rows that are masked as a whole don't count as sequences. norm: divisor of seq-mean-token-sum-norm, the mask's length by default."""
    t, n = A.masked_total(loss, mask), A.count(mask)
    rows = df.select(t.alias("t"), n.alias("n"), F.size(mask).alias("size"))
    some = F.when(F.col("n") > 0, 1.0)
    out = {
        "token-mean": lambda: F.sum("t") / F.sum("n"),
        "seq-mean-token-sum": lambda: F.sum(some * F.col("t")) / F.sum(some),
        "seq-mean-token-mean": lambda: F.sum(some * F.col("t") / F.col("n")) / F.sum(some),
        "seq-mean-token-sum-norm": lambda: F.sum("t") / (F.lit(norm) if norm else F.max("size")),
    }
    if mode not in out:
        raise ValueError(f"no aggregation is named {mode}")
    return rows.agg(out[mode]().alias("loss"))


def _lim(x, low, high):
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def _gap(lp: Column, old: Column) -> Column:
    return _lim(lp - old, -20.0, 20.0)


def _tokens(df: DataFrame, f, extra: str | None, columns=("log_probs", "old_log_probs", "advantages")) -> DataFrame:
    """loss and clipped from f(logp, old, advantage); f gives either a loss or a pair. extra: importance weights that multiply the loss."""
    names = [*columns, *([extra] if extra else [])]

    def both(*x):
        got = f(*x[: len(columns)])
        loss, hit = got if isinstance(got, tuple) else (got, F.lit(0.0))
        return F.struct((loss * x[-1] if extra else loss).alias("loss"), hit.cast("double").alias("clipped"))

    out = df.withColumn("_x", A.each(both, *names))
    return out.withColumn("loss", F.transform("_x", lambda x: x["loss"])).withColumn("clipped", F.transform("_x", lambda x: x["clipped"])).drop("_x")


@policy_loss("vanilla")
def vanilla(df, low=0.2, high=0.2, dual=3.0, weights=None):
    """Clipped surrogate with a second bound for negative advantages."""
    if dual <= 1:
        raise ValueError("the dual bound must be over 1")

    def f(lp, old, adv):
        r = F.exp(_gap(lp, old))
        plain, cut = -adv * r, -adv * _lim(r, 1 - low, 1 + high)
        worst = F.greatest(plain, cut)
        return F.when(adv < 0, F.least(worst, -adv * dual)).otherwise(worst), (cut > plain)

    return _tokens(df, f, weights)


@policy_loss("dppo_tv")
def dppo_tv(df, low=0.2, high=0.2, dual=20.0, weights=None):
    """Truncated ratio times log-probability, where the probability hasn't moved too far the advantage's way."""

    def f(lp, old, adv):
        r = F.least(F.exp(_gap(lp, old)), F.lit(dual))
        moved = F.exp(lp) - F.exp(old)
        ok = F.when(adv > 0, moved <= high).otherwise(moved >= -low)
        return -adv * r * lp * ok.cast("double"), ~ok

    return _tokens(df, f, weights)


@policy_loss("dppo_kl")
def dppo_kl(df, low=0.2, high=0.2, dual=20.0, weights=None):
    """As dppo_tv, bounded by the divergence of the two-way choice for or against the token."""

    def f(lp, old, adv):
        r = F.least(F.exp(_gap(lp, old)), F.lit(dual))
        p, q = F.exp(lp), F.exp(old)
        kl = q * F.log((q + 1e-8) / (p + 1e-8)) + (1 - q) * F.log((1 - q + 1e-8) / (1 - p + 1e-8))
        ok = F.when(adv > 0, (kl <= high) | (p <= q)).otherwise((kl <= low) | (p >= q))
        return -adv * r * lp * ok.cast("double"), ~ok

    return _tokens(df, f, weights)


@policy_loss("gspo")
def gspo(df, low=0.2, high=0.2, weights=None):
    """The sequence's mean log-ratio stands for each token's; use with seq-mean-token-mean."""
    mean = A.masked_total(A.each(lambda a, b: a - b, "log_probs", "old_log_probs"), "mask") / F.greatest(A.count("mask"), F.lit(1.0))
    df = df.withColumn("_seq", F.exp(F.least(mean, F.lit(10.0))))

    def f(lp, old, adv):
        plain, cut = -adv * F.col("_seq"), -adv * _lim(F.col("_seq"), 1 - low, 1 + high)
        return F.greatest(plain, cut), (cut > plain)

    return _tokens(df, f, weights).drop("_seq")


@policy_loss("sapo")
def sapo(df, tau_pos=1.0, tau_neg=1.05, weights=None):
    """A soft gate in place of clipping; use with seq-mean-token-mean."""

    def f(lp, old, adv):
        tau = F.when(adv > 0, F.lit(tau_pos)).otherwise(F.lit(tau_neg))
        return -adv * (1 / (1 + F.exp(-tau * (F.exp(_gap(lp, old)) - 1)))) * 4 / tau

    return _tokens(df, f, weights)


@policy_loss("gpg")
def gpg(df, weights=None):
    return _tokens(df, lambda lp, old, adv: -lp * adv, weights)


@policy_loss("reinforce")
def reinforce(df, weights=None):
    return _tokens(df, lambda lp, old, adv: -adv * lp, weights)


@policy_loss("cispo")
def cispo(df, low=0.2, high=0.2, weights=None):
    def f(lp, old, adv):
        r = F.exp(_gap(lp, old))
        cut = _lim(r, 1 - low, 1 + high)
        return -cut * adv * lp, r != cut

    return _tokens(df, f, weights)


@policy_loss("geo_mean")
def geo_mean(df, low=0.2, high=0.2, weights=None):
    """One loss for each row, repeated on its tokens: the mean advantage times the exponential of the mean clamped log-ratio. The batch's loss is the plain mean over rows."""

    def clamped(lp, old, adv):
        d = lp - old
        sign = F.when(adv > 0, F.lit(1.0)).when(adv < 0, F.lit(-1.0)).otherwise(F.lit(0.0))
        low_, high_ = F.lit(-low), F.lit(high)
        kept = F.when(sign > 0, F.least(d, high_)).when(sign < 0, F.greatest(d, low_)).otherwise(F.lit(0.0))
        return kept

    n = A.count("mask") + 1e-8
    ratio = F.exp(A.masked_total(A.each(clamped, "log_probs", "old_log_probs", "advantages"), "mask") / n)
    value = -A.masked_total("advantages", "mask") / n * ratio
    if weights:
        value = value * F.exp(A.masked_total(A.each(F.log, weights), "mask") / n)
    return df.withColumn("_v", value).withColumn("loss", F.transform("mask", lambda m: F.col("_v"))).withColumn("clipped", F.transform("mask", lambda m: F.lit(0.0))).drop("_v")


def _covariance(df: DataFrame, row: str) -> DataFrame:
    """A row for each masked token: row, t, cov, the product of the advantage's and the log-probability's distances from their masked means."""
    n = F.sum(A.count("mask")) + 1e-8
    df = with_batch(df, [], _ma=F.sum(A.masked_total("advantages", "mask")) / n, _ml=F.sum(A.masked_total("log_probs", "mask")) / n)
    x = F.posexplode(F.arrays_zip("advantages", "log_probs", "old_log_probs", "mask")).alias("t", "x")
    out = df.select(row, "_ma", "_ml", x).filter(F.col("x")["mask"] != 0)
    return out.select(row, "t", "x", ((F.col("x")["advantages"] - F.col("_ma")) * (F.col("x")["log_probs"] - F.col("_ml"))).alias("cov"))


def _marked(df: DataFrame, chosen: DataFrame, row: str) -> DataFrame:
    places = chosen.groupBy(row).agg(F.collect_set("t").alias("_chosen"))
    return df.join(places, row, "left").withColumn("_chosen", F.coalesce("_chosen", F.array().cast("array<int>")))


@policy_loss("kl_cov")
def kl_cov(df, row="row_id", share=0.02, coefficient=1.0, weights=None):
    """Plain surrogate; the tokens of largest covariance also pay for their distance from the old policy."""
    cov = _covariance(df, row)
    n = F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("_all")))
    total = cov.agg(F.count("*").alias("_all"))
    chosen = _top(cov, total.select(n.alias("_k")), [F.col("cov").desc(), F.col(row), F.col("t")])
    df = _marked(df, chosen, row)
    out = _tokens(df, lambda lp, old, adv: -adv * F.exp(_gap(lp, old)), weights)
    extra = F.transform(F.arrays_zip("log_probs", "old_log_probs", "loss"), lambda z, i: z["loss"] + F.when(F.array_contains("_chosen", i), coefficient * F.abs(z["log_probs"] - z["old_log_probs"])).otherwise(F.lit(0.0)))
    return out.withColumn("loss", extra).drop("_chosen")


def _top(df: DataFrame, limit: DataFrame, order: list[Column]) -> DataFrame:
    """The first _k rows (one row, one number) in an order. Ranks are taken within slices first, so no task sorts more than the slices' best."""
    parts = 64
    own = df.withColumn("_part", F.pmod(F.xxhash64(*[c for c in df.columns if c not in ("x", "cov")]), F.lit(parts))).crossJoin(F.broadcast(limit))
    best = own.withColumn("_r", F.row_number().over(W.partitionBy("_part").orderBy(*order))).filter("_r <= _k")
    return best.withColumn("_r", F.row_number().over(W.orderBy(*order))).filter("_r <= _k").drop("_r", "_part", "_k")


@policy_loss("clip_cov")
def clip_cov(df, row="row_id", share=0.0002, low=0.2, high=0.2, cov_low=1.0, cov_high=5.0, seed=0, weights=None):
    """Clipped surrogate; of the tokens with a covariance inside bounds and not clipped, a random few lose their loss. The draw is by a seeded hash of row and place."""
    cov = _covariance(df, row)
    r = F.exp(_gap(F.col("x")["log_probs"], F.col("x")["old_log_probs"]))
    adv = F.col("x")["advantages"]
    clipped = -adv * _lim(r, 1 - low, 1 + high) > -adv * r
    total = cov.agg(F.greatest(F.floor(F.lit(share) * F.count("*")), F.lit(1)).alias("_k"))
    open_ = cov.filter((F.col("cov") > cov_low) & (F.col("cov") < cov_high) & ~clipped)
    chosen = _top(open_, total, [F.xxhash64(F.col(row), F.col("t"), F.lit(seed)), F.col(row), F.col("t")])
    out = vanilla(_marked(df, chosen, row), low, high, 1e9, weights)
    return out.withColumn("loss", F.transform("loss", lambda v, i: F.when(F.array_contains("_chosen", i), F.lit(0.0)).otherwise(v))).drop("_chosen")


@policy_loss("bypass_mode")
def bypass(df, rollout="old_log_probs", kind="reinforce", low=0.2, high=0.2, **correction):
    """Importance weights and the rejection mask are made anew from the rollout's log-probabilities; then the plain or the clipped loss."""
    from .offpolicy import correct

    out = correct(df, "log_probs", rollout, **correction)
    out = out.drop("mask").withColumnRenamed("new_mask", "mask")
    weights = "is_weights" if "is_weights" in out.columns else None
    return reinforce(out, weights) if kind == "reinforce" else vanilla(out, low, high)


def value_loss(df: DataFrame, predicted="predicted", values="values", returns="returns", mask="mask", clip=0.5, mode="token-mean") -> DataFrame:
    """loss and the share of tokens where clipping raised the error."""

    def f(p, v, r):
        near = F.least(F.greatest(p, v - clip), v + clip)
        a, b = (p - r) * (p - r), (near - r) * (near - r)
        return F.struct((F.greatest(a, b) * 0.5).alias("loss"), (b > a).cast("double").alias("hit"))

    x = df.withColumn("_x", A.each(f, predicted, values, returns)).withColumns({"_l": F.transform("_x", lambda z: z["loss"]), "_h": F.transform("_x", lambda z: z["hit"])})
    part = x.agg((F.sum(A.masked_total("_h", mask)) / (F.sum(A.count(mask)) + 1e-8)).alias("clipped"))
    return aggregate_loss(x, mode, "_l", mask).crossJoin(part)


def flow_loss(df: DataFrame, low=1e-4, high=1e-4) -> DataFrame:
    """Clipped surrogate on one log-probability for each row (log_prob, old_log_prob, advantage)."""
    r = F.exp(F.col("log_prob") - F.col("old_log_prob"))
    a = F.col("advantage")
    return df.agg(F.avg(F.greatest(-a * r, -a * _lim(r, 1 - low, 1 + high))).alias("loss"))


def image_kl(mean: Column, reference: Column, deviation: Column) -> Column:
    """Divergence of two normal steps of one deviation: half the mean squared distance over its square."""
    d = F.zip_with(mean, reference, lambda a, b: (a - b) * (a - b))
    return A.total(d) / F.size(d) / (deviation * deviation * 2)


def sft_loss(df: DataFrame, log_probs="log_probs", mask="mask") -> DataFrame:
    """Negative log-likelihood over masked tokens, each judged by the mask one place on, across the batch laid end to end by row_id."""
    last = F.lead(F.get(mask, F.lit(0))).over(W.orderBy("row_id"))
    shifted = F.concat(F.slice(mask, 2, F.size(mask)), F.array(F.coalesce(last, F.lit(0))))
    x = df.select(log_probs, shifted.alias("_m"))
    return x.agg((-F.sum(A.masked_total(log_probs, "_m")) / F.sum(A.count("_m"))).alias("loss"))


def ppo_loss(df: DataFrame, name="vanilla", mode="token-mean", entropy: str | None = None, entropy_weight=0.0, kl_weight=0.0, kl="low_var_kl", **options) -> DataFrame:
    """Policy loss less weighted entropy plus weighted divergence from the reference, as one number."""
    out = apply_loss(df, name, **options)
    parts = out.crossJoin(aggregate_loss(out, mode).withColumnRenamed("loss", "_p")).limit(1).select(F.col("_p").alias("loss"))
    if entropy:
        parts = parts.crossJoin(aggregate_loss(out, mode, entropy).withColumnRenamed("loss", "_e")).select((F.col("loss") - entropy_weight * F.col("_e")).alias("loss"))
    if kl_weight:
        d = out.withColumn("_k", A.each(lambda a, b: kl_penalty(kl, a, b), "log_probs", "ref_log_probs"))
        parts = parts.crossJoin(aggregate_loss(d, mode, "_k").withColumnRenamed("loss", "_e")).select((F.col("loss") + kl_weight * F.col("_e")).alias("loss"))
    return parts


def top_k_divergence(teacher_ids: Column, teacher_log_probs: Column, student: Column) -> Column:
    """Forward divergence over the teacher's k likeliest tokens, at least 0; student: log-probabilities by token id from 0."""
    pairs = F.zip_with(teacher_ids, teacher_log_probs, lambda i, t: F.exp(t) * (t - F.get(student, i)))
    return F.greatest(A.total(pairs), F.lit(0.0))


def probability_mass(log_probs: Column) -> Column:
    return F.aggregate(log_probs, F.lit(0.0), lambda s, x: s + F.exp(x))


DISTILLATION = {"forward_kl_topk": top_k_divergence} | {k: (lambda lp, ref, k=k: kl_penalty(k, lp, ref)) for k in ("k1", "abs", "k2", "k3")}
