"""Evaluation of repeated samples, and metrics of a training step."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A


def reduce_metrics(df: DataFrame, name="name", value="value") -> DataFrame:
    """One value for each metric name: the largest if the name has max in it, else the smallest if it has min, else the mean."""
    out = df.groupBy(name).agg(F.max(value).alias("_x"), F.min(value).alias("_n"), F.avg(value).alias("_m"))
    return out.select(name, F.when(F.col(name).contains("max"), F.col("_x")).when(F.col(name).contains("min"), F.col("_n")).otherwise(F.col("_m")).alias(value))


AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def aggregate_ranks(df: DataFrame, kind: str, pos: str = "pos", rank: str = "rank", value: str = "value") -> DataFrame:
    """A metric kept by several ranks. Sums and means take the mean over ranks at each place first; all ranks need as many values."""
    if kind not in AGGREGATES:
        raise ValueError(f"no aggregate is named {kind}")
    counts = df.groupBy(rank).count().select("count").distinct().limit(2).count()
    if counts > 1:
        raise ValueError("ranks have different numbers of values")
    if kind in ("mean", "sum"):
        df = df.groupBy(pos).agg(F.avg(value).alias(value))
    return df.agg(AGGREGATES[kind](value).alias(value))


def majority(df: DataFrame, group: list[str], vote: str, value: str, pos: str) -> DataFrame:
    """The value of the first row with the most frequent vote; the vote seen first wins a tie."""
    votes = df.groupBy(*group, vote).agg(F.count("*").alias("_n"), F.min(F.struct(pos, value)).alias("_first"))
    best = F.max(F.struct(F.col("_n"), (-F.col("_first")[pos]).alias("_p"), F.col("_first")[value].alias(value)))
    return votes.groupBy(*group).agg(best.alias("_b")).select(*group, F.col("_b")[value].alias(value))


def bootstrap_index(size: int, subset: int, draws: int = 1000, seed: int = 42) -> list[list[int]]:
    """Rows of places drawn with replacement, the same for a seed, size and subset."""
    random = np.random.RandomState(seed)
    return [random.choice(size, size=subset, replace=True).tolist() for _ in range(draws)]


def subset_sizes(n: int) -> list[int]:
    """2, 4, 8 ... below n, and n."""
    out, k = [], 2
    while k < n:
        out.append(k)
        k *= 2
    return [*out, n] if n > 1 else out


def bootstrap(df: DataFrame, group: list[str], value: str, pos: str, size: int, subset: int, kind: str, draws: int = 1000, seed: int = 42, vote: str | None = None) -> DataFrame:
    """Mean and population deviation, over draws, of the best, worst or majority value among ``subset`` of a group's ``size`` values.

    The drawn places are a table of a fixed size that all groups of one size
    share: a row's values are gathered into an array, so a group is one row.
    """
    index = F.broadcast(df.sparkSession.createDataFrame([(bootstrap_index(size, subset, draws, seed),)], "_index array<array<int>>"))
    rows = df.groupBy(*group).agg(_gathered(pos, value, vote)).filter(F.size("_x") == size).crossJoin(index)
    return rows.select(*group, F.transform("_index", _taker(kind)).alias("_d")).withColumn("mean", _mean("_d", draws)).withColumn("std", _std("_d", F.col("mean"), draws)).select(*group, "mean", "std")


def _gathered(pos: str, value: str, vote: str | None) -> Column:
    """A group's values and votes in order."""
    return F.array_sort(F.collect_list(F.struct(pos, F.col(value).cast("double").alias("_v"), (F.col(vote) if vote else F.lit("")).cast("string").alias("_k")))).alias("_x")


def _taker(kind: str):
    """From drawn places to the best, worst or majority value there."""

    def once(x, f):  # an expression named in a lambda is computed for each element, an argument is not
        return F.get(F.transform(F.array(x), f), 0)

    def one(places):
        taken = F.transform(places, lambda i: F.get("_x", i)["_v"])
        if kind == "best":
            return F.array_max(taken)
        if kind == "worst":
            return F.array_min(taken)
        keys = F.transform(places, lambda i: F.get("_x", i)["_k"])
        times = once(keys, lambda keys: F.transform(keys, lambda k: F.size(F.filter(keys, lambda q: q == k))))
        at = once(times, lambda times: (F.array_position(times, F.array_max(times)) - 1).cast("int"))
        return F.get("_x", F.get(places, at))["_v"]

    return one


def _mean(drawn: str, draws: int) -> Column:
    return F.aggregate(drawn, F.lit(0.0), lambda s, x: s + x) / draws


def _std(drawn: str, mean: Column, draws: int) -> Column:
    return F.sqrt(F.aggregate(drawn, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / draws)


def validation_metrics(df: DataFrame, source="source", uid="uid", value="value", pos="pos", vote: str | None = None, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(source, metric, value): mean@n, std@n, and best, worst and majority of N for N = 2, 4 ... n, each averaged over a source's groups."""
    groups = df.groupBy(source, uid).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    n = F.col("n").cast("string")
    out = groups.select(source, F.explode(F.array(F.struct(F.concat(F.lit("mean@"), n).alias("metric"), F.col("mean").alias("value")), F.struct(F.concat(F.lit("std@"), n).alias("metric"), F.when(F.col("n") > 1, F.col("std")).alias("value")))).alias("_m")).select(source, "_m.*").filter("value IS NOT NULL")
    kinds = ("best", "worst", *(["maj"] if vote else []))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed count, as drawing is long and its input small
    rows = df.repartition(parts, source, uid).groupBy(source, uid).agg(_gathered(pos, value, vote)).select(F.col(source).alias("source"), F.col("_x")["_v"].alias("x"), F.col("_x")["_k"].alias("votes"))
    kept = T.StructType([T.StructField("source", df.schema[source].dataType), T.StructField("metric", T.StringType()), T.StructField("total", T.DoubleType()), T.StructField("groups", T.LongType())])
    sums = rows.mapInArrow(_draw_all(kinds, draws, seed), kept).groupBy(F.col("source").alias(source), "metric").agg((F.sum("total") / F.sum("groups")).alias("value"))
    return out.groupBy(source, "metric").agg(F.avg("value").alias("value")).unionByName(sums)


#: Drawn places that a worker holds at a time; work on them goes in smaller blocks, which a processor's cache holds.
PLACES = 1 << 21


def _drawn(n: int, k: int, draws: int, seed: int):
    """``bootstrap_index`` in arrays of some draws each; a draw is a column."""
    random = np.random.RandomState(seed)
    step = max(1, PLACES // n)
    for at in range(0, draws, step):
        yield random.choice(n, size=(min(step, draws - at), k), replace=True).T


def _times_extreme(ranks: np.ndarray, missing: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many draws have each rank of a group (a column) as their largest, and as their smallest; the first row counts draws of missing values alone."""
    n, groups = ranks.shape
    draws = places.shape[1]
    found = np.empty((2, n + 1, groups), np.int64)
    width = max(1, PLACES // 8 // draws)
    for at in range(0, groups, width):
        r, gone = ranks[:, at : at + width], missing[:, at : at + width]
        for i, (own, pick) in enumerate(((np.where(gone, 0, r + 1), np.maximum), (np.where(gone, n + 1, r + 1), np.minimum))):
            best = own[places[0]]
            for p in places[1:]:
                pick(best, own[p], out=best)
            g = r.shape[1]
            slots = np.bincount((best % (n + 1) * g + np.arange(g)).ravel(), minlength=(n + 1) * g)
            found[i, :, at : at + g] = slots.reshape(n + 1, g)
    return found[0], found[1]


def _times_voted(labels: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many draws each place of a pattern of votes (a row of labels) decides: the first with the most frequent vote; labels of -1 are no votes."""
    patterns, n = labels.shape
    k, draws = places.shape
    top = int(labels.max()) + 2
    found = np.zeros((patterns, n), np.int64)
    width = max(1, PLACES // 16 // (draws * max(k, top)))
    for at in range(0, patterns, width):
        own = np.where(labels[at : at + width] < 0, top - 1, labels[at : at + width])
        m = len(own) * draws
        slots = own.T[places].transpose(0, 2, 1).reshape(k, m) * m + np.arange(m)
        times = np.bincount(slots.ravel(), minlength=top * m).reshape(top, m)
        times[-1] = 0
        first = -(times.ravel()[slots] * (k + 1) - np.arange(k)[:, None]).max(0) % (k + 1)
        place = np.tile(places, len(own))[first, np.arange(m)]
        found[at : at + width] = np.bincount(np.repeat(np.arange(len(own)), draws) * n + place, minlength=len(own) * n).reshape(-1, n)
    return found


def _patterns(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of labels, numbered as votes come up in a group, and which of them each group has; -1 stays."""
    n = votes.shape[1]
    order = np.argsort(votes, 1, kind="stable")
    ranked = np.take_along_axis(votes, order, 1)
    start = np.where(np.diff(ranked, axis=1, prepend=ranked[:, :1] - 1) != 0, np.arange(n), 0)
    first = np.empty_like(order)
    np.put_along_axis(first, order, np.take_along_axis(order, np.maximum.accumulate(start, 1), 1), 1)
    number = np.cumsum((first == np.arange(n)) & (votes >= 0), 1) - 1
    labels = np.where(votes < 0, -1, np.take_along_axis(number, first, 1))
    labels, which = np.unique(labels, axis=0, return_inverse=True)
    return labels, which.ravel()


def _moments(x: np.ndarray, missing: np.ndarray, times: np.ndarray, draws: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows draw no missing value, their mean and population deviation over draws; values drawn no times don't count, even if they aren't finite."""
    with np.errstate(invalid="ignore", over="ignore"):
        mean = np.where(times > 0, x * times, 0.0).sum(1) / draws
        off = np.where(times > 0, x - mean[:, None], 0.0)
        return ~(missing & (times > 0)).any(1), mean, np.sqrt((off * off * times).sum(1) / draws)


def _draw_all(kinds: tuple[str, ...], draws: int, seed: int):
    """From batches of groups (source, x, votes) to sums (source, metric, total, groups) over them.

    Groups of one size share the drawn places, which are made here. A group
    takes part with how often each of its places decides a draw.
    """

    def sums(batches):
        for b in batches:
            sizes = b.column("x").value_lengths().to_numpy(zero_copy_only=False)
            own = b.column("source").dictionary_encode("encode")
            out = []
            for n in np.unique(sizes[sizes > 1]).tolist():
                rows = pa.array(np.flatnonzero(sizes == n))
                flat = b.column("x").take(rows).flatten()
                missing, x = (a.to_numpy(zero_copy_only=False).reshape(-1, n) for a in (flat.is_null(), flat.fill_null(0.0)))
                order = np.argsort(x, 1)
                ranks = np.ascontiguousarray(np.argsort(order, 1).T.astype(np.int32))
                if "maj" in kinds:
                    labels, which = _patterns(b.column("votes").take(rows).flatten().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).reshape(-1, n))
                ranked = np.take_along_axis(x, order, 1)
                source = own.indices.take(rows).to_numpy(zero_copy_only=False)
                for k in subset_sizes(n):
                    best = worst = voted = 0
                    for places in _drawn(n, k, draws, seed):
                        high, low = _times_extreme(ranks, missing.T, places)
                        best, worst = best + high, worst + low
                        if "maj" in kinds:
                            voted = voted + _times_voted(labels, places)
                    none = np.zeros((len(x), 1), bool)
                    spans = np.hstack([~none, np.zeros_like(missing)])
                    found = {"best": _moments(np.hstack([none, ranked]), spans, best.T, draws), "worst": _moments(np.hstack([none, ranked]), spans, worst.T, draws)}
                    if "maj" in kinds:
                        found["maj"] = _moments(x, missing, voted[which], draws)
                    for kind in kinds:
                        ok, *values = found[kind]
                        groups = np.bincount(source[ok], minlength=len(own.dictionary))
                        for part, v in zip(("mean", "std"), values):
                            total = np.bincount(source[ok], v[ok], len(own.dictionary))
                            out += [(s, f"{kind}@{k}/{part}", total[s], groups[s]) for s in np.flatnonzero(groups)]
            s, metric, total, groups = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([own.dictionary.take(pa.array(s, pa.int64())), pa.array(metric, pa.string()), pa.array(total, pa.float64()), pa.array(groups, pa.int64())], ["source", "metric", "total", "groups"])

    return sums


def metric_section(metric: Column, is_core: Column, largest: Column) -> Column:
    """val-core for a core variable's mean and best or majority of the largest N, else val-aux."""
    at = F.regexp_extract(metric, r"@(\d+)", 1)
    core = is_core & F.regexp_like(metric, F.lit(r"^(mean|maj|best)@")) & (at == largest.cast("string"))
    return F.when(core, F.lit("val-core")).otherwise(F.lit("val-aux"))


def gain(metrics: DataFrame, source="source") -> DataFrame:
    """gain@N: the best of N's mean less the mean over the largest number of samples."""
    top = metrics.filter(F.col("metric").startswith("mean@")).withColumn("_n", F.regexp_extract("metric", r"@(\d+)", 1).cast("int"))
    base = top.groupBy(source).agg(F.max_by("value", "_n").alias("_base"))
    best = metrics.filter(F.col("metric").rlike(r"^best@\d+/mean$"))
    return best.join(base, source).select(source, F.concat(F.lit("gain@"), F.regexp_extract("metric", r"@(\d+)", 1)).alias("metric"), (F.col("value") - F.col("_base")).alias("value"))


def mean_of_means(df: DataFrame, group: str, value: Column, over: list[str] | None = None) -> DataFrame:
    """Mean over groups of their means, rows without value left out; null if there are none."""
    over = over or []
    return df.withColumn("_v", value).filter("_v IS NOT NULL").groupBy(*over, group).agg(F.avg("_v").alias("_m")).groupBy(*over).agg(F.avg("_m").alias("value"))


def merge_results(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def reward_stats(df: DataFrame, reward: str = "reward", valid: Column | None = None) -> DataFrame:
    v = F.when(valid, F.col(reward)) if valid is not None else F.col(reward)
    return df.agg(F.avg(F.when(valid, 1.0).otherwise(0.0) if valid is not None else F.lit(1.0)).alias("valid_rate"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"))


def group_reward_stats(df: DataFrame, group="uid", reward="reward", tolerance=1e-6) -> DataFrame:
    """One row of means over groups of two rows or more: moments, lead of the best, size of advantages, shares of groups at one extreme or without spread."""
    limits = F.broadcast(df.agg(F.max(reward).alias("_top"), F.min(reward).alias("_low")))
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(reward).alias("m"), F.var_pop(reward).alias("v"), F.slice(F.sort_array(F.collect_list(reward), False), 1, 2).alias("two"), F.min(reward).alias("lo"), F.max(reward).alias("hi"))
    g = g.filter("n >= 2").crossJoin(limits)
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tolerance
    flag = lambda c: F.avg(c.cast("double"))
    return g.agg(
        F.avg("m").alias("mean"), F.avg("v").alias("variance"), F.avg(F.sqrt("v")).alias("std"), F.avg(F.get("two", F.lit(0)) - F.get("two", F.lit(1))).alias("lead"),
        flag(near("lo", "_top") & near("hi", "_top")).alias("all_one"), flag(near("lo", "_low") & near("hi", "_low")).alias("all_zero"), flag(near("lo", "hi")).alias("no_variance"),
        flag(F.col("lo") > 0).alias("all_correct"), flag(F.col("hi") <= 0).alias("none_correct"),
    )


def sign_ratios(df: DataFrame, reward="reward", zero=0.1) -> DataFrame:
    """Shares of positive, negative and nearly zero rewards; the last overlaps the others."""
    n = F.greatest(F.lit(1), F.count("*"))
    r = F.col(reward)
    return df.agg((F.count_if(r > 0) / n).alias("positive"), (F.count_if(r < 0) / n).alias("negative"), (F.count_if(F.abs(r) < zero) / n).alias("zero"))


def component_stats(df: DataFrame, components: list[str]) -> DataFrame:
    return df.agg(*[f(c).alias(f"{c}_{k}") for c in components for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max), ("min", F.min))])


def data_metrics(df: DataFrame, score="score", reward="reward", length="length", prompt="prompt_length", limit=50) -> DataFrame:
    """One row: mean, largest and smallest score, reward (of rows that weren't aborted) and lengths, share of clipped and of aborted responses."""
    alive = F.col(length) > 0
    cols = [(score, F.col(score)), (reward, F.when(alive, F.col(reward))), (length, F.col(length)), (f"{length}_alive", F.when(alive, F.col(length))), (prompt, F.col(prompt))]
    out = [f(c).alias(f"{n}_{k}") for n, c in cols for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    return df.agg(*out, F.avg((F.col(length) == limit).cast("double")).alias("clip_ratio"), F.avg((~alive).cast("double")).alias("aborted_ratio"))


def explained_variance(df: DataFrame, returns: str, values: str) -> DataFrame:
    """1 less the residuals' variance over the returns'; both over rows of token values, sample variances."""
    return df.agg((1 - F.var_samp(F.col(returns) - F.col(values)) / (F.var_samp(returns) + 1e-5)).alias("explained_variance"))


def timing_per_token(timings: DataFrame, response_tokens: float, all_tokens: float, name="name", seconds="seconds") -> DataFrame:
    """Milliseconds for each token: generation by response tokens, other steps by all."""
    tokens = F.when(F.col(name) == "gen", F.lit(float(response_tokens))).otherwise(F.lit(float(all_tokens)))
    return timings.select(name, (F.col(seconds) * 1000 / tokens).alias("ms_per_token"))


def throughput(tokens: float, seconds: float, devices: int) -> float:
    return tokens / (seconds * devices)


def tail_ratio(df: DataFrame, value: str, percent: float) -> DataFrame:
    """Share of values above the quantile that leaves ``percent`` hundredths above."""
    edge = F.broadcast(df.agg(F.percentile(value, 1 - percent / 100).alias("_edge")))
    return df.crossJoin(edge).agg(F.avg((F.col(value) > F.col("_edge")).cast("double")).alias("tail_ratio"))


def slowest(df: DataFrame, cost: Column, *columns: str) -> DataFrame:
    """Figures of the row with the largest cost, and the costs' extremes and mean."""
    x = df.withColumn("_c", cost)
    return x.agg(F.min("_c").alias("min"), F.max("_c").alias("max"), F.avg("_c").alias("mean"), *[F.max_by(c, "_c").alias(f"slowest_{c}") for c in columns])


def probability_distance(tokens: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of two probabilities over token rows, and mean, largest and deviation of their distance; null without rows."""
    d = F.abs(F.col(a) - F.col(b))
    return tokens.agg(F.corr(a, b).alias("pearson"), F.avg(d).alias("mean"), F.max(d).alias("max"), F.stddev_samp(d).alias("std"))


def mismatches(a: Column, b: Column, mask: Column) -> Column:
    """Number of masked tokens that differ."""
    return F.aggregate(F.filter(F.arrays_zip(a.alias("a"), b.alias("b"), mask.alias("m")), lambda z: (z["m"] != 0) & (z["a"] != z["b"])), F.lit(0), lambda s, x: s + 1)


def variance_proxies(df: DataFrame, advantages: str, paths: str, mask: str, weights: str | None = None, gradient_norm: float | None = None) -> DataFrame:
    """One row of proxies for the variance of the gradient, from arrays of tokens.

    paths: each token's share of a trajectory's squared path norm W; weights:
    importance weights that paths already carry squared. total_power is the
    mean of A**2 * W, times the squared mean weight if there are weights;
    signal_strength the squared norm of the mean gradient, and pure_noise what
    total_power exceeds it by, for each row but one. Without a gradient norm
    both are 0. A row without masked tokens counts with 0; no rows give nulls.
    """
    plain = paths if weights is None else F.zip_with(paths, weights, lambda w, q: w / F.greatest(q * q, F.lit(1e-10)))
    x = df.select(A.masked_mean(advantages, mask).alias("a"), A.masked_total(paths, mask).alias("w"), F.greatest(A.masked_total(plain, mask), F.lit(0.0)).alias("o"), (F.lit(1.0) if weights is None else A.masked_mean(weights, mask)).alias("q"))
    signal = F.lit(0.0 if gradient_norm is None else float(gradient_norm) ** 2)
    power = F.avg(F.col("q") ** 2 * F.col("a") ** 2 * F.col("o"))
    noise = F.lit(0.0) if gradient_norm is None else F.when(F.count("*") > 1, F.greatest((power - signal) / (F.count("*") - 1), F.lit(0.0))).otherwise(0.0)
    return x.agg(signal.alias("signal_strength"), power.alias("total_power"), noise.alias("pure_noise"), F.avg(F.col("a") ** 2).alias("expected_a_squared"), F.avg("w").alias("expected_w"))


def strict_saturation(df: DataFrame, expected: int, group="uid", criterion="criterion", score="score", best="best", valid="valid") -> DataFrame:
    """Criteria at their largest score in all of a group's ``expected`` valid rows; an invalid or missing row rules out the group."""
    g = df.groupBy(group, criterion).agg(F.count("*").alias("n"), F.min((F.col(valid) & (F.col(score) == F.col(best))).cast("int")).alias("ok"))
    return g.filter((F.col("n") == expected) & (F.col("ok") == 1)).select(group, criterion)


def group_summary(df: DataFrame, expected: int, group="uid", score="score", text="response", valid="valid") -> DataFrame:
    """Mean and median of groups with at least half of the expected rows valid, and the row nearest to the median (by hash of its text among equals)."""
    ok = df.filter(F.col(valid))
    g = ok.groupBy(group).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.median(score).alias("median")).filter(F.col("n") >= math.ceil(expected / 2))
    w = W.partitionBy(group).orderBy(F.abs(F.col(score) - F.col("median")), F.sha2(F.col(text), 256))
    return ok.join(g, group).withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(group, "n", "mean", "median", F.col(text).alias("representative"))
