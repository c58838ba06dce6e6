"""Advantage estimators and masked reductions over token rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import estimators as E
from . import inputs as I
from .catalog import query


def digest(df):
    """Sums of a row's advantages and returns, plain and weighted by place."""

    def weighted(c):
        return A.total(F.transform(c, lambda v, i: v * (i + 1)))

    return df.select("row_id", "uid", *[F.round(x, 4).alias(k) for k, x in (("adv", A.total("advantages")), ("adv_at", weighted("advantages")), ("ret", A.total("returns")), ("ret_at", weighted("returns")))])


def scalar_sql(value: str, where: str = "") -> str:
    """Twin of an estimator that puts one number on all tokens of a row."""
    at = "len * (len + 1) / 2"
    return f"WITH {I.TOKENS}, {I.ROWS}, {I.STATS}, val AS (SELECT *, ({value}) AS a FROM st {where}) SELECT row_id, uid, round(a * len, 4) AS adv, round(a * {at}, 4) AS adv_at, round(a * len, 4) AS ret, round(a * {at}, 4) AS ret_at FROM val"


def white_sql(value: str, ret: str = "w") -> str:
    at = "len * (len + 1) / 2"
    return f"""WITH {I.TOKENS}, {I.ROWS}, {I.STATS}, val AS (SELECT *, ({value}) AS a FROM st),
 g AS (SELECT sum(len) AS c, sum(a * len) / (sum(len) + 1e-8) AS mu FROM val), q AS (SELECT sum(len * (a - mu) * (a - mu)) / (max(c) + 1e-8) AS var FROM val, g),
 wh AS (SELECT row_id, uid, len, (a - mu) / sqrt(var * c / (c - 1) + 1e-8) AS w FROM val, g, q)
 SELECT row_id, uid, round(w * len, 4) AS adv, round(w * {at}, 4) AS adv_at, round({ret} * len, 4) AS ret, round({ret} * {at}, 4) AS ret_at FROM wh"""


def tokens_sql(body: str, adv: str, ret: str = "ret") -> str:
    """Twin of an estimator with a number for each token; body gives CTEs that end in x(row_id, uid, t, ...)."""
    return f"WITH {I.TOKENS}, {body} SELECT row_id, uid, round(sum({adv}), 4) AS adv, round(sum(({adv}) * (t + 1)), 4) AS adv_at, round(sum({ret}), 4) AS ret, round(sum(({ret}) * (t + 1)), 4) AS ret_at FROM x GROUP BY row_id, uid"


def white_tokens(of: str) -> str:
    """CTEs that whiten column a of table ``of`` over its mask into x(..., wh)."""
    return f"""g AS (SELECT sum(m) AS c, sum(a * m) / (sum(m) + 1e-8) AS mu FROM {of}), q AS (SELECT sum(m * (a - mu) * (a - mu)) / (max(c) + 1e-8) AS var FROM {of}, g),
 x AS (SELECT {of}.*, (a - mu) / sqrt(var * c / (c - 1) + 1e-8) AS wh FROM {of}, g, q)"""


GRPO = "CASE WHEN n = 1 THEN s / (1 + 1e-6) ELSE (s - mean) / (sd + 1e-6) END"


def run(name: str, **options):
    return lambda spark, sf: digest(E.advantages(I.tokens(spark, sf), name, **options))


query("e2_grpo", scalar_sql(GRPO))(run("grpo"))
query("e2_grpo_mean_only", scalar_sql("CASE WHEN n = 1 THEN s ELSE s - mean END"))(run("grpo", by_std=False))
query("e3_grpo_vectorized", scalar_sql("CASE WHEN n = 1 THEN s / (1 + 1e-6) ELSE (s - mean) / (sqrt(greatest(sd * sd, 1e-6)) + 1e-6) END"))(run("grpo_vectorized"))
query("e6_reinforce_plus_plus_baseline", white_sql("CASE WHEN n = 1 THEN s ELSE s - mean END"))(run("reinforce_plus_plus_baseline"))
query("e7_rloo", scalar_sql("CASE WHEN n = 1 THEN s ELSE n * 1.0::DOUBLE / (n - 1) * (s - mean) END"))(run("rloo"))
query("e8_rloo_vectorized", scalar_sql("(n * s - sum(s) OVER (PARTITION BY uid)) / greatest(n - 1, 1)"))(run("rloo_vectorized"))
query("e9_opo", scalar_sql("s - CASE WHEN n = 1 THEN 0 ELSE sum(s * len) OVER (PARTITION BY uid) / sum(len) OVER (PARTITION BY uid) END"))(run("opo"))
query("e12_gpg", scalar_sql("(SELECT count(*) * 1.0::DOUBLE / greatest(count(*) FILTER (s <> 0), 1) FROM rws) * (s - CASE WHEN n = 1 THEN 0 ELSE mean END)"))(run("gpg"))


@query("e5_grpo_passk", scalar_sql("CASE WHEN row_number() OVER (PARTITION BY uid ORDER BY s DESC, row_id) = 1 THEN (s - lead(s) OVER (PARTITION BY uid ORDER BY s DESC, row_id)) / (sd + 1e-6) ELSE 0 END", "WHERE n > 1"))
def passk(spark, sf):
    df = I.tokens(spark, sf)
    df = df.withColumn("many", F.count("*").over(W.partitionBy("uid"))).filter("many > 1")
    return digest(E.advantages(df, "grpo_passk"))


@query("e4_gdpo", white_sql("CASE WHEN n = 1 THEN s / (1 + 1e-6) ELSE (s - mean) / (sd + 1e-6) END + 0.5::DOUBLE * CASE WHEN n = 1 THEN len / (1 + 1e-6) ELSE (len - avg(len) OVER (PARTITION BY uid)) / (stddev_samp(len) OVER (PARTITION BY uid) + 1e-6) END"))
def gdpo(spark, sf):
    df = I.tokens(spark, sf).withColumns({"s": A.total("rewards"), "len": A.count("mask")})
    return digest(E.advantages(df, "gdpo", components=["s", "len"], weights=[1.0, 0.5]))


_LATER = "sum(r * m) OVER (PARTITION BY row_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
query("e11_remax", tokens_sql(f"x AS (SELECT *, {_LATER} AS ret FROM tok)", "ret - base * m"))(run("remax"))

# inside the mask (a prefix here) sums run to its end; the first token behind it still sees what comes next
_RPP = """y AS (SELECT *, coalesce(sum(r * m * pow(0.9::DOUBLE, t)) OVER (PARTITION BY row_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) / pow(0.9::DOUBLE, t) AS inner_sum FROM tok),
 z AS (SELECT *, CASE WHEN m = 1 THEN inner_sum ELSE r END AS a FROM y), """
query("e10_reinforce_plus_plus", tokens_sql(_RPP + white_tokens("z"), "wh * m", "a"))(run("reinforce_plus_plus", gamma=0.9))

# with the mask a prefix, the sum over tokens behind it is carried on unchanged: both are 0 at its end
_GAE = """y AS (SELECT *, r + CASE WHEN m = 1 THEN 0.9::DOUBLE * coalesce(lead(v * m) OVER w, 0) ELSE 0 END - v AS delta FROM tok WINDOW w AS (PARTITION BY row_id ORDER BY t)),
 z AS (SELECT *, CASE WHEN m = 1 THEN sum(delta * m * pow(0.72::DOUBLE, t)) OVER (PARTITION BY row_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / pow(0.72::DOUBLE, t) ELSE 0 END AS a FROM y), """
query("e1_gae", tokens_sql(_GAE + white_tokens("z"), "wh", "a + v"))(run("gae", gamma=0.9, lam=0.8))

_OTB = f"""y AS (SELECT *, {_LATER} AS g, sum((1 - 2 * exp(old) + pi2) * m) OVER (PARTITION BY row_id ORDER BY t) AS w FROM tok),
 ln AS (SELECT row_id, uid, sum(m) AS len FROM tok GROUP BY ALL), rk AS (SELECT *, count(*) OVER (PARTITION BY uid) AS n, row_number() OVER (PARTITION BY uid ORDER BY len DESC) AS place FROM ln),
 sec AS (SELECT uid, max(len) FILTER (place = 2) AS second, max(n) AS n FROM rk GROUP BY uid),
 b AS (SELECT uid, t, sum(g * w * m) / (sum(w * m) + 1e-8) AS b FROM y GROUP BY uid, t),
 x AS (SELECT y.row_id, y.uid, y.t, y.g AS ret, (g - CASE WHEN sec.n = 1 OR (ln.len > sec.second AND y.t >= sec.second) THEN 0 ELSE b.b END) * m AS a
  FROM y JOIN b ON y.uid = b.uid AND y.t = b.t JOIN ln ON y.row_id = ln.row_id JOIN sec ON y.uid = sec.uid)"""
query("e13_optimal_token_baseline", tokens_sql(_OTB, "a"))(run("optimal_token_baseline"))
query("e14_tir_optimal_token_baseline", tokens_sql(_OTB, "a"))(run("tir_optimal_token_baseline"))


@query("e15_judged_grpo", f"""WITH {I.TOKENS}, {I.ROWS}, u AS (SELECT *, valid = 1 AND sum(valid) OVER (PARTITION BY uid) >= 2 AS ok FROM rws),
 st AS (SELECT *, avg(s) FILTER (ok) OVER w AS mean, stddev_samp(s) FILTER (ok) OVER w AS sd FROM u WINDOW w AS (PARTITION BY uid))
 SELECT row_id, uid, round(CASE WHEN ok THEN (s - mean) / (sd + 1e-6) * len ELSE 0 END, 4) AS adv, CAST(CASE WHEN ok THEN len ELSE 0 END AS BIGINT) AS left_tokens FROM st""")
def judged(spark, sf):
    out = E.judged_grpo(I.tokens(spark, sf))
    return out.select("row_id", "uid", F.round(A.total("advantages"), 4).alias("adv"), A.count("usable_mask").cast("long").alias("left_tokens"))


@query("f6_usable_rows", f"WITH {I.TOKENS}, {I.ROWS}, u AS (SELECT *, valid = 1 AND sum(valid) OVER (PARTITION BY uid) >= 2 AS ok FROM rws) SELECT CAST(count(*) FILTER (ok) AS BIGINT) AS usable, CAST(count(*) FILTER (valid = 0) AS BIGINT) AS invalid, CAST(count(*) FILTER (valid = 1 AND NOT ok) AS BIGINT) AS unrankable FROM u")
def usable(spark, sf):
    df = I.tokens(spark, sf)
    df = df.select("valid", E.usable(df).alias("ok"))
    return df.agg(F.count_if("ok").alias("usable"), F.count_if(F.expr("valid = 0")).alias("invalid"), F.count_if(F.expr("valid = 1 AND NOT ok")).alias("unrankable"))


@query("kl_in_reward", f"""WITH {I.TOKENS}, k AS (SELECT *, greatest(-10, least(10, exp(greatest(-20, least(20, ref - old))) - greatest(-20, least(20, ref - old)) - 1)) * m AS kl FROM tok)
 SELECT row_id, round(sum(r - 0.1::DOUBLE * kl), 4) AS reward, round(sum(kl) / (sum(m) + 1e-8), 4) AS kl FROM k GROUP BY row_id""")
def kl_in_reward(spark, sf):
    out = E.apply_kl_penalty(I.tokens(spark, sf), 0.1, "k3")
    return out.select("row_id", F.round(A.total("token_rewards"), 4).alias("reward"), F.round("kl", 4).alias("kl"))


def kl_tokens(kind: str):
    return A.each(lambda a, b: E.kl_penalty(kind, a, b), "old_log_probs", "ref_log_probs")


@query("kl_estimates", f"WITH {I.TOKENS} SELECT row_id, round(sum(old - ref), 4) AS k1, round(sum(abs(old - ref)), 4) AS k_abs, round(sum((old - ref) * (old - ref) / 2), 4) AS k2 FROM tok GROUP BY row_id")
def kl_estimates(spark, sf):
    df = I.tokens(spark, sf)
    return df.select("row_id", *[F.round(A.total(kl_tokens(k)), 4).alias(n) for k, n in (("k1", "k1"), ("abs", "k_abs"), ("k2+", "k2"))])


@query("a1_masked_reductions", f"WITH {I.TOKENS} SELECT row_id, round(sum(r * m), 4) AS total, round(sum(r * m) / (sum(m) + 1e-8), 4) AS mean FROM tok GROUP BY row_id")
def masked(spark, sf):
    return I.tokens(spark, sf).select("row_id", F.round(A.masked_total("rewards", "mask"), 4).alias("total"), F.round(A.masked_mean("rewards", "mask"), 4).alias("mean"))


@query("a4_whiten", f"WITH {I.TOKENS}, z AS (SELECT *, r AS a FROM tok), {white_tokens('z')} SELECT label, round(sum(wh * m), 4) AS inside, round(sum(wh), 4) AS everything FROM x GROUP BY label")
def whitened(spark, sf):
    out = E.whiten(I.tokens(spark, sf), "rewards", "mask")
    return out.groupBy("label").agg(F.round(F.sum(A.masked_total("rewards", "mask")), 4).alias("inside"), F.round(F.sum(A.total("rewards")), 4).alias("everything"))


@query("a3_masked_variance", f"WITH {I.TOKENS}, g AS (SELECT sum(m) AS c, sum(r * m) / (sum(m) + 1e-8) AS mu FROM tok) SELECT round(sum(m * (r - mu) * (r - mu)) / (max(c) + 1e-8) * max(c) / (max(c) - 1), 6) AS variance FROM tok, g")
def masked_variance(spark, sf):
    df = I.tokens(spark, sf)
    n, s = F.sum(A.count("mask")), F.sum(A.masked_total("rewards", "mask"))
    both = E.with_batch(df, [], c=n, mu=s / (n + 1e-8))
    square = A.masked_total(A.each(lambda v: (v - F.col("mu")) * (v - F.col("mu")), "rewards"), "mask")
    return both.select("c", square.alias("q")).agg((F.sum("q") / (F.first("c") + 1e-8) * F.first("c") / (F.first("c") - 1)).alias("v")).select(F.round("v", 6).alias("variance"))


@query("a5_group_statistics", f"WITH {I.ROLLOUTS}, g AS (SELECT uid, count(*) AS n, avg(reward) AS mean, var_samp(reward) AS var FROM ro GROUP BY uid) SELECT uid, n, CASE WHEN n = 1 THEN 0 ELSE round(mean, 6) END AS mean, CASE WHEN n = 1 THEN 1 ELSE round(sqrt(greatest(var, 1e-6)), 6) END AS std FROM g")
def group_statistics(spark, sf):
    g = I.rollouts(spark, sf).groupBy("uid").agg(F.count("*").alias("n"), F.avg("reward").alias("mean"), F.var_samp("reward").alias("var"))
    one = F.col("n") == 1
    return g.select("uid", "n", F.when(one, F.lit(0.0)).otherwise(F.round("mean", 6)).alias("mean"), F.when(one, F.lit(1.0)).otherwise(F.round(F.sqrt(F.greatest("var", F.lit(1e-6))), 6)).alias("std"))


@query("a6_group_numbers", "SELECT doc_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS BIGINT) AS number FROM documents")
def group_numbers(spark, sf):
    """Numbers for labels in their order. Ranks go over the distinct labels and come back by a join, so the table needs no single sort."""
    docs = I.table(spark, sf, "documents").select("doc_id", "source")
    labels = docs.select("source").distinct().withColumn("number", (F.dense_rank().over(W.orderBy("source")) - 1).cast("long"))
    return docs.join(labels, "source").select("doc_id", "number")
