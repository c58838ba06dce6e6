"""Losses and off-policy correction over token rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import losses as L
from ..operators import offpolicy as O
from . import inputs as I
from .catalog import query

# advantages of the loss queries: the values, which have both signs
ADV = "v"


def rows(spark, sf):
    return I.tokens(spark, sf).withColumn("advantages", F.col("values"))


_SEQ = "sq AS (SELECT row_id, sum(l * m) AS t, sum(m)::DOUBLE AS n FROM x GROUP BY row_id)"


def loss_sql(loss: str, mode: str = "token-mean", before: str = "") -> str:
    final = {
        "token-mean": "sum(t) / sum(n)",
        "seq-mean-token-sum": "avg(t) FILTER (n > 0)",
        "seq-mean-token-mean": "avg(t / n) FILTER (n > 0)",
        "seq-mean-token-sum-norm": "sum(t) / 64",
    }[mode]
    source = before or "x0 AS (SELECT * FROM tok)"
    return f"WITH {I.TOKENS}, {source}, x AS (SELECT *, ({loss}) AS l FROM x0), {_SEQ} SELECT round({final}, 6) AS loss FROM sq"


RHO = "exp(greatest(-20, least(20, lp - old)))"
CUT = f"greatest(0.8::DOUBLE, least(1.2::DOUBLE, {RHO}))"
VANILLA = f"CASE WHEN {ADV} < 0 THEN least(greatest(-{ADV} * {RHO}, -{ADV} * {CUT}), -{ADV} * 3) ELSE greatest(-{ADV} * {RHO}, -{ADV} * {CUT}) END"


def loss_query(name, sql, mode="token-mean", **options):
    query(f"l8_{name}_{mode.replace('-', '_')}", sql)(lambda spark, sf: L.aggregate_loss(L.apply_loss(rows(spark, sf), name, **options), mode).select(F.round("loss", 6).alias("loss")))


for _mode in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"):
    loss_query("vanilla", loss_sql(VANILLA, _mode), _mode)
loss_query("dppo_tv", loss_sql(f"-{ADV} * least({RHO}, 20) * lp * CASE WHEN CASE WHEN {ADV} > 0 THEN exp(lp) - exp(old) <= 0.2::DOUBLE ELSE exp(lp) - exp(old) >= -0.2::DOUBLE END THEN 1 ELSE 0 END"))
_BKL = "(exp(old) * ln((exp(old) + 1e-8) / (exp(lp) + 1e-8)) + (1 - exp(old)) * ln((1 - exp(old) + 1e-8) / (1 - exp(lp) + 1e-8)))"
loss_query("dppo_kl", loss_sql(f"-{ADV} * least({RHO}, 20) * lp * CASE WHEN CASE WHEN {ADV} > 0 THEN {_BKL} <= 0.2::DOUBLE OR lp <= old ELSE {_BKL} <= 0.2::DOUBLE OR lp >= old END THEN 1 ELSE 0 END"))
loss_query("gspo", loss_sql(f"greatest(-{ADV} * sr, -{ADV} * greatest(0.8::DOUBLE, least(1.2::DOUBLE, sr)))", "seq-mean-token-mean", "x0 AS (SELECT *, exp(least(10, sum((lp - old) * m) OVER (PARTITION BY row_id) / greatest(1, sum(m) OVER (PARTITION BY row_id)))) AS sr FROM tok)"), "seq-mean-token-mean")
loss_query("sapo", loss_sql(f"-{ADV} / (1 + exp(-(CASE WHEN {ADV} > 0 THEN 1 ELSE 1.05::DOUBLE END) * ({RHO} - 1))) * 4 / (CASE WHEN {ADV} > 0 THEN 1 ELSE 1.05::DOUBLE END)", "seq-mean-token-mean"), "seq-mean-token-mean")
loss_query("gpg", loss_sql(f"-lp * {ADV}"))
loss_query("reinforce", loss_sql(f"-{ADV} * lp"))
loss_query("cispo", loss_sql(f"-{CUT} * {ADV} * lp"))
_COV = f"x0 AS (SELECT *, ({ADV} - sum({ADV} * m) OVER () / (sum(m) OVER () + 1e-8)) * (lp - sum(lp * m) OVER () / (sum(m) OVER () + 1e-8)) AS cov, sum(m) OVER () AS c FROM tok)"
loss_query("kl_cov", loss_sql(f"-{ADV} * {RHO} + CASE WHEN m = 1 AND rk <= greatest(1, floor(0.02::DOUBLE * c)) THEN abs(lp - old) ELSE 0 END", before=_COV.replace("x0 AS", "x1 AS") + ", x0 AS (SELECT *, row_number() OVER (ORDER BY m DESC, cov DESC, row_id, t) AS rk FROM x1)"))


@query("l8_geo_mean", f"""WITH {I.TOKENS}, s AS (SELECT row_id, sum({ADV} * m) / (sum(m) + 1e-8) AS a, exp(sum(m * CASE WHEN {ADV} > 0 THEN least(lp - old, 0.2::DOUBLE) WHEN {ADV} < 0 THEN greatest(lp - old, -0.2::DOUBLE) ELSE 0 END) / (sum(m) + 1e-8)) AS r FROM tok GROUP BY row_id)
 SELECT round(avg(-a * r), 6) AS loss FROM s""")
def geo_mean(spark, sf):
    return L.geo_mean(rows(spark, sf)).agg(F.round(F.avg(F.get("loss", F.lit(0))), 6).alias("loss"))


@query("l8_vanilla_clip_fraction", f"WITH {I.TOKENS} SELECT round(sum(m * CASE WHEN -{ADV} * {CUT} > -{ADV} * {RHO} THEN 1 ELSE 0 END) / (sum(m) + 1e-8), 6) AS clipped, round(sum(m * (old - lp)) / (sum(m) + 1e-8), 6) AS kl FROM tok")
def clip_fraction(spark, sf):
    x = L.vanilla(rows(spark, sf))
    n = F.sum(A.count("mask")) + 1e-8
    return x.agg(F.round(F.sum(A.masked_total("clipped", "mask")) / n, 6).alias("clipped"), F.round(F.sum(A.masked_total(A.each(lambda a, b: b - a, "log_probs", "old_log_probs"), "mask")) / n, 6).alias("kl"))


@query("l8_clip_cov")
def clip_cov(spark, sf):
    """The draw is random in its definition, so SQL can't repeat it; tests hold the number of tokens that lose their loss."""
    out = L.clip_cov(rows(spark, sf), share=0.01, cov_low=0.0, cov_high=5.0)
    return L.aggregate_loss(out).select(F.round("loss", 6).alias("loss"))


@query("l8_bypass_mode", f"""WITH {I.TOKENS}, x AS (SELECT *, least({RHO}, 2) * m AS w, m * CASE WHEN -(lp - old) BETWEEN ln(0.5::DOUBLE) AND ln(2::DOUBLE) THEN 1 ELSE 0 END AS m2 FROM tok)
 SELECT round(sum(-{ADV} * lp * w * m2) / sum(m2), 6) AS loss FROM x""")
def bypass(spark, sf):
    out = L.apply_loss(rows(spark, sf), "bypass_mode", level="token", threshold=2.0, criteria="token_k1", thresholds="2")
    return L.aggregate_loss(out).select(F.round("loss", 6).alias("loss"))


@query("l10_value_loss", f"""WITH {I.TOKENS}, x AS (SELECT *, greatest(v - 0.05::DOUBLE, least(v + 0.05::DOUBLE, r)) AS near, base AS ret FROM tok), y AS (SELECT *, (r - ret) * (r - ret) AS a, (near - ret) * (near - ret) AS b FROM x)
 SELECT round(sum(m * greatest(a, b) * 0.5::DOUBLE) / sum(m), 6) AS loss, round(sum(m * CASE WHEN b > a THEN 1 ELSE 0 END) / (sum(m) + 1e-8), 6) AS clipped FROM y""")
def value_loss(spark, sf):
    x = I.tokens(spark, sf).withColumn("returns", F.transform("rewards", lambda r: F.col("baseline")))
    return L.value_loss(x, "rewards", "values", "returns", "mask", 0.05).select(F.round("loss", 6).alias("loss"), F.round("clipped", 6).alias("clipped"))


@query("l9_flow_loss", f"WITH {I.TOKENS}, s AS (SELECT row_id, max(base) - 0.5::DOUBLE AS a, exp(sum(lp) / 64 - sum(old) / 64) AS r FROM tok GROUP BY row_id) SELECT round(avg(greatest(-a * r, -a * greatest(0.9999::DOUBLE, least(1.0001::DOUBLE, r)))), 6) AS loss FROM s")
def flow(spark, sf):
    x = I.tokens(spark, sf).select((A.total("log_probs") / 64).alias("log_prob"), (A.total("old_log_probs") / 64).alias("old_log_prob"), (F.col("baseline") - 0.5).alias("advantage"))
    return L.flow_loss(x).select(F.round("loss", 6).alias("loss"))


@query("l11_softmax", f"WITH {I.TOKENS}, s AS (SELECT row_id, ln(sum(exp(r))) AS lse, sum(exp(r) * r) / sum(exp(r)) AS mean, sum(exp(2 * r)) AS sq, max(r) FILTER (t = 5) AS r5 FROM tok GROUP BY row_id) SELECT row_id, round(lse - mean, 6) AS entropy, round(r5 - lse, 6) AS log_prob, round(sq / exp(2 * lse), 6) AS squares FROM s")
def softmax(spark, sf):
    x = I.tokens(spark, sf)
    return x.select("row_id", F.round(A.entropy("rewards"), 6).alias("entropy"), F.round(A.log_prob("rewards", F.lit(5)), 6).alias("log_prob"), F.round(A.sum_squared_softmax("rewards"), 6).alias("squares"))


@query("l12_sft_loss", f"WITH {I.TOKENS}, x AS (SELECT *, coalesce(lead(m) OVER (ORDER BY row_id, t), 0) AS nm FROM tok) SELECT round(-sum(lp * nm) / sum(nm), 6) AS loss FROM x")
def sft(spark, sf):
    return L.sft_loss(I.tokens(spark, sf)).select(F.round("loss", 6).alias("loss"))


@query("l13_top_k_divergence", f"WITH {I.TOKENS}, s AS (SELECT row_id, sum(exp(old) * (old - lp)) AS d, sum(exp(old)) AS mass FROM tok WHERE t < 8 GROUP BY row_id) SELECT row_id, round(greatest(d, 0), 6) AS divergence, round(mass, 6) AS mass FROM s")
def top_k(spark, sf):
    x = I.tokens(spark, sf)
    ids = F.array(*[F.lit(i) for i in range(8)])
    return x.select("row_id", F.round(L.top_k_divergence(ids, F.slice("old_log_probs", 1, 8), F.col("log_probs")), 6).alias("divergence"), F.round(L.probability_mass(F.slice("old_log_probs", 1, 8)), 6).alias("mass"))


@query("l3_importance_token", f"WITH {I.TOKENS}, x AS (SELECT *, least({RHO}, 1.1::DOUBLE) * m AS w FROM tok), g AS (SELECT sum(w) / sum(m) AS mean FROM x) SELECT row_id, round(sum(w / mean), 4) AS weight FROM x, g GROUP BY row_id")
def importance_token(spark, sf):
    return O.importance_weights(I.tokens(spark, sf), level="token", threshold=1.1, normalize=True).select("row_id", F.round(A.total("is_weights"), 4).alias("weight"))


@query("l3_importance_sequence_band", f"WITH {I.TOKENS}, s AS (SELECT row_id, exp(greatest(-20, least(20, sum((lp - old) * m)))) AS w, sum(m) AS n FROM tok GROUP BY row_id) SELECT row_id, round(CASE WHEN w BETWEEN 0.5::DOUBLE AND 2 THEN w * n ELSE 0 END, 4) AS weight FROM s")
def importance_sequence(spark, sf):
    return O.importance_weights(I.tokens(spark, sf), level="sequence", threshold="0.5_2.0").select("row_id", F.round(A.total("is_weights"), 4).alias("weight"))


_D = "greatest(-20, least(20, lp - old))"
_K = {"k1": f"-{_D}", "k2": f"{_D} * {_D} / 2", "k3": f"(exp({_D}) - 1 - {_D})"}


def _reject_sql(name: str, low, high) -> str:
    level, kind = O.CRITERIA[name]
    k = _K[kind]
    value = {"token": "k", "seq_sum": "sum(k * m) OVER w", "seq_mean": "sum(k * m) OVER w / (sum(m) OVER w + 1e-8)", "seq_max": "coalesce(max(k) FILTER (m = 1) OVER w, 0)"}[level]
    ok = f"val BETWEEN ln({low}::DOUBLE) AND ln({high}::DOUBLE)" if kind == "k1" else f"val <= {high}::DOUBLE"
    return f"""WITH {I.TOKENS}, y AS (SELECT *, {k} AS k FROM tok), z AS (SELECT *, {value} AS val FROM y WINDOW w AS (PARTITION BY row_id))
 SELECT row_id, CAST(sum(CASE WHEN {ok} THEN m ELSE 0 END) AS BIGINT) AS kept FROM z GROUP BY row_id"""


def _reject_query(name: str):
    kind = O.CRITERIA[name][1]
    high = {"token_k1": 1.1, "seq_sum_k1": 1.5, "seq_mean_k1": 1.02, "token_k2": 0.01, "seq_sum_k2": 0.3, "seq_mean_k2": 0.01, "token_k3": 0.01, "seq_sum_k3": 0.3, "seq_mean_k3": 0.01, "seq_max_k2": 0.05, "seq_max_k3": 0.05}[name]
    low = 1 / high if kind == "k1" else None
    query(f"l4_reject_{name}", _reject_sql(name, low, high))(lambda spark, sf: O.rejection_mask(I.tokens(spark, sf), name, high).select("row_id", A.count("new_mask").cast("long").alias("kept")))


for _name in O.CRITERIA:
    _reject_query(_name)


@query("l5_rejection_metrics", f"""WITH {I.TOKENS}, y AS (SELECT *, m * CASE WHEN {_K['k3']} <= 0.01::DOUBLE AND -{_D} BETWEEN ln(1 / 1.1::DOUBLE) AND ln(1.1::DOUBLE) THEN 1 ELSE 0 END AS m2 FROM tok), s AS (SELECT row_id, sum(m) AS n, sum(m2) AS k FROM y GROUP BY row_id)
 SELECT round(1 - sum(k) / (sum(n) + 1e-8), 6) AS masked_fraction, round(avg(CASE WHEN k < n THEN 1.0::DOUBLE ELSE 0 END), 6) AS seq_masked_fraction FROM s""")
def rejection_metrics(spark, sf):
    x = O.rejection_mask(I.tokens(spark, sf), "token_k3,token_k1", ["0.01", "1.1"])
    return O.rejection_metrics(x).select(F.round("masked_fraction", 6).alias("masked_fraction"), F.round("seq_masked_fraction", 6).alias("seq_masked_fraction"))


@query("a28_divergence_metrics", f"""WITH {I.TOKENS}, s AS (SELECT row_id, sum(lp * m) / (sum(m) + 1e-8) AS mn, sum(old * m) / (sum(m) + 1e-8) AS mr, sum(m) AS n, sum((old - lp) * m) AS k1, sum((exp(lp - old) - (lp - old) - 1) * m) AS k3, sum(exp({_D} * 2) * m) AS sq, exp(2 * greatest(-20, least(20, sum((lp - old) * m)))) AS ssq FROM tok GROUP BY row_id HAVING sum(m) > 0)
 SELECT round(avg(exp(-mn)), 5) AS training_ppl, round(avg(-mn), 5) AS training_log_ppl, round(avg(exp(-mr)), 5) AS rollout_ppl, round(avg(-mr), 5) AS rollout_log_ppl, round(sum(k1) / (sum(n) + 1e-8), 5) AS kl, round(sum(k3) / (sum(n) + 1e-8), 5) AS k3_kl,
  round(avg(mn - mr), 5) AS log_ppl_diff, round(avg(abs(mn - mr)), 5) AS log_ppl_abs_diff, round(max(mr - mn), 5) AS log_ppl_diff_max, round(avg(exp(mr - mn)), 5) AS ppl_ratio, round(sum(sq) / (sum(n) + 1e-8) - 1, 5) AS chi2_token, round(avg(ssq) - 1, 5) AS chi2_seq FROM s""")
def divergence_metrics(spark, sf):
    out = O.divergence_metrics(I.tokens(spark, sf))
    return out.select(*[F.round(c, 5).alias(c) for c in out.columns])


@query("a29_weight_metrics", f"WITH {I.TOKENS}, x AS (SELECT least({RHO}, 2) AS w FROM tok WHERE m = 1) SELECT round(avg(w), 5) AS mean, round(min(w), 5) AS min, round(max(w), 5) AS max, round(stddev_pop(w), 5) AS std, round(avg(w) * avg(w) / avg(w * w), 5) AS effective_share, round(avg(CASE WHEN w >= 2 THEN 1.0::DOUBLE ELSE 0 END), 5) AS share_high, round(avg(CASE WHEN w < 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 5) AS share_low FROM x")
def weight_metrics(spark, sf):
    out = O.weight_metrics(O.importance_weights(I.tokens(spark, sf), threshold=2.0))
    return out.select(*[F.round(c, 5).alias(c) for c in out.columns])
