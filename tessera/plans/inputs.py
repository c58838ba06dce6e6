"""Relations that the registered queries run on, made from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as responses of a group: uid, k, reward and a response length."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("part"), F.round(F.col("l_discount") * 10, 0).alias("reward"), F.col("l_quantity").cast("int").alias("length"), F.col("l_extendedprice").alias("price"))


ROLLOUTS = "ro AS (SELECT l_orderkey AS uid, l_linenumber AS k, l_partkey AS part, round(l_discount * 10, 0) AS reward, CAST(l_quantity AS INTEGER) AS length, l_extendedprice AS price FROM lineitem)"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as rows of 64 tokens with rewards, a mask, log-probabilities and values."""
    e = table(spark, sf_dir, "embeddings")
    x = F.col("embedding").cast("array<double>")
    e = e.select(F.col("vec_id").alias("row_id"), F.when(F.col("vec_id") % 17 == 0, -F.col("vec_id") - 1).otherwise(F.floor(F.col("vec_id") / 4)).alias("uid"), F.col("label"), x.alias("rewards"))

    def turned(n):
        return F.concat(F.slice("rewards", n + 1, 64), F.slice("rewards", 1, n))

    return e.withColumns({
        "mask": F.transform("rewards", lambda v, i: F.when(i < F.col("row_id") % 61, 1).otherwise(0)),
        "log_probs": F.transform("rewards", lambda v: -F.abs(v)),
        "old_log_probs": F.transform(turned(1), lambda v: -F.abs(v)),
        "ref_log_probs": F.transform(turned(2), lambda v: -F.abs(v)),
        "values": F.transform(F.reverse("rewards"), lambda v: v / 2),
        "sum_pi_squared": F.transform(turned(3), lambda v: F.abs(v) / 4),
        "valid": F.when(F.col("row_id") % 3 == 0, 0).otherwise(1),
        "baseline": (F.col("row_id") % 7) / F.lit(7.0),
    })


def _e(i: str) -> str:
    return f"CAST(embedding[{i}] AS DOUBLE)"


TOKENS = f"""tok AS (SELECT vec_id AS row_id, CASE WHEN vec_id % 17 = 0 THEN -vec_id - 1 ELSE vec_id // 4 END AS uid, label, CAST(g.t AS INTEGER) AS t,
 {_e('g.t + 1')} AS r, CASE WHEN g.t < vec_id % 61 THEN 1 ELSE 0 END AS m, -abs({_e('g.t + 1')}) AS lp, -abs({_e('(g.t + 1) % 64 + 1')}) AS old, -abs({_e('(g.t + 2) % 64 + 1')}) AS ref,
 {_e('64 - g.t')} / 2 AS v, abs({_e('(g.t + 3) % 64 + 1')}) / 4 AS pi2, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS valid, (vec_id % 7) / 7.0::DOUBLE AS base FROM embeddings, range(64) AS g(t))"""
ROWS = "rws AS (SELECT row_id, uid, label, valid, sum(r) AS s, sum(m)::DOUBLE AS len FROM tok GROUP BY ALL)"
STATS = "st AS (SELECT *, count(*) OVER w AS n, avg(s) OVER w AS mean, stddev_samp(s) OVER w AS sd FROM rws WINDOW w AS (PARTITION BY uid))"
