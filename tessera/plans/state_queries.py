"""Balancing, sources, packing of sequences, and step-ordered state over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import balance as B
from ..operators import rows as R
from ..sources import files as S
from ..streaming import evolution as T
from . import inputs as I
from .catalog import query


@query("r16_workload", "SELECT doc_id, 24576 * n_chars + n_chars * n_chars AS load FROM documents")
def workload(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", B.workload(F.col("n_chars")).alias("load"))


@query("r17_largest_differencing")
def differencing(spark, sf):
    d = I.table(spark, sf, "documents")
    return B.deal(d, "source", "doc_id", "n_chars", 4)


@query("r18_greedy", """WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
 g AS (SELECT DISTINCT source, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS doc_id, -1 AS part, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS d FROM documents
 UNION ALL SELECT source, r, doc_id, part, a + CASE part WHEN 0 THEN n_chars ELSE 0 END, b + CASE part WHEN 1 THEN n_chars ELSE 0 END, c + CASE part WHEN 2 THEN n_chars ELSE 0 END, d + CASE part WHEN 3 THEN n_chars ELSE 0 END
 FROM (SELECT g.source, o.r, o.doc_id, o.n_chars, a, b, c, d, CASE WHEN a <= b AND a <= c AND a <= d THEN 0 WHEN b <= c AND b <= d THEN 1 WHEN c <= d THEN 2 ELSE 3 END AS part FROM g JOIN o ON o.source = g.source AND o.r = g.r + 1))
 SELECT source, doc_id, CAST(part AS INTEGER) AS part FROM g WHERE r > 0""")
def greedy(spark, sf):
    return B.deal(I.table(spark, sf, "documents"), "source", "doc_id", "n_chars", 4, method="greedy")


@query("r22_deal_groups")
def deal_groups(spark, sf):
    return B.deal_groups(I.table(spark, sf, "documents"), "lang", "source", "n_chars", 3)


@query("r19_part_stats", "WITH p AS (SELECT doc_id // 100 AS part, sum(n_chars) AS s FROM documents GROUP BY 1) SELECT CAST(min(s) AS BIGINT) AS min, CAST(max(s) AS BIGINT) AS max, CAST(max(s) - min(s) AS BIGINT) AS diff, round(sum(s) / 10.0::DOUBLE, 4) AS mean FROM p")
def part_stats(spark, sf):
    d = I.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 100).alias("part"), "n_chars")
    return B.part_stats(d, "part", "n_chars", 10).withColumn("mean", F.round("mean", 4))


@query("r20_ends_small", """WITH s AS (SELECT source, doc_id % 5 AS part, CAST(sum(n_chars) AS BIGINT) AS load, min(doc_id) AS first FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY load DESC, first DESC) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM s)
 SELECT source, part, load, CAST(CASE WHEN r % 2 = 0 THEN (n + 1) // 2 - 1 - r // 2 ELSE (n + 1) // 2 + r // 2 END AS INTEGER) AS turn FROM r""")
def ends_small(spark, sf):
    d = I.table(spark, sf, "documents").select("source", "doc_id", (F.col("doc_id") % 5).alias("part"), F.col("n_chars").alias("load"))
    return B.ends_small(d, "source", "doc_id")


@query("r21_inverse", "SELECT doc_id AS pos, n_chars FROM documents")
def inverse(spark, sf):
    d = I.table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "n_chars")
    n = d.count()
    turn = d.select(((F.col("pos") * 7 + 3) % n).alias("ord"), F.col("pos").alias("idx")) if n % 7 else d.select((n - 1 - F.col("pos")).alias("ord"), F.col("pos").alias("idx"))
    return R.reorder(R.reorder(d, turn), B.inverse(turn)).select("pos", "n_chars")


@query("l20_place_at_end", f"WITH {I.TOKENS}, l AS (SELECT row_id, CASE WHEN sum(m) = 0 THEN 63 ELSE sum(m) - 1 END AS place FROM tok GROUP BY row_id) SELECT row_id, CAST(place AS INTEGER) AS place, round(row_id % 7 / 7.0::DOUBLE, 6) AS total FROM l")
def place_at_end(spark, sf):
    x = I.tokens(spark, sf).withColumn("p", A.place_at_end(F.col("baseline") + 1, "mask"))
    at = F.array_position(F.transform("p", lambda v: v != 0), True) - 1
    return x.select("row_id", at.cast("int").alias("place"), F.round(A.total("p") - 1, 6).alias("total"))


@query("l17_until_first", "WITH x AS (SELECT p_partkey, (p_partkey + g.i * 3) % 11 AS t, g.i AS i FROM part, range(12) AS g(i)), f AS (SELECT p_partkey, min(i) FILTER (t = 5) AS stop FROM x GROUP BY 1) SELECT p_partkey, CAST(coalesce(stop + 1, 12) AS INTEGER) AS kept FROM f")
def until_first(spark, sf):
    p = I.table(spark, sf, "part").select("p_partkey", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: ((F.col("p_partkey") + i * 3) % 11).cast("int")).alias("t"))
    return p.select("p_partkey", F.aggregate(A.until_first("t", 5), F.lit(0), lambda s, x: s + x).alias("kept"))


def _fit_query(side: str, cut: str, sql: str):
    query(f"l14_fit_{side}_{cut}", f"WITH s AS (SELECT user_id, list(CAST(event_id AS INTEGER) ORDER BY event_id) AS l FROM events GROUP BY user_id) SELECT user_id, array_to_string({sql}, ',') AS tokens FROM s")(
        lambda spark, sf: I.table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.col("event_id").cast("int"))).alias("l")).select("user_id", F.array_join(A.fit("l", 64, -1, side, cut), ",").alias("tokens"))
    )


_PAD = "list_resize([]::INTEGER[], greatest(64 - len(l), 0), -1)"
_fit_query("right", "right", f"CASE WHEN len(l) > 64 THEN l[1:64] ELSE list_concat(l, {_PAD}) END")
_fit_query("left", "left", f"CASE WHEN len(l) > 64 THEN l[len(l)-63:len(l)] ELSE list_concat({_PAD}, l) END")
_fit_query("left", "middle", f"CASE WHEN len(l) > 64 THEN list_concat(l[1:32], l[len(l)-31:len(l)]) ELSE list_concat({_PAD}, l) END")


@query("l15_chat_packing", "SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY turn) = '' AS blank, CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT) AS learned, CAST(sum(length(text)) AS BIGINT) AS total FROM conversations GROUP BY conv_id")
def chat_packing(spark, sf):
    """Turns in order as one sequence of characters, with a mask of what the assistant said."""
    c = R.fold(I.table(spark, sf, "conversations"), "conv_id", ["turn", "role", "text"], ["turn"])
    tokens = F.flatten(F.transform("text", lambda t: F.split(t, "")))
    mask = F.flatten(F.zip_with("role", "text", lambda r, t: F.array_repeat((r == "assistant").cast("int"), F.length(t))))
    x = c.select("conv_id", F.filter(tokens, lambda t: t != "").alias("tokens"), mask.alias("mask"))
    learned = F.aggregate("mask", F.lit(0), lambda s, m: s + m).cast("long")
    return x.select("conv_id", (F.size("tokens") == 0).alias("blank"), F.when(learned > 0, learned).alias("learned"), F.size("tokens").cast("long").alias("total"))


@query("s5_samples", "SELECT doc_id, 3 AS n, md5(source || '/0,' || source || '/1,' || source || '/2') AS responses FROM documents")
def samples(spark, sf):
    d = I.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "source")
    x = S.expanded_samples(d, 3).withColumn("response", F.concat_ws("/", "source", "sample"))
    return S.gathered_responses(x).select(F.col("row_id").alias("doc_id"), F.size("responses").alias("n"), F.md5(F.array_join("responses", ",")).alias("responses"))


@query("s6_scored_responses", "SELECT lang AS data_source, round(avg((length(source) + length(lang)) / 2.0::DOUBLE), 6) AS score FROM documents GROUP BY lang")
def scored(spark, sf):
    d = I.table(spark, sf, "documents").select(F.col("lang").alias("data_source"), F.array("source", "lang").alias("responses"))
    return S.scored_responses(d, lambda r: F.length(r).cast("double")).withColumn("score", F.round("score", 6))


@query("s12_metric_names", "SELECT DISTINCT replace(replace(event_type || '//best@4/mean?', '@', '_at_'), '//', '/').replace('?', '_') AS name FROM events")
def metric_names(spark, sf):
    return I.table(spark, sf, "events").select(S.clean_metric_name(F.concat("event_type", F.lit("//best@4/mean?"))).alias("name")).distinct()


@query("s13_flattened", "SELECT doc_id AS \"a.id\", lang AS \"a.b.lang\", n_chars FROM documents")
def flattened(spark, sf):
    d = I.table(spark, sf, "documents")
    return S.flattened(d.select(F.struct(F.col("doc_id").alias("id"), F.struct("lang").alias("b")).alias("a"), "n_chars"))


@query("s10_metric_log", "SELECT day(ts) AS step, count(DISTINCT event_type) AS names FROM events GROUP BY 1")
def metric_log(spark, sf):
    e = I.table(spark, sf, "events").groupBy(F.dayofmonth("ts").alias("step"), F.col("event_type").alias("name")).agg(F.sum("value").alias("value"))
    return S.metric_log(e).select("step", F.size("data").cast("long").alias("names"))


# steps of the state queries are days; groups are order dates' customers
OBS = "ob AS (SELECT o_custkey AS uid, month(o_orderdate) AS global_step, o_orderkey, o_totalprice FROM orders)"


@query("t1_complete_groups", "WITH g AS (SELECT o_custkey AS uid, count(*) AS n FROM orders GROUP BY 1) SELECT uid FROM g WHERE n = (SELECT max(n) FROM g)")
def groups(spark, sf):
    o = I.table(spark, sf, "orders").select(F.col("o_custkey").alias("uid"))
    n = o.groupBy("uid").count().agg(F.max("count")).first()[0]
    return T.complete_groups(o, n).select("uid").distinct()


@query("t2_complete_steps", "WITH g AS (SELECT month(o_orderdate) AS global_step, count(DISTINCT o_custkey) AS groups FROM orders GROUP BY 1) SELECT global_step, groups FROM g WHERE global_step % 2 = 0")
def steps(spark, sf):
    o = I.table(spark, sf, "orders").select(F.col("o_custkey").alias("uid"), F.month("o_orderdate").alias("global_step"))
    want = o.groupBy("global_step").agg(F.count_distinct("uid").alias("n")).select("global_step", F.when(F.col("global_step") % 2 == 0, F.col("n")).otherwise(F.col("n") + 1).alias("step_group_count"))
    return T.complete_steps(o.join(want, "global_step"))


VERSIONS = "ve AS (SELECT c_nationkey AS key, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS version, c_custkey AS source_step, c_name AS rubric FROM customer)"


def versions(spark, sf):
    from pyspark.sql import Window as W

    c = I.table(spark, sf, "customer")
    return c.select(F.col("c_nationkey").alias("key"), F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")).alias("version"), F.col("c_custkey").alias("source_step"), F.col("c_name").alias("rubric"))


@query("t3_active_version", f"WITH {VERSIONS}, s AS (SELECT s_suppkey, s_nationkey AS key, s_suppkey * 7 AS global_step FROM supplier) SELECT s.s_suppkey, s.key, s.global_step, CAST(coalesce(max(version), 0) AS INTEGER) AS version, arg_max(rubric, version) AS rubric FROM s LEFT JOIN ve ON s.key = ve.key AND ve.source_step < s.global_step GROUP BY ALL")
def active(spark, sf):
    s = I.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("key"), (F.col("s_suppkey") * 7).alias("global_step"))
    return T.active_version(s, versions(spark, sf))


@query("t4_commit", f"WITH {VERSIONS}, n AS (SELECT key, max(version) AS now FROM ve GROUP BY key) SELECT key, CAST(version AS INTEGER) AS version, source_step, rubric FROM ve UNION ALL SELECT key, CAST(now + 1 AS INTEGER), CAST(1000000 AS BIGINT), 'new' FROM n WHERE key % 2 = 0")
def commit(spark, sf):
    v = versions(spark, sf)
    new = v.groupBy("key").agg(F.max("version").alias("base_version")).select("key", F.when(F.col("key") % 2 == 0, F.col("base_version")).otherwise(0).alias("base_version"), F.lit(1000000).cast("long").alias("source_step"), F.lit("new").alias("rubric"))
    return T.commit(v, new)[0]


query("t11_resume", f"WITH {VERSIONS} SELECT key, CAST(max(version) AS INTEGER) AS version FROM ve WHERE source_step < 500 GROUP BY key")(lambda spark, sf: T.resume(versions(spark, sf), 500).groupBy("key").agg(F.max("version").alias("version")))
query("t10_history_problems", f"WITH {VERSIONS} SELECT DISTINCT key FROM ve WHERE key = 3 AND version > 1")(lambda spark, sf: T.history_problems(versions(spark, sf).filter("NOT (key = 3 AND version = 1)")))


EVIDENCE = "e AS (SELECT day(ts) AS step, CAST(event_id AS VARCHAR) AS uid, md5(CAST(user_id AS VARCHAR)) AS query_sha256, value AS group_mean, event_id % 5 AS group_valid_count FROM events)"


def evidence(spark, sf):
    e = I.table(spark, sf, "events")
    return e.select(F.dayofmonth("ts").alias("step"), F.col("event_id").cast("string").alias("uid"), F.md5(F.col("user_id").cast("string")).alias("query_sha256"), F.col("value").alias("group_mean"), (F.col("event_id") % 5).alias("group_valid_count"))


@query("t7_strata", f"""WITH {EVIDENCE}, r AS (SELECT * FROM e WHERE step BETWEEN 10 AND 12), o AS (SELECT *, row_number() OVER (PARTITION BY query_sha256 ORDER BY group_valid_count DESC, step DESC, uid) AS k FROM r),
 q AS (SELECT *, row_number() OVER (ORDER BY group_mean, query_sha256) - 1 AS p, count(*) OVER () // 3 AS third FROM o WHERE k = 1) SELECT query_sha256, step, CASE WHEN p < third THEN 0 WHEN p < 2 * third THEN 1 ELSE 2 END AS stratum FROM q""")
def strata(spark, sf):
    return T.strata(T.one_for_each_query(T.recent_evidence(evidence(spark, sf), 12))).select("query_sha256", "step", "stratum")


@query("t8_shadow_gate", "WITH x AS (SELECT p_partkey, p_size AS a, p_size + 0.25::DOUBLE AS b FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 7 <> 0) SELECT count(*) AS cases, count(DISTINCT b) AS different, round(avg(b - a), 6) AS moved, count(*) >= 100 AS passed FROM x")
def shadow(spark, sf):
    p = I.table(spark, sf, "part")
    old = p.select(F.col("p_partkey").alias("case_id"), F.col("p_size").cast("double").alias("score"), (F.col("p_partkey") % 10 != 0).alias("ok"))
    new = p.select(F.col("p_partkey").alias("case_id"), (F.col("p_size") + 0.25).alias("score"), (F.col("p_partkey") % 7 != 0).alias("ok"))
    return T.shadow_gate(old, new, 100).withColumn("moved", F.round("moved", 6))


@query("x_tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf):
    return T.event_windows(I.table(spark, sf, "events"), size="1 day").withColumn("total", F.round("total", 4))


@query("x_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def user_sessions(spark, sf):
    return T.sessions(I.table(spark, sf, "events"))
