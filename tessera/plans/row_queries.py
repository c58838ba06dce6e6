"""Row operators and evaluation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import evaluation as E
from ..operators import rows as R
from . import inputs as I
from .catalog import query

# documents are numbered by doc_id, which is unique and dense
DOCS = "d AS (SELECT doc_id AS pos, source, lang, n_chars FROM documents)"


def docs(spark, sf):
    return I.table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "source", "lang", "n_chars")


query("r1_repeat_interleaved", f"WITH {DOCS} SELECT pos * 3 + k AS pos, n_chars FROM d, range(3) AS g(k)")(lambda s, f: R.repeat(docs(s, f), 3).select("pos", "n_chars"))
query("r1_repeat_whole", f"WITH {DOCS} SELECT CAST(k * (SELECT max(pos) + 1 FROM d) + pos AS BIGINT) AS pos, n_chars FROM d, range(3) AS g(k)")(lambda s, f: R.repeat(docs(s, f), 3, interleave=False).select("pos", "n_chars"))
query("r2_repeat_each", f"WITH {DOCS} SELECT pos, CAST(k AS INTEGER) AS copy FROM d, range(6) AS g(k) WHERE k < n_chars % 6")(lambda s, f: R.repeat_each(docs(s, f).withColumn("c", F.col("n_chars") % 6), "c").select("pos", "copy"))
query("r3_pad_last", f"WITH {DOCS} SELECT pos, n_chars FROM d UNION ALL SELECT pos + 1 + k, n_chars FROM d, range(5) AS g(k) WHERE pos = (SELECT max(pos) FROM d)")(lambda s, f: R.pad(docs(s, f), 5).select("pos", "n_chars"))
query("r3_pad_first", f"WITH {DOCS} SELECT pos, n_chars FROM d UNION ALL SELECT CAST((SELECT max(pos) FROM d) + 1 + k AS BIGINT), n_chars FROM d, range(5) AS g(k) WHERE pos = 0")(lambda s, f: R.pad(docs(s, f), 5, "first").select("pos", "n_chars"))
query("r4_pad_to_multiple", f"WITH {DOCS}, n AS (SELECT max(pos) + 1 AS n FROM d) SELECT pos, n_chars, false AS is_pad FROM d UNION ALL SELECT n + pos, n_chars, true FROM d, n WHERE pos < (7 - n % 7) % 7")(lambda s, f: R.pad_to_multiple(docs(s, f), 7).select("pos", "n_chars", "is_pad"))
query("r4_unpad", f"WITH {DOCS} SELECT pos, n_chars FROM d")(lambda s, f: R.unpad(R.pad_to_multiple(docs(s, f), 7)).select("pos", "n_chars"))
query("r7_split", f"WITH {DOCS} SELECT pos, CAST(pos // 64 AS INTEGER) AS part FROM d")(lambda s, f: docs(s, f).select("pos", R.split_number(64).alias("part")))
query("f4_slice", f"WITH {DOCS} SELECT pos, n_chars FROM d WHERE pos >= 10 AND pos < 500 AND (pos - 10) % 7 = 0")(lambda s, f: R.slice_rows(docs(s, f), 10, 500, 7).select("pos", "n_chars"))
query("f4_slice_from_end", f"WITH {DOCS} SELECT pos FROM d WHERE pos >= (SELECT max(pos) - 19 FROM d)")(lambda s, f: R.slice_rows(docs(s, f), -20).select("pos"))
query("f3_rows_by_mask", f"WITH {DOCS} SELECT pos, lang FROM d WHERE lang = 'fr'")(lambda s, f: R.rows_by_mask(docs(s, f), F.col("lang") == "fr").select("pos", "lang"))
query("f2_first_rows", f"WITH {DOCS} SELECT pos FROM d WHERE pos < 100")(lambda s, f: R.sample_first(docs(s, f), 100).select("pos"))


@query("r6_chunk", f"WITH {DOCS} SELECT pos, CAST(pos // ((SELECT count(*) FROM d) // 4) AS INTEGER) AS chunk FROM d")
def chunk(spark, sf):
    d = docs(spark, sf)
    return d.select("pos", R.chunk_number(d.count(), 4, rest=True).alias("chunk"))


@query("r29_uneven_split", f"WITH {DOCS} SELECT pos, CAST(ntile(7) OVER (ORDER BY pos) - 1 AS INTEGER) AS part FROM d")
def uneven(spark, sf):
    d = docs(spark, sf)
    return d.select("pos", R.uneven_number(d.count(), 7).alias("part"))


@query("r12_split_whole", f"WITH {DOCS}, n AS (SELECT count(*) // 7 AS size FROM d) SELECT pos, CAST(pos // size AS INTEGER) AS part FROM d, n WHERE pos < size * 7")
def split_whole(spark, sf):
    d = docs(spark, sf)
    return R.split_whole(d, d.count(), 7).select("pos", "part")


INDEX = [(0, 5), (1, 3), (2, -1), (3, 5), (4, 0)]


@query("f3_rows_by_index", f"WITH {DOCS}, ix(ord, idx) AS (VALUES {', '.join(map(str, INDEX))}) SELECT CAST(ord AS BIGINT) AS pos, n_chars FROM ix JOIN d ON d.pos = CASE WHEN idx < 0 THEN idx + (SELECT count(*) FROM d) ELSE idx END")
def by_index(spark, sf):
    return R.rows_by_index(docs(spark, sf), spark.createDataFrame(INDEX, "ord long, idx long")).select("pos", "n_chars")


@query("r5_reorder", f"WITH {DOCS} SELECT (SELECT max(pos) FROM d) - pos AS pos, n_chars FROM d")
def reorder(spark, sf):
    d = docs(spark, sf)
    last = d.agg(F.max("pos").alias("last"))
    return R.reorder(d, d.crossJoin(F.broadcast(last)).select((F.col("last") - F.col("pos")).alias("ord"), F.col("pos").alias("idx"))).select("pos", "n_chars")


@query("r8_concat", f"WITH {DOCS} SELECT pos, n_chars FROM d UNION ALL SELECT pos + (SELECT count(*) FROM d), n_chars FROM d")
def concat(spark, sf):
    d = docs(spark, sf)
    return R.concat([d, d]).select("pos", "n_chars")


@query("p4_column_union", "SELECT doc_id AS pos, lang, n_chars, source FROM documents")
def union(spark, sf):
    d = docs(spark, sf)
    return R.column_union(d.select("pos", "lang", "n_chars"), d.select("pos", "lang", "source"))


@query("p7_fold", "SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def fold(spark, sf):
    c = I.table(spark, sf, "conversations")
    x = R.fold(c, "conv_id", ["turn", "role"], ["turn"])
    return x.select("conv_id", F.size("turn").cast("long").alias("turns"), F.array_join("role", ",").alias("roles"))


@query("p7_unfold", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS k, role FROM conversations")
def unfold(spark, sf):
    c = I.table(spark, sf, "conversations")
    return R.unfold(R.fold(c, "conv_id", ["turn", "role"], ["turn"]), ["turn", "role"]).select("conv_id", "k", "role")


@query("p8_unfold_chunks", f"WITH {I.TOKENS} SELECT row_id, CAST(t // 16 AS INTEGER) AS chunk, round(sum(r), 4) AS total FROM tok GROUP BY ALL")
def unfold_chunks(spark, sf):
    x = R.unfold_chunks(I.tokens(spark, sf).select("row_id", "rewards"), ["rewards"], 4)
    return x.select("row_id", "chunk", F.round(A.total("rewards"), 4).alias("total"))


@query("p11_prefixed", "SELECT doc_id AS \"x/doc_id\", n_chars AS \"x/n_chars\" FROM documents")
def prefixed(spark, sf):
    return R.prefixed(I.table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("x/n_chars")), "x/")


@query("p16_response_mask", f"WITH {I.TOKENS} SELECT row_id, CAST(sum(m) AS BIGINT) AS tokens FROM tok WHERE t >= 32 GROUP BY row_id")
def response_mask(spark, sf):
    return I.tokens(spark, sf).select("row_id", A.count(F.slice("mask", -32, 32)).cast("long").alias("tokens"))


@query("r9_mini_batches", f"WITH {DOCS} SELECT CAST(e AS INTEGER) AS epoch, CAST(pos // 50 AS INTEGER) AS batch, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM d, range(2) AS g(e) GROUP BY ALL")
def mini_batches(spark, sf):
    d = docs(spark, sf)
    return R.mini_batches(d, d.count(), 50, 2, rest=True).groupBy("epoch", "batch").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("r14_drop_partial", f"WITH {DOCS}, b AS (SELECT CAST(pos // 64 AS INTEGER) AS batch, count(*) AS n FROM d GROUP BY 1) SELECT batch, n FROM b WHERE n = 64")
def drop_partial(spark, sf):
    d = docs(spark, sf).withColumn("batch", R.split_number(64))
    return R.drop_partial(d, 64).groupBy("batch").agg(F.count("*").alias("n"))


@query("r24_run_number", "WITH x AS (SELECT conv_id, turn, role, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), y AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM x) SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS INTEGER) AS run_index FROM y")
def run_number(spark, sf):
    return R.run_number(I.table(spark, sf, "conversations"), "role", "turn", "conv_id").select("conv_id", "turn", "run_index")


@query("numbered", "SELECT event_id, CAST(row_number() OVER (ORDER BY value, event_id) - 1 AS BIGINT) AS pos FROM events")
def numbered(spark, sf):
    return R.numbered(I.table(spark, sf, "events").select("event_id", "value"), "value", "event_id").select("event_id", F.col("pos").cast("long").alias("pos"))


@query("r25_sample_groups")
def sample_groups(spark, sf):
    return R.sample_groups(I.rollouts(spark, sf), "uid", 20).groupBy("uid").agg(F.count("*").alias("n"))


@query("r15_resample")
def resample(spark, sf):
    d = docs(spark, sf)
    return R.resample(d, F.col("n_chars").cast("double"), 500, 1).groupBy("pos").agg(F.count("*").alias("times"))


@query("f2_seeded_rows")
def seeded(spark, sf):
    d = docs(spark, sf)
    return R.sample_seeded(d, d.count(), 100, 7).select("pos")


EV = "ev AS (SELECT event_type AS source, user_id AS uid, event_id AS pos, value, json_extract_string(props, '$.k') AS vote FROM events)"


def events(spark, sf):
    e = I.table(spark, sf, "events")
    return e.select(F.col("event_type").alias("source"), F.col("user_id").alias("uid"), F.col("event_id").alias("pos"), "value", F.get_json_object("props", "$.k").alias("vote"))


@query("a15_majority", f"WITH {EV}, v AS (SELECT source, uid, vote, count(*) AS n, min(pos) AS p, arg_min(value, pos) AS value FROM ev GROUP BY ALL) SELECT source, uid, arg_max(value, n * 1000000000 - p) AS value FROM v GROUP BY ALL")
def majority(spark, sf):
    return E.majority(events(spark, sf), ["source", "uid"], "vote", "value", "pos")


@query("a16_mean_std", f"WITH {EV}, g AS (SELECT source, uid, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM ev GROUP BY ALL) SELECT source, metric, round(avg(value), 5) AS value FROM (SELECT source, 'mean@' || n AS metric, m AS value FROM g UNION ALL SELECT source, 'std@' || n, s FROM g WHERE n > 1) GROUP BY ALL")
def mean_std(spark, sf):
    e = events(spark, sf)
    groups = e.groupBy("source", "uid").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    rows = groups.select("source", F.explode(F.array(F.struct(F.concat(F.lit("mean@"), F.col("n")).alias("metric"), F.col("mean").alias("value")), F.struct(F.concat(F.lit("std@"), F.col("n")).alias("metric"), F.when(F.col("n") > 1, F.col("std")).alias("value")))).alias("m")).select("source", "m.*")
    return rows.filter("value IS NOT NULL").groupBy("source", "metric").agg(F.round(F.avg("value"), 5).alias("value"))


@query("a13_variance_proxies", f"""WITH {I.TOKENS}, x AS (SELECT row_id, coalesce(sum(CASE WHEN m <> 0 THEN r END), 0) / (sum(m) + 1e-8::DOUBLE) AS a, coalesce(sum(CASE WHEN m <> 0 THEN pi2 END), 0) AS w,
 greatest(coalesce(sum(CASE WHEN m <> 0 THEN pi2 / greatest(exp(lp - old) * exp(lp - old), 1e-10::DOUBLE) END), 0), 0) AS o, coalesce(sum(CASE WHEN m <> 0 THEN exp(lp - old) END), 0) / (sum(m) + 1e-8::DOUBLE) AS q FROM tok GROUP BY row_id),
 p AS (SELECT avg(q * q * a * a * o) AS power, avg(a * a) AS a2, avg(w) AS w, count(*) AS n FROM x)
 SELECT round(0.0001::DOUBLE, 9) AS signal_strength, round(power, 9) AS total_power, round(greatest((power - 0.0001::DOUBLE) / (n - 1), 0), 9) AS pure_noise, round(a2, 9) AS expected_a_squared, round(w, 6) AS expected_w FROM p""")
def variance_proxies(spark, sf):
    x = I.tokens(spark, sf).withColumn("weights", F.zip_with("log_probs", "old_log_probs", lambda a, b: F.exp(a - b)))
    out = E.variance_proxies(x, "rewards", "sum_pi_squared", "mask", "weights", 0.01)
    return out.select(*[F.round(c, 6 if c == "expected_w" else 9).alias(c) for c in out.columns])


@query("a16_validation_metrics")
def validation(spark, sf):
    """Best, worst and majority of N by bootstrap over all samples of each group; tests repeat the draws in NumPy."""
    return E.validation_metrics(events(spark, sf), vote="vote")


@query("a20_mean_of_means", f"WITH {EV}, g AS (SELECT source, uid, avg(value) AS m FROM ev GROUP BY ALL) SELECT source, round(avg(m), 6) AS value FROM g GROUP BY source")
def means(spark, sf):
    return E.mean_of_means(events(spark, sf), "uid", F.col("value"), ["source"]).select("source", F.round("value", 6).alias("value"))


@query("a18_valid_mean_of_means", f"WITH {I.TOKENS}, {I.ROWS}, g AS (SELECT uid, avg(s) AS m FROM rws WHERE valid = 1 GROUP BY uid) SELECT round(avg(m), 6) AS value FROM g")
def valid_means(spark, sf):
    return E.mean_of_means(I.tokens(spark, sf), "uid", F.when(F.col("valid") == 1, A.total("rewards"))).select(F.round("value", 6).alias("value"))


@query("a7_reduce_metrics", "WITH m AS (SELECT event_type || CASE user_id % 3 WHEN 0 THEN '/max' WHEN 1 THEN '/min' ELSE '/all' END AS name, value FROM events) SELECT name, round(CASE WHEN name LIKE '%max%' THEN max(value) WHEN name LIKE '%min%' THEN min(value) ELSE avg(value) END, 6) AS value FROM m GROUP BY name")
def reduce_metrics(spark, sf):
    e = I.table(spark, sf, "events")
    name = F.concat("event_type", F.when(F.col("user_id") % 3 == 0, "/max").when(F.col("user_id") % 3 == 1, "/min").otherwise("/all"))
    return E.reduce_metrics(e.select(name.alias("name"), "value")).select("name", F.round("value", 6).alias("value"))


@query("a9_aggregate_ranks", f"WITH {I.TOKENS}, p AS (SELECT t, avg(r) AS v FROM tok GROUP BY t) SELECT round(sum(v), 6) AS total FROM p")
def ranks(spark, sf):
    x = I.tokens(spark, sf).select(F.col("row_id").alias("rank"), F.posexplode("rewards").alias("pos", "value"))
    return E.aggregate_ranks(x, "sum").select(F.round("value", 6).alias("total"))


@query("a10_data_metrics", """WITH x AS (SELECT l_discount AS score, l_tax AS reward, CAST(l_quantity AS INTEGER) - 1 AS length, l_linenumber AS prompt FROM lineitem)
 SELECT round(avg(score), 6) AS score_mean, max(score) AS score_max, min(score) AS score_min, round(avg(reward) FILTER (length > 0), 6) AS reward_mean, max(reward) FILTER (length > 0) AS reward_max, min(reward) FILTER (length > 0) AS reward_min,
 round(avg(length), 6) AS length_mean, max(length) AS length_max, min(length) AS length_min, round(avg(length) FILTER (length > 0), 6) AS length_alive_mean, max(length) FILTER (length > 0) AS length_alive_max, min(length) FILTER (length > 0) AS length_alive_min,
 round(avg(prompt), 6) AS prompt_mean, max(prompt) AS prompt_max, min(prompt) AS prompt_min, round(avg(CASE WHEN length = 49 THEN 1.0::DOUBLE ELSE 0 END), 6) AS clip_ratio, round(avg(CASE WHEN length = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS aborted_ratio FROM x""")
def data_metrics(spark, sf):
    li = I.table(spark, sf, "lineitem")
    x = li.select(F.col("l_discount").alias("score"), F.col("l_tax").alias("reward"), (F.col("l_quantity").cast("int") - 1).alias("length"), F.col("l_linenumber").alias("prompt"))
    out = E.data_metrics(x, prompt="prompt", limit=49)
    return out.select(*[F.round(c, 6).alias(c) if c.endswith(("mean", "ratio")) else F.col(c) for c in out.columns])


@query("a10_explained_variance", f"WITH {I.TOKENS} SELECT round(1 - var_samp(r - v) / (var_samp(r) + 1e-5), 6) AS explained_variance FROM tok WHERE m = 1")
def explained(spark, sf):
    x = I.tokens(spark, sf).select(F.explode(F.arrays_zip("rewards", "values", "mask")).alias("x")).filter("x.mask = 1").select("x.rewards", "x.values")
    return E.explained_variance(x, "rewards", "values").select(F.round("explained_variance", 6).alias("explained_variance"))


@query("a21_reward_stats", f"WITH {I.TOKENS}, {I.ROWS} SELECT round(avg(valid), 6) AS valid_rate, round(avg(s) FILTER (valid = 1), 6) AS mean, round(var_pop(s) FILTER (valid = 1), 6) AS variance FROM rws")
def reward_stats(spark, sf):
    out = E.reward_stats(I.tokens(spark, sf).select("valid", A.total("rewards").alias("reward")), valid=F.col("valid") == 1)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("a22_group_reward_stats", f"""WITH {I.ROLLOUTS}, g AS (SELECT uid, avg(reward) AS m, var_pop(reward) AS v, list_sort(list(reward), 'DESC') AS l, min(reward) AS lo, max(reward) AS hi FROM ro GROUP BY uid HAVING count(*) >= 2), b AS (SELECT max(reward) AS top, min(reward) AS low FROM ro)
 SELECT round(avg(m), 6) AS mean, round(avg(v), 6) AS variance, round(avg(sqrt(v)), 6) AS std, round(avg(l[1] - l[2]), 6) AS lead, round(avg(CASE WHEN lo = top THEN 1.0::DOUBLE ELSE 0 END), 6) AS all_one, round(avg(CASE WHEN hi = low THEN 1.0::DOUBLE ELSE 0 END), 6) AS all_zero, round(avg(CASE WHEN lo = hi THEN 1.0::DOUBLE ELSE 0 END), 6) AS no_variance,
 round(avg(CASE WHEN lo > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS all_correct, round(avg(CASE WHEN hi <= 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS none_correct FROM g, b""")
def group_reward_stats(spark, sf):
    out = E.group_reward_stats(I.rollouts(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("a24_sign_ratios", f"WITH {I.TOKENS}, {I.ROWS} SELECT round(avg(CASE WHEN s > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive, round(avg(CASE WHEN s < 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS negative, round(avg(CASE WHEN abs(s) < 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero FROM rws")
def sign_ratios(spark, sf):
    out = E.sign_ratios(I.tokens(spark, sf).select(A.total("rewards").alias("reward")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("a26_probability_distance", f"WITH {I.TOKENS} SELECT round(corr(exp(lp), exp(old)), 5) AS pearson, round(avg(abs(exp(lp) - exp(old))), 6) AS mean, round(max(abs(exp(lp) - exp(old))), 6) AS max, round(stddev_samp(abs(exp(lp) - exp(old))), 6) AS std FROM tok WHERE m = 1")
def probability_distance(spark, sf):
    x = I.tokens(spark, sf).select(F.explode(F.arrays_zip("log_probs", "old_log_probs", "mask")).alias("x")).filter("x.mask = 1").select(F.exp("x.log_probs").alias("a"), F.exp("x.old_log_probs").alias("b"))
    out = E.probability_distance(x, "a", "b")
    return out.select(F.round("pearson", 5).alias("pearson"), *[F.round(c, 6).alias(c) for c in ("mean", "max", "std")])


@query("a27_mismatches", f"WITH {I.TOKENS} SELECT row_id, CAST(sum(CASE WHEN m = 1 AND floor(lp * 4) <> floor(old * 4) THEN 1 ELSE 0 END) AS INTEGER) AS n FROM tok GROUP BY row_id")
def mismatches(spark, sf):
    x = I.tokens(spark, sf)
    q = lambda c: F.transform(c, lambda v: F.floor(v * 4))
    return x.select("row_id", E.mismatches(q("log_probs"), q("old_log_probs"), F.col("mask")).alias("n"))


@query("a32_slowest", "SELECT min(l_extendedprice + l_quantity) AS min, max(l_extendedprice + l_quantity) AS max, round(avg(l_extendedprice + l_quantity), 4) AS mean, arg_max(l_quantity, l_extendedprice + l_quantity) AS slowest_l_quantity FROM lineitem")
def slowest(spark, sf):
    out = E.slowest(I.table(spark, sf, "lineitem"), F.col("l_extendedprice") + F.col("l_quantity"), "l_quantity")
    return out.withColumn("mean", F.round("mean", 4))


@query("a33_tail_ratio", "WITH q AS (SELECT quantile_cont(value, 0.9) AS edge FROM events) SELECT round(avg(CASE WHEN value > edge THEN 1.0::DOUBLE ELSE 0 END), 6) AS tail_ratio FROM events, q")
def tail_ratio(spark, sf):
    return E.tail_ratio(I.table(spark, sf, "events"), "value", 10).select(F.round("tail_ratio", 6).alias("tail_ratio"))


@query("a34_strict_saturation", "SELECT l_orderkey AS uid, l_returnflag AS criterion FROM lineitem GROUP BY ALL HAVING count(*) = 3 AND bool_and(l_linestatus = 'F' AND l_quantity >= 10)")
def saturation(spark, sf):
    li = I.table(spark, sf, "lineitem")
    x = li.select(F.col("l_orderkey").alias("uid"), F.col("l_returnflag").alias("criterion"), F.when(F.col("l_quantity") >= 10, 2).otherwise(1).alias("score"), F.lit(2).alias("best"), (F.col("l_linestatus") == "F").alias("valid"))
    return E.strict_saturation(x, 3)


@query("a35_group_summary", """WITH v AS (SELECT d.source AS uid, d.text AS response, d.n_chars AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1), g AS (SELECT uid, count(*) AS n, avg(score) AS mean, median(score) AS median FROM v GROUP BY uid HAVING count(*) >= 4)
 SELECT uid, n, round(mean, 4) AS mean, median, sha256(response) AS representative FROM (SELECT v.*, g.n, g.mean, g.median, row_number() OVER (PARTITION BY v.uid ORDER BY abs(score - median), sha256(response)) AS rk FROM v JOIN g ON v.uid = g.uid) WHERE rk = 1""")
def group_summary(spark, sf):
    x = I.table(spark, sf, "documents").join(I.table(spark, sf, "labels"), "doc_id")
    x = x.select(F.col("source").alias("uid"), F.col("text").alias("response"), F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("valid"))
    return E.group_summary(x, 8).select("uid", "n", F.round("mean", 4).alias("mean"), "median", F.sha2("representative", 256).alias("representative"))
