"""Assembly of sequences, projections of rows and checks of scores over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import judgment as J
from ..operators import sequences as S
from . import inputs as I
from .catalog import query

_IDS = "CAST(floor(r * 100) AS BIGINT)"


def ids(spark, sf):
    """Rows of 64 token ids with their embeddings' numbers."""
    return I.tokens(spark, sf).withColumn("ids", F.transform("rewards", lambda v: F.floor(v * 100))).withColumn("n", F.col("row_id").cast("int"))


def digest(array):
    """Sum of an array's values times their places from 1."""
    return F.aggregate(F.transform(array, lambda v, i: v * (i + 1)), F.lit(0).cast("bigint"), lambda t, v: t + v)


@query("l16_preference_pair", f"""WITH {I.TOKENS}, x AS (SELECT row_id, t, {_IDS} AS id, row_id % 20 AS p, row_id % 30 AS c, row_id % 24 AS d FROM tok),
 a AS (SELECT row_id, p + c AS n, t AS k, id FROM x WHERE t < p UNION ALL SELECT row_id, p + c, p + t - 20, id FROM x WHERE t >= 20 AND t < 20 + c UNION ALL SELECT DISTINCT row_id, p + c, p + c, 7 FROM x),
 b AS (SELECT row_id, p + d AS n, t AS k, id FROM x WHERE t < p UNION ALL SELECT row_id, p + d, p + t - 40, id FROM x WHERE t >= 40 AND t < 40 + d UNION ALL SELECT DISTINCT row_id, p + d, p + d, 7 FROM x),
 u AS (SELECT row_id, CAST(sum(id * (k + 1)) AS BIGINT) AS chosen, count(*) AS chosen_tokens FROM a WHERE k < 32 GROUP BY row_id), v AS (SELECT row_id, CAST(sum(id * (k + 1)) AS BIGINT) AS rejected, count(*) AS rejected_tokens FROM b WHERE k < 32 GROUP BY row_id)
 SELECT * FROM u JOIN v USING (row_id)""")
def preference_pair(spark, sf):
    n = F.col("n")
    pair = S.preference_pair(F.slice("ids", F.lit(1), n % 20), F.slice("ids", F.lit(21), n % 30), F.slice("ids", F.lit(41), n % 24), 7, 32)
    x = ids(spark, sf).select("row_id", pair.alias("x"))
    count = lambda k: A.count(F.col("x.attention_mask")[k]).cast("long")
    return x.select("row_id", digest(F.col("x.input_ids")[0]).alias("chosen"), count(0).alias("chosen_tokens"), digest(F.col("x.input_ids")[1]).alias("rejected"), count(1).alias("rejected_tokens"))


@query("l18_without_left_pad", f"WITH {I.TOKENS}, x AS (SELECT row_id, t, {_IDS} AS id, row_id % 61 AS n FROM tok) SELECT row_id, CAST(coalesce(sum(id * (t - 63 + n)) FILTER (t >= 64 - n), 0) AS BIGINT) AS digest FROM x GROUP BY row_id")
def without_left_pad(spark, sf):
    return ids(spark, sf).select("row_id", digest(S.without_left_pad(F.col("ids"), F.reverse("mask"))).alias("digest"))


@query("l18_sequence_offsets", "SELECT vec_id AS row_id, CAST(sum(vec_id % 61) OVER w - vec_id % 61 AS BIGINT) AS \"start\", CAST(sum(vec_id % 61) OVER w AS BIGINT) AS \"end\" FROM embeddings WINDOW w AS (ORDER BY vec_id)")
def sequence_offsets(spark, sf):
    return S.sequence_offsets(I.tokens(spark, sf).select("row_id", A.count("mask").alias("n")), "n", "row_id", block=128).select("row_id", "start", "end")


@query("l19_ragged", f"WITH {I.TOKENS}, x AS (SELECT row_id, {_IDS} AS id, row_number() OVER (PARTITION BY row_id ORDER BY t) AS k FROM tok WHERE t >= 64 - row_id % 61) SELECT row_id, CAST(sum(id * k) AS BIGINT) AS digest FROM x GROUP BY row_id")
def ragged(spark, sf):
    x = ids(spark, sf).select("row_id", S.ragged(F.col("ids"), F.reverse("mask")).alias("ids"))
    return x.filter(F.size("ids") > 0).select("row_id", digest(F.col("ids")).alias("digest"))


@query("l19_response_values", f"WITH {I.TOKENS}, x AS (SELECT row_id, r, t - row_id % 10 AS k, row_id % 50 AS n FROM tok) SELECT row_id, round(coalesce(sum(r * (k + 1)) FILTER (k >= 0 AND k < n), 0), 5) AS digest, 50 AS size FROM x GROUP BY row_id")
def response_values(spark, sf):
    p, n = F.col("n") % 10 + 1, F.col("n") % 50
    x = ids(spark, sf).select("row_id", S.response_values(F.slice("rewards", F.lit(1), p + n), p, n, 50).alias("v"))
    total = F.aggregate(F.transform("v", lambda v, i: v * (i + 1)), F.lit(0.0), lambda t, v: t + v)
    return x.select("row_id", F.round(total, 5).alias("digest"), F.size("v").alias("size"))


@query("l21_assemble", f"""WITH {I.TOKENS}, x AS (SELECT row_id, t, {_IDS} AS id, row_id % 20 AS p, least(row_id % 30, 24) AS c FROM tok),
 s AS (SELECT row_id, max(p) AS p, max(c) AS c, CAST(coalesce(sum(id * (20 - p + t + 1)) FILTER (t < p), 0) + coalesce(sum(id * (t + 1)) FILTER (t >= 20 AND t < 20 + c), 0) AS BIGINT) AS ids, CAST(max(p) + max(c) AS BIGINT) AS attended, count(*) FILTER (t >= 20 AND t < 20 + c AND t % 3 <> 0) AS generated FROM x GROUP BY row_id)
 SELECT row_id, ids, attended, generated, CAST((SELECT sum(greatest(0, least(i, 19 + c) - (20 - p)) * (i + 1)) FROM range(44) AS g(i)) AS BIGINT) AS places FROM s""")
def assemble(spark, sf):
    n = F.col("n")
    made = F.transform(F.slice("ids", F.lit(21), n % 30), lambda _, i: F.when((i + 20) % 3 != 0, 1).otherwise(0))
    x = ids(spark, sf).select("row_id", S.assemble(F.slice("ids", F.lit(1), n % 20), F.slice("ids", F.lit(21), n % 30), made, 20, 24).alias("x"))
    return x.select("row_id", digest(F.col("x.input_ids")).alias("ids"), A.count("x.attention_mask").cast("long").alias("attended"), A.count("x.response_mask").cast("long").alias("generated"), digest(F.col("x.position_ids")).alias("places"))


@query("p12_generation_batch", "SELECT vec_id AS row_id, label, CASE WHEN vec_id % 17 = 0 THEN -vec_id - 1 ELSE vec_id // 4 END AS uid FROM embeddings")
def generation_batch(spark, sf):
    made, stays = S.generation_batch(I.tokens(spark, sf).select("row_id", "uid", "label", "rewards"), ["rewards"], "row_id")
    if stays.columns != ["row_id", "uid", "rewards"]:
        raise ValueError(f"other columns stay: {stays.columns}")
    return made


@query("p13_with_index", "SELECT doc_id, CASE WHEN lang = 'fr' OR n_chars % 3 = 0 THEN 0 ELSE doc_id END AS row_idx FROM documents")
def with_index(spark, sf):
    info = F.when(F.col("lang") == "fr", None).otherwise(F.struct(F.when(F.col("n_chars") % 3 != 0, F.col("doc_id")).alias("index")))
    return S.with_index(I.table(spark, sf, "documents").withColumn("extra_info", info)).select("doc_id", "row_idx")


@query("p19_append_values", "SELECT 'm/' || user_id AS name, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id")
def append_values(spark, sf):
    e = I.table(spark, sf, "events").select(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("m/"), "user_id")).otherwise(F.col("user_id").cast("string")).alias("name"), "ts", F.col("event_id").cast("string").alias("id"), "event_id")
    return S.append_values(e, "name", "id", ["ts", "event_id"], "m/").select("name", F.array_join("values", ",").alias("ids"))


@query("p20_differences", "WITH d AS (SELECT count(*) FILTER (lang = 'fr') AS f FROM documents) SELECT 'n_chars' AS \"column\", f AS \"rows\" FROM d UNION ALL SELECT 'lang', 0 FROM d UNION ALL SELECT 'source', 0 FROM d")
def differences(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return S.differences(d, d.withColumn("n_chars", F.when(F.col("lang") == "fr", F.col("n_chars") + 1).otherwise(F.col("n_chars"))), "doc_id")


@query("a31_statistics", f"WITH {I.TOKENS} SELECT round(avg(r), 8) AS mean, max(r) AS max, min(r) AS min, round(stddev_samp(r), 8) AS std, round(sum(r * m) / sum(m), 8) AS masked_mean FROM tok")
def statistics(spark, sf):
    x = I.tokens(spark, sf).select(F.explode(F.arrays_zip("rewards", "mask")).alias("x")).select("x.*")
    return S.statistics(x, "rewards", "mask").select(*[F.round(c, 8).alias(c) if c not in ("max", "min") else F.col(c) for c in ("mean", "max", "min", "std", "masked_mean")])


# line numbers repeat in an order; with the band of their quantity they name criteria apart
@query("j10_split_criteria", "WITH x AS (SELECT l_orderkey, l_quantity >= 25 AS high, l_linenumber || CASE WHEN l_quantity >= 25 THEN 'h' ELSE 'l' END AS id FROM lineitem) SELECT l_orderkey, string_agg(id, ',' ORDER BY id DESC) FILTER (high) AS saturated, string_agg(id, ',' ORDER BY id) FILTER (NOT high) AS retained FROM x GROUP BY l_orderkey")
def split_criteria(spark, sf):
    li = I.table(spark, sf, "lineitem").select("l_orderkey", F.struct(F.concat("l_linenumber", F.when(F.col("l_quantity") >= 25, "h").otherwise("l")).alias("id"), "l_quantity").alias("c"))
    x = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("c")).alias("c"))
    best = F.reverse(F.transform(F.filter("c", lambda c: c["l_quantity"] >= 25), lambda c: c["id"]))
    x = x.select("l_orderkey", J.split_criteria(F.col("c"), best).alias("x"))
    text = lambda c: F.nullif(F.array_join(F.col(f"x.{c}.id"), ","), F.lit(""))
    return x.select("l_orderkey", text("saturated").alias("saturated"), text("retained").alias("retained"))


@query("v16_score_matrix", "SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 8 WHEN 1 THEN 'wrong shape' WHEN 2 THEN 'wrong criterion' WHEN 3 THEN 'wrong response' WHEN 4 THEN 'blank reason' WHEN 5 THEN 'score out of bounds' WHEN 6 THEN 'wrong shape of a score' WHEN 7 THEN 'wrong number of scores' ELSE CASE WHEN l_quantity > 25 THEN 'score out of bounds' ELSE '' END END AS problem FROM lineitem")
def score_matrix(spark, sf):
    n = (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    pick = lambda k, a, b: F.when(n == k, F.lit(a)).otherwise(F.lit(b))
    score = F.when(n == 5, F.lit("true")).when(n.isin(0, 1), F.col("l_quantity").cast("int").cast("string")).otherwise(F.lit("1"))
    text = F.concat(
        F.lit('{"criteria":[{"id":"'), pick(2, "b", "a"), F.lit('","scores":[{"rollout_id":"R0","score":'), score, F.lit(',"reason":"'), pick(4, " ", "ok"), F.lit('"'), pick(6, ',"more":1', ""),
        F.lit("}"), F.when(n == 7, F.lit("")).otherwise(F.concat(F.lit(',{"rollout_id":"'), pick(3, "R2", "R1"), F.lit('","score":0,"reason":"ok"}'))), F.lit("]}]"), pick(1, ',"note":1', ""), F.lit("}"),
    )
    criteria = F.array(F.struct(F.lit("a").alias("id"), F.lit(25).cast("long").alias("max")))
    return I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(J.score_matrix_problem(criteria, F.parse_json(text), F.lit(2)), F.lit("")).alias("problem"))


@query("v14_canonical_score", "SELECT event_id, CASE WHEN event_id % 3 <> 1 AND event_id % 5 <> 2 AND value <= 100 AND value >= 0 THEN value END AS score FROM events")
def canonical_score(spark, sf):
    n = F.col("event_id")
    text = F.to_json(F.struct(F.when(n % 3 == 1, "r0").otherwise("r1").alias("rubric_version"), "value"))
    text = F.when(n % 5 == 2, F.regexp_replace(text, r'"value":[^}]*', '"value":true')).otherwise(text)
    return I.table(spark, sf, "events").select("event_id", J.canonical_score(F.parse_json(text), "r1", "value").alias("score"))


@query("c19_finite", "SELECT event_type, count(*) FILTER (event_id % 4 = 3) AS finite FROM events GROUP BY event_type")
def finite(spark, sf):
    n = F.col("event_id") % 4
    x = F.when(n == 0, float("nan")).when(n == 1, float("-inf")).when(n == 3, F.col("value"))
    return I.table(spark, sf, "events").groupBy("event_type").agg(F.count_if(J.finite(x)).alias("finite"))
