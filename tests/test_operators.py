"""Operators that SQL can't express, and the files they read and write."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import evidence, judgment
from tessera.operators import balance, estimators, evaluation, losses, offpolicy, release, rows
from tessera.plans import catalog
from tessera.sources import files
from tessera.streaming import evolution


def test_masked_judgments_golden(spark):
    data = [(k, u, v, [1.0, 1.0, 1.0 + k], [1, 1, 1]) for k, (u, v) in enumerate(zip("aaabbc", (1, 0, 1, 1, 0, 1)))]
    df = spark.createDataFrame(data, "row_id long, uid string, valid int, rewards array<double>, mask array<int>")
    out = estimators.judged_grpo(df).orderBy("row_id").collect()
    assert [sum(r.usable_mask) for r in out] == [3, 0, 3, 0, 0, 0]


def test_unknown_names_are_errors(spark):
    df = spark.range(1)
    for f in (lambda: estimators.advantages(df, "none"), lambda: losses.apply_loss(df, "none"), lambda: files.send(df, ["none"]), lambda: offpolicy.rejection_bounds("none", "1")):
        with pytest.raises(ValueError):
            f()
    with pytest.raises(ValueError):
        estimators.estimator("grpo")(lambda df: df)


def test_pass_at_k_needs_two_rows(spark):
    df = spark.createDataFrame([(1, "a", [1.0], [1])], "row_id long, uid string, rewards array<double>, mask array<int>")
    with pytest.raises(PySparkException, match="two rows"):
        estimators.advantages(df, "grpo_passk").collect()


def test_bounds():
    assert offpolicy.importance_bounds(2) == (None, 2.0) and offpolicy.importance_bounds("0.5_2") == (0.5, 2.0)
    assert offpolicy.rejection_bounds("token_k1,seq_mean_k3", ["2", "0.1"]) == [("token_k1", 0.5, 2.0), ("seq_mean_k3", None, 0.1)]
    for bad in (("token_k2", "0.1_0.2"), ("token_k1", "2_1"), ("token_k1,token_k2", ["1", "2", "3"])):
        with pytest.raises(ValueError):
            offpolicy.rejection_bounds(*bad)


def test_adaptive_coefficient():
    c = estimators.AdaptiveKL(0.1, 6.0, 10000)
    assert c.update(12.0, 100) == pytest.approx(0.1 * (1 + 0.2 * 0.01))
    assert estimators.FixedKL(0.3).update(9, 9) == 0.3


def test_clip_cov_takes_the_loss_of_a_few(spark):
    from tessera.plans import inputs

    df = inputs.tokens(spark, "/root/testdata/sf0.001").withColumn("advantages", F.col("values"))
    out = losses.clip_cov(df, share=0.01, cov_low=-5.0, cov_high=5.0)
    plain = losses.vanilla(df, 0.2, 0.2, 1e9).select("row_id", F.col("loss").alias("before"))
    changed = out.join(plain, "row_id").select(F.aggregate(F.zip_with("loss", "before", lambda a, b: ((a == 0) & (b != 0)).cast("int")), F.lit(0), lambda s, x: s + x).alias("n")).agg(F.sum("n")).first()[0]
    tokens = df.agg(F.sum(A.count("mask"))).first()[0]
    assert 0 < changed <= int(tokens * 0.01)


@pytest.mark.parametrize("method", ["differencing", "greedy"])
def test_balanced_parts(method):
    draw = random.Random(1)
    loads = [draw.randint(1, 1000) for _ in range(40)]
    for equal in (False, True):
        parts = balance.METHODS[method](loads, 4, equal)
        assert sorted(i for p in parts for i in p) == list(range(40))
        sums = [sum(loads[i] for i in p) for p in parts]
        # items in their order can end with a large one
        assert max(sums) - min(sums) <= (0.12 * sum(loads) / 4 if method == "differencing" else 2 * max(loads))
        assert not equal or {len(p) for p in parts} == {10}
    with pytest.raises(ValueError):
        balance.largest_differencing([1, 2, 3], 2, True)
    assert balance.largest_differencing([8, 7, 6, 5, 4], 2) == [[1, 3, 4], [0, 2]]


def test_differencing_with_ties():
    """Against a second version that looks at all states and parts each time."""
    draw = random.Random(4)
    for _ in range(150):
        k, equal = draw.choice([2, 3, 4]), draw.random() < 0.4
        loads = [draw.randint(1, 4) for _ in range(draw.choice([2, 3]) * k)]
        items = sorted(range(len(loads)), key=lambda i: (loads[i], i))
        weigh = lambda p: (sum(loads[i] for i in p), len(p), p)
        groups = [items[a : a + k] for a in range(0, len(items), k)] if equal else [[i] for i in items]
        states = [[[i] for i in g] + [[]] * (k - len(g)) for g in groups]
        while len(states) > 1:
            picked = []
            for _ in range(2):
                states = [sorted(s, key=weigh) for s in states]
                best = max(states, key=lambda s: (weigh(s[-1])[0] - weigh(s[0])[0], weigh(s[-1])))
                states.remove(best)
                picked.append(best)
            states.append([heavy + light for heavy, light in zip(picked[0][::-1], picked[1])])
        want = [sorted(p) for p in sorted(states[0], key=weigh, reverse=True)]
        assert balance.largest_differencing(loads, k, equal) == want


def test_greedy_takes_items_in_order():
    assert balance.greedy([5, 1, 1, 9, 2], 2) == [[0, 4], [1, 2, 3]]
    assert balance.greedy([5, 1, 1, 9], 2, True) == [[0, 3], [1, 2]]


def test_micro_batches():
    assert balance.micro_batch_count(100, 30, 10) == 4 and balance.micro_batch_count(100, 30, 10, 3) == 6 and balance.micro_batch_count(100, 1, 10) == 10


def test_validation_query_takes_all_events(spark, tmp_path):
    """Groups of 1 to 7 samples, each metric against 1000 draws repeated in NumPy."""
    from tessera.plans import catalog

    rows, at = [], 0
    for u, n in enumerate([1, 2, 5, 5, 7, 6]):
        for _ in range(n):
            rows.append((at, u, "ab"[u % 2], (at * 37 % 23) / 7, '{"k": %d}' % (at * 5 % 3)))
            at += 1
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for u, source in enumerate("ababab"):
        mine = [(r[3], r[4]) for r in rows if r[1] == u]
        n, x = len(mine), np.array([v for v, _ in mine])
        put = lambda name, v, source=source: want.setdefault((source, name), []).append(v)
        put(f"mean@{n}", x.mean())
        for k in [] if n == 1 else [k for k in (2, 4) if k < n] + [n]:
            draws = np.random.RandomState(42).choice(n, size=(1000, k), replace=True)
            votes = []
            for d in draws:
                keys = [mine[i][1] for i in d]
                votes.append(x[d[keys.index(max(keys, key=keys.count))]])
            for kind, y in (("best", x[draws].max(1)), ("worst", x[draws].min(1)), ("maj", votes)):
                put(f"{kind}@{k}/mean", np.mean(y))
                put(f"{kind}@{k}/std", np.std(y))
        if n > 1:
            put(f"std@{n}", x.std())
    got = {(r.source, r.metric): r.value for r in catalog.queries()["a16_validation_metrics"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({k: np.mean(v) for k, v in want.items()})


def test_bootstrap_repeats_numpy_draws(spark):
    values = [0.1, 0.9, 0.4, 0.7]
    df = spark.createDataFrame([("s", "u", k, v, "ab"[k % 2]) for k, v in enumerate(values)], "source string, uid string, pos int, value double, vote string")
    draws = evaluation.bootstrap_index(4, 2, 50)
    best = [max(values[i] for i in d) for d in draws]
    got = evaluation.bootstrap(df, ["source", "uid"], "value", "pos", 4, 2, "best", 50).first()
    assert got["mean"] == pytest.approx(np.mean(best)) and got["std"] == pytest.approx(np.std(best))
    votes = []
    for d in draws:
        keys = ["ab"[i % 2] for i in d]
        votes.append(values[d[keys.index(max(keys, key=keys.count))]])
    assert evaluation.bootstrap(df, ["source", "uid"], "value", "pos", 4, 2, "maj", 50, vote="vote").first()["mean"] == pytest.approx(np.mean(votes))
    names = {r.metric for r in evaluation.validation_metrics(df, vote="vote", draws=20).collect()}
    assert {"mean@4", "std@4", "best@2/mean", "worst@4/std", "maj@4/mean"} <= names
    assert {r.metric for r in evaluation.gain(evaluation.validation_metrics(df, draws=20)).collect()} == {"gain@2", "gain@4"}


def test_validation_draws_in_tasks(spark, monkeypatch):
    """The driver draws nothing for groups, however many sizes there are; missing values and votes, NaN and infinity as in the rules before."""
    monkeypatch.setattr(evaluation, "bootstrap_index", None)
    x = {"a": [(0.5, "x"), (None, "y"), (2.0, None), (-1.0, "x"), (float("inf"), "z")], "b": [(None, None), (3.0, "p"), (1.0, "p"), (float("nan"), "q")], "c": [(k * 37 % 101 / 8, str(k % 50)) for k in range(300)], "d": [(1.0, "x"), (4.0, "x"), (2.0, "y")]}
    df = spark.createDataFrame([(s, 0, k, *r) for s, rows in x.items() for k, r in enumerate(rows)], "source string, uid int, pos int, value double, vote string")
    got = {(r.source, r.metric): r.value for r in evaluation.validation_metrics(df, vote="vote", draws=64).collect()}
    up, want = lambda v: (math.isnan(v), v), {}
    for s, rows in x.items():
        for k in evaluation.subset_sizes(len(rows)):
            draws = [[rows[i] for i in d] for d in np.random.RandomState(42).choice(len(rows), size=(64, k))]
            times = lambda d, v: 0 if v is None else sum(q == v for _, q in d)
            taken = {"best": [max((v for v, _ in d if v is not None), key=up, default=None) for d in draws], "worst": [min((v for v, _ in d if v is not None), key=up, default=None) for d in draws], "maj": [max(d, key=lambda r, d=d: times(d, r[1]))[0] for d in draws]}
            for kind, values in taken.items():
                if None not in values:
                    want[s, f"{kind}@{k}/mean"], want[s, f"{kind}@{k}/std"] = np.mean(values), np.std(values)
    assert {k: v for k, v in got.items() if "/" in k[1]} == pytest.approx(want, nan_ok=True) and {k[1] for k in want if k[0] == "c"} >= {"maj@256/mean", "maj@300/std"}


def test_column_union_rejects_differences(spark):
    a = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None)], "pos long, x double")
    assert rows.column_union(a, a.withColumn("y", F.lit(1))).count() == 3
    with pytest.raises(PySparkException, match="differ"):
        rows.column_union(a, a.withColumn("x", F.coalesce("x", F.lit(0.0)))).collect()


def test_row_numbers_and_cuts(spark):
    df = rows.numbered(spark.range(100).select((F.col("id") * 37 % 101).alias("v")), "v")
    assert [r.v for r in df.orderBy("pos").collect()] == sorted(k * 37 % 101 for k in range(100))
    with pytest.raises(ValueError):
        rows.chunk_number(10, 3)
    with pytest.raises(KeyError):
        rows.pop(df, ["none"])
    with pytest.raises(ValueError):
        rows.concat([df.withColumn("m", F.lit(1)), df.withColumn("m", F.lit(2))], meta=["m"])
    assert rows.pad_to_multiple(df.filter("pos < 3"), 8).count() == 8
    assert rows.repeat_each(spark.createDataFrame([(0, 2), (1, 0)], "pos long, c int"), "c").count() == 2


def _documents(spark, path, n):
    spark.range(n).selectExpr("id AS doc_id", "'s' AS source", "'l' AS lang", "id AS n_chars").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return lambda name: (sorted(map(tuple, catalog.queries()[name](spark, str(path)).collect())), sorted(con.execute(catalog.oracle_sql()[name]).fetchall()))


@pytest.mark.parametrize("n", [7, 8, 10])
def test_chunk_query_takes_any_number_of_rows(spark, tmp_path, n):
    mine, theirs = _documents(spark, tmp_path, n)("r6_chunk")
    assert mine == theirs and len(mine) == n


@pytest.mark.parametrize("n", [7, 100, 132])
def test_mini_batch_query_takes_any_number_of_rows(spark, tmp_path, n):
    mine, theirs = _documents(spark, tmp_path, n)("r9_mini_batches")
    assert mine == theirs and sum(r[2] for r in mine) == 2 * n
    with pytest.raises(ValueError):
        rows.mini_batches(spark.range(7).withColumnRenamed("id", "pos"), 7, 2)


def test_tokens_fit(spark):
    x = spark.createDataFrame([([1, 2, 3, 4],), ([1],)], "t array<int>")
    assert [list(r[0]) for r in x.select(A.fit("t", 3, 0, "left", "left")).collect()] == [[2, 3, 4], [0, 0, 1]]
    with pytest.raises(PySparkException, match="longer"):
        x.select(A.fit("t", 3, 0)).collect()


RUBRIC = '{"criteria":[{"id":"c1","max_points":10},{"id":"c2","max_points":5}],"reward_aggregation":{"type":"normalized_sum_with_caps","caps":[{"criterion_id":"c1","score_lte":7,"max_normalized_score":0.6}]}}'


@pytest.mark.parametrize("maximum,normalized", [("10", False), ("10.0", False), ('"10"', False), ("true", True), ("10.5", True), ("null", True), ('"ten"', True), ("100", True)])
def test_judgment_maxima(spark, maximum, normalized):
    text = f'{{"criteria_scores":[{{"id":"c1","score":7,"max":{maximum},"reason":"r"}},{{"id":"c2","score":4,"max":5,"reason":"r"}}],"total_score":11,"total_max":15}}'
    r = spark.createDataFrame([(RUBRIC, text)], "r string, j string").select(judgment.reward(F.parse_json("r"), judgment.extract_json(F.col("j"))).alias("x")).first().x
    assert (r.valid, round(r.raw, 6), r.score, list(r.binding), r.normalized) == (1, round(11 / 15, 6), 0.6, ["c1"], normalized)


def _plan(spark, name):
    return catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_rubric_is_typed_once(spark):
    assert not any("max_points" in line and "l_orderkey" in line for line in _plan(spark, "v7_reward").splitlines())
    bad = RUBRIC.replace('"max_points":5', '"max_points":"5"')
    text = '{"criteria_scores":[{"id":"c1","score":7,"max":"10.0","reason":"r"},{"id":"c2","score":4,"max":5,"reason":"　r"}],"total_score":11,"total_max":15}'
    texts = [text, f"say {text} so", f"```json\n{text}```", text.replace('"　r"', '"　 "'), text.replace("7,", "7.0,"), "nothing", "{", "", None]
    df = spark.createDataFrame([(r, j) for r in (RUBRIC, bad, "none") for j in texts], "r string, j string")
    r, j = F.try_parse_json("r"), judgment.extract_json(F.col("j"))
    got = df.select(judgment.reward(r, j).alias("x"), judgment.reward_by(judgment.typed_rubric(r), j).alias("y")).collect()
    assert all(g.x == g.y for g in got)
    assert [g.x.problem for g in got] == [None] * 3 + ["blank reason", "score is not an integer"] + ["not JSON"] * 4 + ["bad rubric"] * 18


def test_criterion_json_judges_each_text_once(spark):
    plan = _plan(spark, "v8_criterion_json")
    assert plan.count("parseJson") == 2 and not any("max_points" in line and "l_orderkey" in line for line in plan.splitlines())


def test_score_matrix_looks_at_a_cell_once(spark):
    """The first rule that some row or cell breaks is named, wherever it stands; each cell is taken apart once."""
    assert _plan(spark, "v16_score_matrix").count("map<string,variant>") <= 3 and "array_sort" not in _plan(spark, "v16_score_matrix")
    cell = lambda k, score=1, reason='"r"': f'{{"rollout_id":"R{k}","score":{score},"reason":{reason}}}'
    row = lambda name, *cells: f'{{"id":"{name}","scores":[{",".join(cells)}]}}'
    good = row("b", cell(0), cell(1))
    cases = [
        ([row("a", cell(0), cell(1)), good], None), ([row("a", cell(0, 1, '" "'), cell(1, 9)), good], "score out of bounds"), ([row("a", cell(0, "1.0"), cell(1)), row("b", cell(1), cell(0))], "wrong response"),
        ([row("a", cell(1), cell(1)), row("b", cell(0), "7")], "wrong shape of a score"), ([row("a", "7", "7"), row("b")], "wrong number of scores"), ([row("a"), row("c", cell(0), cell(1))], "wrong criterion"),
        ([row("c"), '{"id":"b"}'], "wrong shape of a criterion"), ([good], "wrong number of criteria"), ([row("a", cell(0), cell(1, 1, "null")), good], "blank reason"),
    ]
    criteria = F.array(*[F.struct(F.lit(c).alias("id"), F.lit(2).cast("long").alias("max")) for c in "ab"])
    df = spark.createDataFrame([(n, f'{{"criteria":[{",".join(c)}]}}') for n, (c, _) in enumerate(cases)], "n int, t string")
    got = df.select("n", judgment.score_matrix_problem(criteria, F.parse_json("t"), F.lit(2)).alias("x")).orderBy("n").collect()
    assert [r.x for r in got] == [w for _, w in cases]


def test_evidence():
    assert evidence.quoted("Ｆｕｌｌ width … END", "a FULL-width thing with an end.") and not evidence.quoted("end … full", "full end") and not evidence.quoted("…", "x")
    good = '{"a":[{"id":"a.1","status":"pass","evidence":["x"]}]}'
    assert evidence.audit(good, ["a"], 1) == (True, "", 100.0) and not evidence.audit('{"b":[]}', ["a"], 1)[0]
    assert evidence.canonical('{"b": 1, "a": "é"}') == '{"a":"é","b":1}'


def test_files(spark, tmp_path):
    df = spark.range(5).withColumn("s", F.struct(F.lit("x").alias("k")))
    files.publish(df, f"{tmp_path}/p.parquet", df.schema)
    with pytest.raises(ValueError):
        files.publish(df, f"{tmp_path}/q.parquet", df.drop("s").schema)
    df.write.json(f"{tmp_path}/j.jsonl")
    assert files.read_files(spark, [f"{tmp_path}/p.parquet", f"{tmp_path}/j.jsonl"]).count() == 10
    with pytest.raises(ValueError):
        files.read_files(spark, ["x.csv"])
    with pytest.raises(ValueError):
        files.read_checked(spark, f"{tmp_path}/p.parquet", 4)
    m = files.manifest(spark, f"{tmp_path}/p.parquet").collect()
    one = next((tmp_path / "p.parquet").glob("*.parquet"))
    assert {r.sha256 for r in m if r.file == one.name} == {hashlib.sha256(one.read_bytes()).hexdigest()}
    files.dump_steps(df.withColumn("step", F.lit(1)), f"{tmp_path}/dump")
    files.dump_steps(df.withColumn("step", F.lit(2)), f"{tmp_path}/dump")
    assert spark.read.json(f"{tmp_path}/dump").groupBy("step").count().count() == 2
    calls = []
    for _ in range(2):
        assert files.cached_step(spark, f"{tmp_path}/cache", 3, lambda: calls.append(1) or df).count() == 5
    assert calls == [1]
    (tmp_path / "a.md").write_text("## One\nbody\n\n## Two\nmore\n")
    assert [(r.title, r.body.strip()) for r in files.markdown_sections(spark, f"{tmp_path}/a.md").orderBy("n").collect()] == [("One", "body"), ("Two", "more")]
    assert files.flattened(df).columns == ["id", "s.k"]


def test_private_marks_reach_nested_strings(spark):
    df = spark.createDataFrame([(1, [{"k": "write to a@b.org"}]), (2, [{"k": "nothing"}]), (3, None)], "id int, x array<map<string,string>>")
    assert [r.has_address for r in release.private_marks(df).orderBy("id").collect()] == [True, False, False]


def test_schedule():
    assert evolution.parse_schedule("16,31,47") == [16, 31, 47]
    for bad in ("3,2", "0,1", "1,1"):
        with pytest.raises(ValueError):
            evolution.parse_schedule(bad)


def test_evidence_selection(spark):
    data = [(s, f"u{s}_{i}", f"h{s}_{i:02d}", i / 31, 8) for s in (20, 21, 22) for i in range(32)]
    df = spark.createDataFrame(data, "step int, uid string, query_sha256 string, group_mean double, group_valid_count int")
    got = evolution.select_evidence(df, 22, "seed")
    means = [r["group_mean"] for r in got]
    assert len(got) == len({r["query_sha256"] for r in got}) == 16 and min(means) < 0.34 and max(means) > 0.66
    assert got == evolution.select_evidence(df, 22, "seed")
    assert evolution.select_evidence(df.filter("step != 21"), 22, "seed") == []


def test_step_barrier_in_a_stream(spark, tmp_path):
    schema = "uid string, global_step int, step_group_count int, response string"
    first = [("a", 1, 2, "x"), ("a", 1, 2, "y"), ("b", 1, 2, "x"), ("c", 2, 1, "x"), ("c", 2, 1, "y")]
    seen = []
    barrier = evolution.StepBarrier(spark, f"{tmp_path}/state", 2, lambda step, df: seen.append((step, df.count())))
    source = f"{tmp_path}/in"
    for part in (first, [("b", 1, 2, "y")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        barrier.start(stream, f"{tmp_path}/checkpoint").awaitTermination()
    assert seen == [(1, 4), (2, 2)]
    with pytest.raises(ValueError):
        barrier.batch(spark.createDataFrame(first, schema), 2)


def test_commit_and_resume(spark):
    versions = spark.createDataFrame([("k", 1, 10, "r1")], "key string, version int, source_step int, rubric string")
    new, stale = evolution.commit(versions, spark.createDataFrame([("k", 1, 22, "r2"), ("k", 0, 22, "old")], "key string, base_version int, source_step int, rubric string"))
    assert stale.count() == 1
    at = spark.createDataFrame([("k", 22), ("k", 23), ("z", 5)], "key string, global_step int")
    assert {(r["key"], r.global_step): (r.version, r.rubric) for r in evolution.active_version(at, new).collect()} == {("k", 22): (1, "r1"), ("k", 23): (2, "r2"), ("z", 5): (0, None)}
    assert evolution.resume(new, 21).agg(F.max("version")).first()[0] == 1
    assert evolution.history_problems(new).count() == 0
    with pytest.raises(PySparkException, match="too many"):
        evolution.complete_groups(spark.createDataFrame([("a",)] * 3, "uid string"), 2).collect()


def test_numbers_by_many_parts(spark):
    """A row is held against the logarithm of the edges; missing values come first and no row is lost."""
    values = [None, *(float(k * 37 % 101) for k in range(300)), float("nan")]
    df = rows.numbered(spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, v double"), "v", "id", parts=64)
    want = sorted(range(len(values)), key=lambda k: (values[k] is not None, math.isnan(values[k] or 0), values[k] if k < 301 else 0, k))
    assert [r.id for r in df.orderBy("pos").collect()] == want and [r.pos for r in df.orderBy("pos").collect()] == list(range(len(values)))


def test_active_version_looks_at_each_row_once(spark):
    """Odd keys and steps as a join would take them, without making a row for each pair of one key."""
    draw = random.Random(3)
    versions = [(k, v, draw.choice([None, *range(12)]), f"r{k}{v}") for k in ("a", "b", None) for v in range(1, 20)] + [("c", None, 1, "none"), ("c", 4, 5, None)]
    at = [(k, s, n) for n, (k, s) in enumerate([(k, s) for k in ("a", "b", "c", "d", None) for s in (None, *range(0, 14))])] * 2
    want = set()
    for k, s, n in at:
        before = [(v, r) for q, v, t, r in versions if None not in (k, s, t, v) and q == k and t < s]
        want.add((k, s, n, *max(before, default=(0, None), key=lambda x: x[0])))
    out = evolution.active_version(spark.createDataFrame(at, "key string, global_step int, n int"), spark.createDataFrame(versions, "key string, version int, source_step long, rubric string"))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want and out.columns == ["key", "global_step", "n", "version", "rubric"]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_sequences_at_their_edges(spark):
    from tessera.functions import judgment as J
    from tessera.operators import sequences as S

    ints = lambda *x: F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<int>")
    one = spark.range(1)
    got = one.select(S.assemble(ints(1, 2), ints(3, 4, 5, 6), ints(1, 0, 1, 1), 3, 3).alias("x")).first().x
    assert (got.input_ids, got.attention_mask, got.response_mask, got.position_ids) == ([0, 1, 2, 3, 4, 5], [0, 1, 1, 1, 1, 1], [1, 0, 1], [0, 0, 1, 2, 3, 4])
    got = one.select(S.assemble(ints(), ints(), ints(), 2, 2).alias("x")).first().x
    assert (got.input_ids, got.attention_mask, got.position_ids) == ([0] * 4, [0] * 4, [0] * 4)
    got = one.select(S.preference_pair(ints(1), ints(2, 3), ints(), None, 2).alias("x")).first().x
    assert (got.input_ids, got.attention_mask) == ([[1, 2], [1, 0]], [[1, 1], [1, 0]])
    assert one.select(S.without_left_pad(ints(0, 0), ints(0, 0)).alias("x")).first().x == []
    with pytest.raises(PySparkException):
        one.select(S.response_values(ints(1, 2), F.lit(0), F.lit(1), 2)).collect()
    a = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None), (3, 4.0)], "pos long, v double")
    b = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None), (4, 4.0)], "pos long, v double")
    assert [tuple(r) for r in S.differences(a, b).collect()] == [("v", 2)]
    with pytest.raises(ValueError):
        S.differences(a, b.withColumn("v", F.col("v").cast("float")))
    assert S.with_index(a).select("index").distinct().collect()[0][0] == 0
    assert spark.createDataFrame([], "pos long, n int").transform(lambda d: S.sequence_offsets(d, "n")).count() == 0
    text = '{"criteria":[{"id":"a","scores":[]}]}'
    criteria = F.array(F.struct(F.lit("a").alias("id"), F.lit(2).cast("long").alias("max")))
    problem = lambda t, n: one.select(J.score_matrix_problem(criteria, F.try_parse_json(F.lit(t)), F.lit(n)).alias("x")).first().x
    assert [problem(text, 0), problem(text, 1), problem("[]", 0), problem("none", 0), problem('{"criteria":[]}', 0)] == [None, "wrong number of scores", "wrong shape", "wrong shape", "wrong number of criteria"]
    assert [one.select(J.finite(F.lit(v).cast("double")).alias("x")).first().x for v in (1, None, float("inf"), float("nan"))] == [True, False, False, False]
