"""Versioned state that follows steps: barriers, evidence, gates, commits.

State lives in tables: versions (key, version, source_step, rubric) and
evidence (key, step, ...). Observations arrive in any order as files; each
micro-batch is joined with what was pending, complete groups and steps go on,
and the rest waits. Batch twins of the rules take the same tables.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse_schedule(text: str) -> list[int]:
    """Steps "16,31,47": positive, different and rising."""
    steps = [int(x) for x in text.split(",") if x.strip()]
    if any(s <= 0 for s in steps) or steps != sorted(set(steps)):
        raise ValueError(f"not a rising list of positive steps: {text}")
    return steps


def complete_groups(obs: DataFrame, expected: int, group: str = "uid") -> DataFrame:
    """Rows of groups with ``expected`` observations; a group with more is an error."""
    n = F.count("*").over(W.partitionBy(group))
    checked = F.when(n > expected, F.raise_error(F.concat(F.lit("too many observations of "), F.col(group).cast("string"))).cast("long")).otherwise(n)
    return obs.withColumn("_n", checked).filter(F.col("_n") == expected).drop("_n")


def complete_steps(groups: DataFrame, step: str = "global_step", group: str = "uid", count: str = "step_group_count") -> DataFrame:
    """Steps all of whose groups are there: (step, groups); rows that disagree on how many there are fail the job."""
    g = groups.groupBy(step).agg(F.count_distinct(group).alias("groups"), F.min(count).alias("lo"), F.max(count).alias("hi"))
    agreed = F.when(F.col("lo") != F.col("hi"), F.raise_error(F.lit("rows of one step disagree on its groups")).cast("long")).otherwise(F.col("hi"))
    return g.withColumn("_want", agreed).filter(F.col("groups") == F.col("_want")).select(step, "groups")


def active_version(rows: DataFrame, versions: DataFrame, key: str = "key", step: str = "global_step") -> DataFrame:
    """Each different row with the latest version committed before its step; a version counts from the step after its source.

    Rows and versions of a key are put in order of steps, and the latest so far
    is carried along: each is looked at once, however long a key's history is.
    """
    v = versions.filter(F.col(key).isNotNull() & F.col("source_step").isNotNull())
    v = v.select(F.col(key).alias("_k"), F.col("source_step").alias("_t"), F.lit(1).alias("_after"), "version", F.struct("version", "rubric").alias("_v"))
    own = rows.distinct().select(F.col(key).alias("_k"), F.col(step).alias("_t"), F.lit(0).alias("_after"), F.struct(*rows.columns).alias("_row"))
    so_far = W.partitionBy("_k").orderBy("_t", "_after").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = own.unionByName(v, allowMissingColumns=True).withColumn("_v", F.max_by("_v", "version").over(so_far)).filter("_after = 0")
    return met.select("_row.*", F.coalesce(F.col("_v")["version"], F.lit(0)).alias("version"), F.col("_v")["rubric"].alias("rubric"))


def commit(versions: DataFrame, candidates: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Candidates (key, base_version, source_step, rubric) that were made from the present version become the next one. Returns the new table and the stale ones."""
    now = versions.groupBy(key).agg(F.max("version").alias("_now"))
    met = candidates.join(now, key, "left").withColumn("_now", F.coalesce("_now", F.lit(0)))
    fresh = met.filter(F.col("base_version") == F.col("_now"))
    first = W.partitionBy(key).orderBy("source_step", "rubric")
    fresh = fresh.withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    out = versions.unionByName(fresh.select(key, (F.col("_now") + 1).alias("version"), "source_step", "rubric"))
    return out, met.filter(F.col("base_version") != F.col("_now")).drop("_now")


def resume(versions: DataFrame, first_step: int) -> DataFrame:
    """Versions whose source lies before the step at which a run goes on."""
    return versions.filter(F.col("source_step") < first_step)


def history_problems(versions: DataFrame, key: str = "key") -> DataFrame:
    """Keys whose versions don't count up from 1, or whose source steps don't rise."""
    w = W.partitionBy(key).orderBy("version")
    bad = (F.col("version") != F.row_number().over(w)) | (F.col("source_step") <= F.lag("source_step").over(w))
    return versions.withColumn("_bad", F.coalesce(bad, F.lit(False))).filter("_bad").select(key).distinct()


def recent_evidence(evidence: DataFrame, step: int, steps: int = 3) -> DataFrame:
    """Rows of the last steps, if each of them has some; else none."""
    own = evidence.filter((F.col("step") > step - steps) & (F.col("step") <= step))
    there = F.broadcast(own.agg(F.count_distinct("step").alias("_there")))
    return own.crossJoin(there).filter(F.col("_there") == steps).drop("_there")


def one_for_each_query(evidence: DataFrame) -> DataFrame:
    """Of rows with one query hash the one with most valid judgments, the later step first among equals."""
    w = W.partitionBy("query_sha256").orderBy(F.col("group_valid_count").desc(), F.col("step").desc(), "uid")
    return evidence.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def strata(evidence: DataFrame) -> DataFrame:
    """Adds stratum 0, 1, 2 by rising mean: two of a third, rounded down, and the rest."""
    n = F.broadcast(evidence.agg(F.floor(F.count("*") / 3).alias("_third")))
    ranked = evidence.withColumn("_r", F.row_number().over(W.orderBy("group_mean", "query_sha256")) - 1).crossJoin(n)
    return ranked.withColumn("stratum", F.when(F.col("_r") < F.col("_third"), 0).when(F.col("_r") < 2 * F.col("_third"), 1).otherwise(2)).drop("_r", "_third")


def select_evidence(evidence: DataFrame, step: int, seed: str, least: int = 12, most: int = 16, shares: tuple[int, ...] = (5, 6, 5)) -> list:
    """The rows that show a task's range: all if there are few, else some of each stratum by a seeded draw; none if there are too few. At most a few rows come to the driver for each query."""
    rows = one_for_each_query(recent_evidence(evidence, step))
    n = rows.count()
    if n < least:
        return []
    dealt = strata(rows)
    if n <= most:
        return sorted(dealt.collect(), key=lambda r: (r["group_mean"], r["query_sha256"]))
    hashes: dict[int, list[str]] = {}
    for r in dealt.select("stratum", "query_sha256", "group_mean").collect():
        hashes.setdefault(r["stratum"], []).append((r["group_mean"], r["query_sha256"]))
    draw, picked = random.Random(seed), []
    for k, share in enumerate(shares):
        own = sorted(hashes[k])
        draw.shuffle(own)
        picked += [h for _, h in own[:share]]
    return sorted(dealt.filter(F.col("query_sha256").isin(picked)).collect(), key=lambda r: (r["group_mean"], r["query_sha256"]))


def shadow_gate(old: DataFrame, new: DataFrame, least: int, shift: float = 0.35, case: str = "case_id", score: str = "score") -> DataFrame:
    """One row with ``passed`` and what decided: enough cases judged both times, at least two different scores, no large shift of the mean."""
    both = old.filter("ok").select(case, F.col(score).alias("a")).join(new.filter("ok").select(case, F.col(score).alias("b")), case)
    g = both.agg(F.count("*").alias("cases"), F.count_distinct(F.round("b", 6)).alias("different"), F.avg(F.col("b") - F.col("a")).alias("moved"))
    return g.withColumn("passed", F.coalesce((F.col("cases") >= least) & (F.col("different") >= 2) & (F.abs("moved") <= shift), F.lit(False)))


@dataclass
class StepBarrier:
    """Collects observations from a stream and calls ``on_step(step, rows)`` for each step, in order, once all its groups are complete.

    Pending rows are a Parquet table under ``state``; each micro-batch writes it
    under its own number, so that a batch which is run again after a failure
    starts from the same rows. A step at or before the last finished one is an
    error.
    """

    spark: SparkSession
    state: str
    expected: int
    on_step: Callable[[int, DataFrame], None]

    def _read(self, name: str, epoch: int) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.state}/{name}/{epoch}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def batch(self, rows: DataFrame, epoch: int) -> None:
        pending, done = self._read("pending", epoch - 1), self._read("done", epoch - 1)
        last = -1 if done is None else done.first()[0]
        if not rows.filter(F.col("global_step") <= last).isEmpty():
            raise ValueError(f"a step at or before {last} came again")
        known = rows if pending is None else pending.unionByName(rows)
        steps = complete_steps(complete_groups(known, self.expected))
        ready = sorted(r["global_step"] for r in steps.collect())
        first = known.agg(F.min("global_step")).first()[0]
        finished = []
        for s in ready:  # a later step waits for the ones before it
            if s != first:
                break
            self.on_step(s, known.filter(F.col("global_step") == s))
            finished.append(s)
            first = known.filter(~F.col("global_step").isin(finished)).agg(F.min("global_step")).first()[0]
        rest = known.filter(~F.col("global_step").isin(finished)) if finished else known
        rest.write.mode("overwrite").parquet(f"{self.state}/pending/{epoch}")
        self.spark.createDataFrame([(finished[-1] if finished else last,)], "step long").write.mode("overwrite").parquet(f"{self.state}/done/{epoch}")

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums of tumbling or sliding windows, late rows dropped; works on streams and tables. An extension."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w")["start"].alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w")["start"].alias("start"), "n")
