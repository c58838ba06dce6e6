"""Rubrics and judgments held as JSON: parsing, validation, scoring.

Everything is an expression over VARIANT values, so malformed input is a
verdict in a column and never a failed job. Types are JSON's own: 7 is an
integer, 7.0 and true are not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\f\r\u00a0\u3000"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(BLANK))


def _parsed(text: Column) -> Column:
    """``try_parse_json`` of text with nothing in front; a parse that fails takes long, so where no value starts like that it isn't tried."""
    return F.when(text.rlike(r'^([{\["0-9-]|true|false|null)'), F.try_parse_json(text))


def extract_json(text: Column) -> Column:
    """The JSON value in a model's answer: a fenced block or the whole text, else what lies between its first and last brace; null if neither parses."""

    def parsed(plain):
        fenced = F.when(F.contains(plain, F.lit("```")), F.nullif(F.regexp_extract(plain, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit("")))
        braces = F.when(F.contains(plain, F.lit("{")), F.regexp_extract(plain, r"(?s)(\{.*\})", 1))
        return F.coalesce(let(F.coalesce(fenced, plain), _parsed), let(braces, _parsed))

    return let(strip(text), parsed)


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_integer(value: Column) -> Column:
    return F.coalesce(kind(value) == "BIGINT", F.lit(False))


def is_number(value: Column) -> Column:
    return F.coalesce(kind(value).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.lit(False))


def is_text(value: Column) -> Column:
    return F.coalesce(kind(value) == "STRING", F.lit(False))


def at(value: Column, path: str, type_: str) -> Column:
    return F.try_variant_get(value, path, type_)


CRITERION = "array<struct<id:variant,max_points:variant,check:variant,scoring_rule:variant>>"
SCORE = "array<struct<id:variant,score:variant,max:variant,reason:variant>>"
CAP = "array<struct<criterion_id:variant,score_lte:variant,max_normalized_score:variant>>"


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _int(v: Column) -> Column:
    return F.try_variant_get(v, "$", "bigint")


def criteria(rubric: Column) -> Column:
    return at(rubric, "$.criteria", CRITERION)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def criterion_table(rubric: Column) -> Column:
    """Typed criteria (id, max), null where the type is another; of use where rubric_problem is null."""
    return F.transform(criteria(rubric), lambda c: F.struct(F.when(is_text(c["id"]), _text(c["id"])).alias("id"), F.when(is_integer(c["max_points"]), _int(c["max_points"])).alias("max")))


def _said(v: Column) -> Column:
    """The number that a value states: 10, 10.0, "10" and "10.0" all say ten; true doesn't."""
    return F.when(kind(v) != "BOOLEAN", F.try_variant_get(v, "$", "double"))


def _scores(judgment: Column) -> Column:
    def typed(s):
        return F.struct(
            F.when(is_text(s["id"]), _text(s["id"])).alias("id"),
            F.when(is_integer(s["score"]), _int(s["score"])).alias("score"),
            _said(s["max"]).alias("max"),
            F.coalesce(is_text(s["reason"]) & (F.length(strip(_text(s["reason"]))) > 0), F.lit(False)).alias("reasoned"),
        )

    return F.transform(at(judgment, "$.criteria_scores", SCORE), typed)


def _caps(rubric: Column) -> Column:
    def typed(c):
        limit = F.when(is_number(c["max_normalized_score"]), F.try_variant_get(c["max_normalized_score"], "$", "double"))
        return F.struct(_text(c["criterion_id"]).alias("id"), F.when(is_integer(c["score_lte"]), _int(c["score_lte"])).alias("lte"), limit.alias("limit"))

    return F.transform(at(rubric, "$.reward_aggregation.caps", CAP), typed)


def _rubric(rubric: Column) -> Column:
    """All that is asked of a rubric, typed, what is wrong with it and with its aggregation, and the sum of its maxima."""
    there = at(rubric, "$.reward_aggregation", "variant").isNotNull()
    kind_ = F.coalesce(at(rubric, "$.reward_aggregation.type", "string"), F.lit(""))
    typed = F.struct(rubric.isNotNull().alias("json"), criterion_table(rubric).alias("criteria"), there.alias("there"), kind_.alias("kind"), _caps(rubric).alias("caps"))
    return let(typed, lambda r: F.struct(r["criteria"].alias("criteria"), r["caps"].alias("caps"), _rubric_problem(r).alias("problem"), _aggregation_problem(r).alias("aggregation"), _sum(r["criteria"], "max").alias("best")))


def _judgment(judgment: Column) -> Column:
    """All that is asked of a judgment, typed."""
    return F.struct(judgment.isNotNull().alias("json"), _scores(judgment).alias("scores"), let(at(judgment, "$.total_score", "variant"), _said).alias("total"), let(at(judgment, "$.total_max", "variant"), _said).alias("best"))


def _rubric_problem(r: Column) -> Column:
    c = r["criteria"]
    ids = F.transform(c, lambda x: x["id"])
    return (
        F.when(~r["json"], "not JSON")
        .when(c.isNull() | (F.size(c) == 0), "no criteria")
        .when(F.exists(c, lambda x: F.coalesce(F.length(strip(x["id"])) == 0, F.lit(True))), "blank id")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "repeated id")
        .when(F.exists(c, lambda x: x["max"].isNull()), "maximum is not an integer")
        .when(F.exists(c, lambda x: x["max"] <= 0), "maximum is not positive")
    )


def _aggregation_problem(r: Column) -> Column:
    caps = r["caps"]

    def best(c):
        return F.get(F.filter(r["criteria"], lambda x: x["id"] == c["id"]), F.lit(0))["max"]

    return (
        F.when(~r["there"], F.lit(None).cast("string"))
        .when(r["kind"] != "normalized_sum_with_caps", "unknown aggregation")
        .when(caps.isNull(), "no caps")
        .when(F.exists(caps, lambda c: ~F.coalesce(F.exists(r["criteria"], lambda x: x["id"] == c["id"]), F.lit(False))), "cap on an unknown criterion")
        .when(F.exists(caps, lambda c: F.coalesce((c["lte"] < 0) | (c["lte"] > best(c)), F.lit(True))), "cap's score out of bounds")
        .when(F.exists(caps, lambda c: F.coalesce((c["limit"] < 0) | (c["limit"] > 1), F.lit(True))), "cap's limit out of bounds")
    )


def _judgment_problem(r: Column, j: Column) -> Column:
    c, s = r["criteria"], j["scores"]
    pairs = F.zip_with(c, s, lambda a, b: F.when(F.coalesce(b["id"] != a["id"], F.lit(True)), 1).when(b["score"].isNull(), 2).when((b["score"] < 0) | (b["score"] > a["max"]), 3).when(~b["reasoned"], 4))
    first = let(F.array_min(pairs), lambda k: F.when(k == 1, "wrong id").when(k == 2, "score is not an integer").when(k == 3, "score out of bounds").when(k == 4, "blank reason"))
    return F.when(r["problem"].isNotNull(), "bad rubric").when(~j["json"], "not JSON").when(s.isNull() | (F.size(s) != F.size(c)), "wrong number of scores").otherwise(first)


def _sum(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda t, x: t + x[field])


def _raw_score(r: Column, j: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _sum(j["scores"], "score") / r["best"]))


def _was_normalized(r: Column, j: Column) -> Column:
    def other(said, want):
        return ~F.coalesce(said == want.cast("double"), F.lit(False))

    maxima = F.exists(F.zip_with(r["criteria"], j["scores"], lambda a, b: other(b["max"], a["max"])), lambda x: x)
    return maxima | other(j["total"], _sum(j["scores"], "score")) | other(j["best"], r["best"])


def _apply_caps(r: Column, j: Column, raw: Column) -> Column:
    zero = F.struct(raw.cast("double").alias("score"), F.array().cast("array<string>").alias("binding"))

    def step(state, cap):
        low = F.exists(j["scores"], lambda s: (s["id"] == cap["id"]) & (s["score"] <= cap["lte"]))
        binds = F.coalesce(low, F.lit(False)) & (cap["limit"] < state["score"])
        return F.struct(F.when(binds, cap["limit"]).otherwise(state["score"]).alias("score"), F.when(binds, F.array_append(state["binding"], cap["id"])).otherwise(state["binding"]).alias("binding"))

    none = F.array().cast("array<struct<id:string,lte:bigint,limit:double>>")
    return F.aggregate(F.coalesce(r["caps"], none), zero, step)


def _both(rubric: Column, judgment: Column, body) -> Column:
    return let(rubric, lambda r: _beside(_rubric(r), judgment, body))


def _beside(typed: Column, judgment: Column, body) -> Column:
    return let(F.struct(typed.alias("r"), let(judgment, _judgment).alias("j")), lambda x: body(x["r"], x["j"]))


def typed_rubric(rubric: Column) -> Column:
    """A rubric as ``reward_by`` and ``problem_by`` take it; many judgments of one rubric can share it."""
    return let(rubric, _rubric)


def rubric_problem(rubric: Column) -> Column:
    """Null for a sound rubric, else what is wrong first: its criteria must be a list, not empty, with different ids that aren't blank and positive whole maxima."""
    return typed_rubric(rubric)["problem"]


def aggregation_problem(rubric: Column) -> Column:
    """Null where a rubric has no aggregation or a sound one: sums with caps, each on a known criterion, within bounds."""
    return typed_rubric(rubric)["aggregation"]


def judgment_problem(rubric: Column, judgment: Column) -> Column:
    """Null for a judgment that fits its rubric, else what is wrong first: as many scores, the same ids in order, whole scores within bounds, reasons that aren't blank."""
    return _both(rubric, judgment, _judgment_problem)


def problem_by(typed: Column, judgment: Column) -> Column:
    """``judgment_problem`` by a ``typed_rubric``."""
    return _beside(typed, judgment, _judgment_problem)


def score_table(judgment: Column) -> Column:
    """Typed scores (id, score)."""
    return F.transform(at(judgment, "$.criteria_scores", SCORE), lambda s: F.struct(_text(s["id"]).alias("id"), _int(s["score"]).alias("score")))


def was_normalized(rubric: Column, judgment: Column) -> Column:
    """Whether maxima or totals in the judgment differ from the rubric's and the scores', which count."""
    return _both(rubric, judgment, _was_normalized)


def raw_score(rubric: Column, judgment: Column) -> Column:
    """Scores over maxima, between 0 and 1."""
    return _both(rubric, judgment, _raw_score)


def apply_caps(rubric: Column, judgment: Column, raw: Column) -> Column:
    """A struct: score after all caps in order, and ids of those that lowered it."""
    return let(raw, lambda x: _both(rubric, judgment, lambda r, j: _apply_caps(r, j, x)))


def reward(rubric: Column, judgment: Column) -> Column:
    """The record of one judged response: valid, problem, raw and final score, binding caps, whether numbers were put right. What isn't valid scores 0.

    Rubric and judgment are typed once; all rules read the typed values.
    """
    return _both(rubric, judgment, _reward)


def reward_by(typed: Column, judgment: Column) -> Column:
    """``reward`` by a ``typed_rubric``."""
    return _beside(typed, judgment, _reward)


def _reward(r: Column, j: Column) -> Column:
    def scored(r, j, problem):
        ok = problem.isNull()
        empty = F.array().cast("array<string>")
        capped = F.when(ok, let(_raw_score(r, j), lambda raw: F.struct(raw.alias("raw"), _apply_caps(r, j, raw).alias("caps"))))
        return let(capped, lambda c: F.struct(
            ok.cast("int").alias("valid"), problem.alias("problem"), F.coalesce(c["raw"], F.lit(0.0)).alias("raw"), F.coalesce(c["caps"]["score"], F.lit(0.0)).alias("score"),
            F.coalesce(c["caps"]["binding"], empty).alias("binding"), F.coalesce(F.when(ok, _was_normalized(r, j)), F.lit(False)).alias("normalized"),
        ))

    return let(F.coalesce(_judgment_problem(r, j), r["aggregation"]), lambda problem: scored(r, j, problem))


def criterion_json(judgment: Column) -> Column:
    """Ids and scores as JSON text."""
    return F.to_json(score_table(judgment))


def replace_criteria(old: Column, new: Column) -> Column:
    """Arrays of structs with an id: each old element whose id is among the new ones gives way; an unknown new id is an error."""
    ids = F.transform(old, lambda c: c["id"])
    unknown = F.exists(new, lambda c: ~F.array_contains(ids, c["id"]))
    out = F.transform(old, lambda c: F.coalesce(F.get(F.filter(new, lambda n: n["id"] == c["id"]), F.lit(0)), c))
    return F.when(unknown, F.raise_error(F.lit("a replacement has no criterion"))).otherwise(out)


def mixed_scores(old: Column, new: Column, replaced: Column) -> Column:
    """Maps id to score: replaced ids from the new map, others from the old; a missing one is an error."""
    def pick(k, v):
        got = F.when(F.array_contains(replaced, k), F.try_element_at(new, k)).otherwise(v)
        return F.coalesce(got, F.raise_error(F.concat(F.lit("no score for "), k)).cast("bigint"))

    return F.transform_values(old, pick)


def tiers(rule: Column) -> Column:
    """The whole numbers that a scoring rule gives meanings to, as in "0 = none; 1 = some"."""
    return F.transform(F.regexp_extract_all(rule, F.lit(r"(?<!\d)(\d+)\s*[=＝]"), F.lit(1)), lambda x: x.cast("int"))


def candidate_problem(current: Column, candidate: Column) -> Column:
    """Null for a rubric that may follow another: next version, the same ids and maxima in order, all tiers spelt out, different checks, the same caps, something changed."""
    a, b = criterion_table(current), criterion_table(candidate)
    c = criteria(candidate)
    checks = F.transform(c, lambda x: F.lower(F.regexp_replace(_text(x["check"]), r"\s+", "")))
    before = F.transform(criteria(current), lambda x: F.lower(F.regexp_replace(_text(x["check"]), r"\s+", "")))
    caps = lambda r: F.coalesce(F.to_json(at(r, "$.reward_aggregation", "variant")), F.lit(""))
    full = F.exists(c, lambda x: F.size(F.array_except(F.sequence(F.lit(0).cast("bigint"), _int(x["max_points"])).cast("array<int>"), tiers(_text(x["scoring_rule"])))) > 0)
    return (
        F.when(rubric_problem(candidate).isNotNull(), "bad rubric")
        .when(F.coalesce(at(candidate, "$.rubric_version", "bigint") != at(current, "$.rubric_version", "bigint") + 1, F.lit(True)), "wrong version")
        .when(~F.coalesce(a == b, F.lit(False)), "ids or maxima changed")
        .when(F.coalesce(full, F.lit(True)), "a tier is missing")
        .when(F.size(F.array_distinct(checks)) != F.size(checks), "repeated check")
        .when(caps(current) != caps(candidate), "caps changed")
        .when(checks == before, "nothing changed")
    )


def fill(template: Column, values: list[tuple[str, Column]]) -> Column:
    """Literal placeholders replaced one after another."""
    for name, value in values:
        template = F.replace(template, F.lit(name), value)
    return template


def split_at(text: Column, marker: str) -> Column:
    """System and user part of a prompt, before and behind a marker; without it all is the user's."""
    p = F.instr(text, marker)
    return F.struct(F.when(p > 0, strip(F.substring(text, F.lit(1), p - 1))).otherwise(F.lit("")).alias("system"), F.when(p > 0, strip(F.substring(text, p + len(marker), F.length(text)))).otherwise(text).alias("user"))


def token_estimate(text: Column) -> Column:
    """Characters beyond ASCII, and a quarter of the others, rounded up."""
    other = F.length(F.regexp_replace(text, r"[\x00-\x7f]", ""))
    return (other + F.ceil((F.length(text) - other) / 4)).cast("long")


def place_and_reason(text: Column) -> Column:
    """A note "place: reason", split at its first colon, ASCII or full-width."""
    parts = F.split(text, "[:：]", 2)
    return F.struct(strip(F.get(parts, F.lit(0))).alias("place"), strip(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("reason"))


def state_key(stem: Column, query_id: Column, query: Column) -> Column:
    """The key that a rubric's state is kept under: its public id, else the query's id, else a hash of the query."""
    return F.coalesce(F.nullif(strip(stem), F.lit("")), F.concat(F.lit("query_id:"), query_id.cast("string")), F.concat(F.lit("query_sha256:"), F.sha2(query, 256)))


def split_criteria(criteria: Column, saturated: Column) -> Column:
    """A struct: the criteria (structs with an id) that ``saturated`` names, in its order, and the retained ones in their own; an unknown id is an error."""
    def pick(k):
        got = F.get(F.filter(criteria, lambda c: c["id"] == k), F.lit(0))
        return F.when(got.isNull(), F.raise_error(F.concat(F.lit("no criterion "), k))).otherwise(got)

    return F.struct(F.transform(saturated, pick).alias("saturated"), F.filter(criteria, lambda c: ~F.array_contains(saturated, c["id"])).alias("retained"))


def _fields(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _has_keys(fields: Column, *names: str) -> Column:
    got = F.size(fields) == len(names)
    for n in names:
        got = got & F.map_contains_key(fields, n)
    return F.coalesce(got, F.lit(False))


def score_matrix_problem(criteria: Column, payload: Column, responses: Column) -> Column:
    """Null for a matrix {"criteria": [{id, scores: [{rollout_id, score, reason}]}]} with the criteria (id, max) in
    order, a score of each of R0, R1, ... in order, whole and within bounds, and reasons that aren't blank; else what
    is wrong. Keys other than these are wrong."""
    value = lambda m, k: F.try_element_at(m, F.lit(k))

    def cell(m, i, best):
        """The number of the first thing that is wrong with a score, null if nothing is."""
        scored = let(value(m, "score"), lambda v: F.coalesce(is_integer(v) & let(_int(v), lambda x: (x >= 0) & (x <= best)), F.lit(False)))
        reasoned = let(value(m, "reason"), lambda v: F.coalesce(is_text(v) & (F.length(strip(_text(v))) > 0), F.lit(False)))
        other = F.coalesce(_text(value(m, "rollout_id")) != F.concat(F.lit("R"), i.cast("string")), F.lit(True))
        return F.when(~_has_keys(m, "rollout_id", "score", "reason"), 4).when(other, 5).when(~scored, 6).when(~reasoned, 7)

    def row(m, c):
        other = let(value(m, "id"), lambda v: F.coalesce(~is_text(v) | (_text(v) != c["id"]), F.lit(True)))

        def among(scores):
            cells = F.transform(scores, lambda v, i: let(_fields(v), lambda m: cell(m, i, c["max"])))
            return F.when(scores.isNull() | F.coalesce(F.size(scores) != responses, F.lit(True)), 3).otherwise(F.array_min(cells))

        return F.when(~_has_keys(m, "id", "scores"), 1).when(other, 2).otherwise(let(F.try_variant_get(value(m, "scores"), "$", "array<variant>"), among))

    def problem(rows):
        first = let(F.array_min(F.zip_with(criteria, rows, lambda c, v: let(_fields(v), lambda m: row(m, c)))), lambda k: F.get(F.array(*map(F.lit, MATRIX_PROBLEMS)), k - 1))
        return F.when(rows.isNull() | (F.size(rows) != F.size(criteria)), "wrong number of criteria").otherwise(first)

    whole = lambda m: F.when(~_has_keys(m, "criteria"), "wrong shape").otherwise(let(F.try_variant_get(value(m, "criteria"), "$", "array<variant>"), problem))
    return let(_fields(payload), whole)


MATRIX_PROBLEMS = ("wrong shape of a criterion", "wrong criterion", "wrong number of scores", "wrong shape of a score", "wrong response", "score out of bounds", "blank reason")


def finite(value: Column) -> Column:
    """Whether a number is there and neither infinite nor NaN."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def canonical_score(payload: Column, version: str, field: str = "overall_score_100") -> Column:
    """The score, from 0 to 100, of a checked payload of the given rubric version; null for another version, for what isn't a number and for one out of bounds."""
    v = at(payload, f"$.{field}", "variant")
    score = F.when(is_number(v), at(payload, f"$.{field}", "double"))
    return F.when((at(payload, "$.rubric_version", "string") == version) & finite(score) & score.between(0, 100), score)
