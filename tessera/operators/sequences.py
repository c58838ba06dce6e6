"""Assembly of prompts and responses, padded and ragged token arrays, and projections of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns that rewards are computed from; they stay with a batch whose other columns go to generation.
REWARD_COLUMNS = ("data_source", "reward_model", "extra_info", "uid", "row_idx")


def generation_batch(df: DataFrame, tensors: list[str], pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Columns for generation (all but the tensors), and what stays: tensors and reward columns. Both keep ``pos``."""
    stays = [c for c in df.columns if c in tensors or c in REWARD_COLUMNS]
    return df.select(pos, *[c for c in df.columns if c != pos and c not in tensors]), df.select(pos, *[c for c in stays if c != pos])


def with_index(df: DataFrame, info: str = "extra_info") -> DataFrame:
    """Adds index and row_idx: the row's ``extra_info.index``, 0 where it, the struct or the column isn't there."""
    fields = df.schema[info].dataType.fieldNames() if info in df.columns else []
    index = F.coalesce(F.col(info)["index"].cast("long"), F.lit(0).cast("long")) if "index" in fields else F.lit(0).cast("long")
    return df.withColumn("index", index).withColumn("row_idx", F.col("index"))


def append_values(df: DataFrame, name: str, value: str, order: list[str], prefix: str = "") -> DataFrame:
    """Values of each name as a list in order, names under a prefix unless they have it. A list is as long as its name has rows."""
    own = F.when(F.col(name).startswith(prefix), F.col(name)).otherwise(F.concat(F.lit(prefix), name)).alias(name)
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(own).agg(F.transform(items, lambda x: x["_v"]).alias("values"))


def differences(left: DataFrame, right: DataFrame, key: str = "pos") -> DataFrame:
    """For each column the number of rows on which two batches differ; a row that one side lacks differs in all. Null and NaN equal themselves.

    Batches with other columns or types are an error. ``key`` is unique on both sides.
    """
    if sorted(left.dtypes) != sorted(right.dtypes):
        raise ValueError(f"batches have other columns: {sorted(set(left.dtypes) ^ set(right.dtypes))}")
    names = [c for c in left.columns if c != key]
    pack = lambda df, alias: df.select(key, F.struct(*names).alias(alias))
    both = pack(left, "_a").join(pack(right, "_b"), key, "full")
    lacks = F.col("_a").isNull() | F.col("_b").isNull()
    counts = both.agg(*[F.count_if(lacks | ~F.col("_a")[c].eqNullSafe(F.col("_b")[c])).alias(c) for c in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("rows")) for c in names])).alias("x")).select("x.*")


def statistics(df: DataFrame, value: str | Column, mask: str | Column | None = None) -> DataFrame:
    """Mean, largest, smallest and sample deviation of all values, and the mean of those whose mask is 1."""
    v = F.col(value) if isinstance(value, str) else value
    m = F.lit(1) if mask is None else F.col(mask) if isinstance(mask, str) else mask
    return df.agg(F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.stddev_samp(v).alias("std"), (F.sum(v * m) / F.sum(m)).alias("masked_mean"))


def _filled(array: Column, length: int, value) -> Column:
    """An array cut or filled at its end to a length."""
    cut = F.slice(array, 1, length)
    return F.concat(cut, F.array_repeat(value, F.lit(length) - F.size(cut)))


def preference_pair(prompt: Column, chosen: Column, rejected: Column, eos: int | None, length: int) -> Column:
    """A struct of input_ids and attention_mask, each an array of two: prompt and chosen, prompt and rejected, with the
    end token unless it is None, cut or filled with 0 at the end to ``length``."""
    end = F.array().cast("array<bigint>") if eos is None else F.array(F.lit(eos).cast("bigint"))
    both = [F.concat(prompt.cast("array<bigint>"), x.cast("array<bigint>"), end) for x in (chosen, rejected)]
    ids = F.array(*[_filled(x, length, F.lit(0).cast("bigint")) for x in both])
    mask = F.array(*[_filled(F.transform(x, lambda _: F.lit(1)), length, F.lit(0)) for x in both])
    return F.struct(ids.alias("input_ids"), mask.alias("attention_mask"))


def without_left_pad(ids: Column, mask: Column) -> Column:
    """The last ids, as many as the mask has ones."""
    n = F.aggregate(mask, F.lit(0), lambda t, x: t + x.cast("int"))
    return F.slice(ids, F.size(ids) - n + 1, n)


def ragged(ids: Column, mask: Column) -> Column:
    """The ids whose mask is 1."""
    kept = F.filter(F.arrays_zip(ids.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    return F.transform(kept, lambda x: x["v"])


def sequence_offsets(df: DataFrame, length: str | Column, pos: str = "pos", block: int = 1 << 16) -> DataFrame:
    """Adds start and end: where a row's tokens lie when all rows' are put behind one another by ``pos``.

    Rows are summed in blocks of ``block`` positions; only the blocks' sums, one
    row for each, are added up in one task, and they join by block.
    """
    own = df.withColumn("_n", (F.col(length) if isinstance(length, str) else length).cast("long")).withColumn("_block", F.floor(F.col(pos) / block))
    sums = own.groupBy("_block").agg(F.sum("_n").alias("_sum"))
    before = sums.select("_block", F.coalesce(F.sum("_sum").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum("_n").over(W.partitionBy("_block").orderBy(pos))
    out = own.withColumn("end", within).join(before, "_block").withColumn("end", F.col("end") + F.col("_before"))
    return out.withColumn("start", F.col("end") - F.col("_n")).drop("_n", "_block", "_before")


def response_values(values: Column, prompt_length: Column, response_length: Column, length: int) -> Column:
    """Of a model's outputs for a prompt and its response those that predict the response: one place earlier, filled with 0 to ``length``. A prompt without tokens is an error."""
    got = F.when(prompt_length > 0, F.slice(values.cast("array<double>"), prompt_length.cast("int"), response_length.cast("int")))
    return _filled(F.coalesce(got, F.raise_error(F.lit("a prompt has no tokens")).cast("array<double>")), length, F.lit(0.0))


def assemble(prompt: Column, response: Column, response_mask: Column, prompt_length: int, response_length: int) -> Column:
    """A struct: input_ids (prompt filled with 0 at its left, response cut or filled at its right), attention_mask,
    response_mask and position_ids, which count attended tokens from 0 and stay at the last one's behind it.

    A prompt longer than ``prompt_length`` is an error.
    """
    size = F.size(prompt)
    left = F.when(size <= prompt_length, F.lit(prompt_length) - size).otherwise(F.raise_error(F.lit("a prompt is too long")).cast("int"))
    tokens = F.least(F.size(response), F.lit(response_length))
    ids = F.concat(F.array_repeat(F.lit(0).cast("bigint"), left), prompt.cast("array<bigint>"), _filled(response.cast("array<bigint>"), response_length, F.lit(0).cast("bigint")))
    attention = F.concat(F.array_repeat(F.lit(0), left), F.array_repeat(F.lit(1), size + tokens), F.array_repeat(F.lit(0), F.lit(response_length) - tokens))
    last = F.lit(prompt_length) + tokens - 1
    places = F.transform(F.sequence(F.lit(0), F.lit(prompt_length + response_length - 1)), lambda i: F.greatest(F.lit(0), F.least(i, last) - left))
    return F.struct(ids.alias("input_ids"), attention.alias("attention_mask"), _filled(response_mask.cast("array<int>"), response_length, F.lit(0)).alias("response_mask"), places.alias("position_ids"))
