"""Row operators on batches: selection, repetition, padding, chunks, column union.

A batch is a DataFrame with a column that numbers its rows from 0 (``pos``).
Positions are data, so no operator needs the rows of a table in one task;
``numbered`` makes them where they are missing.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, *order: str, name: str = "pos", parts: int | None = None) -> DataFrame:
    """Numbers rows from 0 in an order of unique values.

    Rows are sorted by range partition, partitions counted, and each row gets
    its place in its partition plus the rows before it: two passes, no single
    task over the table. The counts that go to all tasks are one number for
    each partition.
    """
    n = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = df.select(*order).stat.approxQuantile(order[0], [i / n for i in range(1, n)], 0.001) if n > 1 and dict(df.dtypes)[order[0]] in ("bigint", "int", "double", "float") else []
    edges = sorted(set(bounds))

    def among(low: int, high: int) -> Column:
        """How many edges lie below, by halving: a row is held against few of them, however many there are."""
        mid = (low + high) // 2
        return F.lit(low) if low == high else F.when(F.col(order[0]) > edges[mid], among(mid + 1, high)).otherwise(among(low, mid))

    own = df.withColumn("_part", among(0, len(edges)))
    counts = own.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = own.withColumn("_r", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1)
    return ranked.join(F.broadcast(before), "_part").withColumn(name, F.col("_r") + F.col("_before")).drop("_part", "_r", "_before")


def repeat(df: DataFrame, times: int, interleave: bool = True, pos: str = "pos") -> DataFrame:
    """Each row ``times`` times: next to one another, or the whole batch over and over."""
    out = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.limit(0).withColumn("_k", F.lit(0))
    if interleave:
        return out.withColumn(pos, F.col(pos) * times + F.col("_k")).drop("_k")
    size = df.agg((F.max(pos) + 1).alias("_size"))
    return out.crossJoin(F.broadcast(size)).withColumn(pos, F.col("_k") * F.col("_size") + F.col(pos)).drop("_k", "_size")


def repeat_each(df: DataFrame, count: str, name: str = "copy") -> DataFrame:
    """Each row as often as its own count says; 0 and less give none."""
    return df.filter(F.col(count) > 0).withColumn(name, F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1)))


def pad(df: DataFrame, rows: int, which: str = "last", pos: str = "pos") -> DataFrame:
    """``rows`` copies of the first row, or of the last for any other word, at the end."""
    if rows <= 0:
        return df
    edge = df.agg((F.max(pos) + 1).alias("_size"), (F.min(pos) if which == "first" else F.max(pos)).alias("_at"))
    copies = df.crossJoin(F.broadcast(edge)).filter(F.col(pos) == F.col("_at")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    return df.unionByName(copies.withColumn(pos, F.col("_size") + F.col("_k")).select(df.columns))


def pad_to_multiple(df: DataFrame, k: int, pos: str = "pos", mark: str = "is_pad") -> DataFrame:
    """Rows from the front, again and again, until the number of rows is a multiple of k; ``mark`` tells them."""
    size = F.broadcast(df.agg((F.max(pos) + 1).alias("_n")))
    own = df.crossJoin(size).withColumn("_pad", F.pmod(-F.col("_n"), F.lit(k)))
    again = own.filter(F.col(pos) < F.col("_pad")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("_pad") - 1 - F.col(pos)) / F.col("_n")).cast("int"))))
    again = again.withColumn(pos, F.col("_n") + F.col(pos) + F.col("_k") * F.col("_n")).withColumn(mark, F.lit(True))
    return df.withColumn(mark, F.lit(False)).unionByName(again.select(*df.columns, mark))


def unpad(df: DataFrame, mark: str = "is_pad") -> DataFrame:
    return df.filter(~F.col(mark)).drop(mark)


def rows_by_mask(df: DataFrame, mask: str | Column) -> DataFrame:
    return df.filter(mask)


def rows_by_index(df: DataFrame, index: DataFrame, pos: str = "pos") -> DataFrame:
    """The rows that a table (ord, idx) names, in its order; a row may come twice. Negative numbers count from the end."""
    size = F.broadcast(df.agg((F.max(pos) + 1).alias("_n")))
    wanted = index.crossJoin(size).select("ord", F.when(F.col("idx") < 0, F.col("idx") + F.col("_n")).otherwise(F.col("idx")).alias(pos))
    return wanted.join(df, pos).withColumn(pos, F.col("ord")).drop("ord")


def reorder(df: DataFrame, permutation: DataFrame, pos: str = "pos") -> DataFrame:
    return rows_by_index(df, permutation, pos)


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, pos: str = "pos") -> DataFrame:
    """As a list's slice with a step of 1 or more; rows keep their numbers."""
    if step < 1:
        raise ValueError("a step is 1 or more")
    if (start or 0) < 0 or (stop is not None and stop < 0):
        n = df.agg(F.max(pos)).first()[0]
        n = 0 if n is None else n + 1
        start, stop, _ = slice(start, stop).indices(n)
    start = start or 0
    keep = (F.col(pos) >= start) & (F.pmod(F.col(pos) - start, F.lit(step)) == 0)
    return df.filter(keep & (F.col(pos) < stop) if stop is not None else keep)


def chunk_number(n: int, k: int, pos: str = "pos", rest: bool = False) -> Column:
    """Number of a row's chunk, of k equal ones out of n rows. rest: rows beyond them get numbers from k on, by chunks of the same size; null if the size is 0."""
    if n % k and not rest:
        raise ValueError(f"{n} rows don't make {k} equal chunks")
    return F.floor(F.col(pos) / (F.lit(n // k) if n >= k else F.lit(None))).cast("int")


def split_number(size: int, pos: str = "pos") -> Column:
    """Number of a row's part of ``size`` rows; the last may be smaller."""
    return F.floor(F.col(pos) / size).cast("int")


def uneven_number(n: int, k: int, pos: str = "pos") -> Column:
    """Number of a row's part of k, the first n % k of which have one row more."""
    size, extra = divmod(n, k)
    edge = extra * (size + 1)
    p = F.col(pos)
    return F.when(p < edge, F.floor(p / (size + 1))).otherwise(extra + F.floor((p - edge) / max(size, 1))).cast("int")


def split_whole(df: DataFrame, n: int, k: int, pos: str = "pos", name: str = "part") -> DataFrame:
    """k equal parts; rows that don't fill one are dropped."""
    size = n // k
    return df.filter(F.col(pos) < size * k).withColumn(name, F.floor(F.col(pos) / max(size, 1)).cast("int"))


def concat(parts: list[DataFrame], pos: str = "pos", meta: list[str] | None = None) -> DataFrame:
    """Batches after one another; columns named ``meta`` must have one value throughout."""
    out, before = None, 0
    for p in parts:
        n = p.agg(F.max(pos)).first()[0]
        p = p.withColumn(pos, F.col(pos) + before)
        before += 0 if n is None else n + 1
        out = p if out is None else out.unionByName(p)
    for m in meta or []:
        if out.select(m).distinct().limit(2).count() > 1:
            raise ValueError(f"batches disagree on {m}")
    return out


def column_union(left: DataFrame, right: DataFrame, key: str = "pos") -> DataFrame:
    """Columns of both, row by row. Those in both must be equal (null and NaN equal themselves), else the job fails."""
    both = [c for c in left.columns if c in right.columns and c != key]
    out = left.join(right.select(key, *[F.col(c).alias(f"_r_{c}") for c in right.columns if c != key]), key)
    for c in both:
        same = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        out = out.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"columns {c} differ")).cast(left.schema[c].dataType)))
    return out.select(*left.columns, *[F.col(f"_r_{c}").alias(c) for c in right.columns if c not in left.columns])


def fold(df: DataFrame, group: str, columns: list[str], order: list[str]) -> DataFrame:
    """Rows of a group as one row of arrays, in order."""
    packed = F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias("_x")
    return df.groupBy(group).agg(packed).select(group, *[F.col("_x")[c].alias(c) for c in columns])


def unfold(df: DataFrame, columns: list[str], pos: str = "k") -> DataFrame:
    """Arrays of a row as rows."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.posexplode(F.arrays_zip(*columns)).alias(pos, "_x")).select(*rest, pos, *[F.col("_x")[c].alias(c) for c in columns])


def unfold_chunks(df: DataFrame, columns: list[str], n: int, chunk: str = "chunk") -> DataFrame:
    """Each row as n rows, the named arrays cut into n equal parts, all else repeated."""
    out = df.withColumn(chunk, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for c in columns:
        size = (F.size(c) / n).cast("int")
        out = out.withColumn(c, F.slice(F.col(c), F.col(chunk) * size + 1, size))
    return out


def select_batch(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df if keys is None else df.select(*keys)


def pop(df: DataFrame, keys: list[str], pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """The named columns as a batch of their own, and what is left; a column that isn't there is an error."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise KeyError(f"no columns {missing}")
    return df.select(pos, *[k for k in keys if k != pos]), df.drop(*[k for k in keys if k != pos])


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new)))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """All columns under a prefix, but for those that have it already."""
    return df.select([F.col(c).alias(c if c.startswith(prefix) else prefix + c) for c in df.columns])


def to_rows(df: DataFrame, columns: list[str]) -> Column:
    """A struct of arrays as an array of structs."""
    return F.arrays_zip(*columns)


def schema_report(df: DataFrame) -> list[tuple[str, str, bool]]:
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]


def size_report(df: DataFrame) -> DataFrame:
    """Rows, and bytes of each column as JSON text."""
    return df.agg(F.count("*").alias("rows"), *[F.sum(F.octet_length(F.to_json(F.struct(c)))).alias(c) for c in df.columns])


def mini_batches(df: DataFrame, n: int, size: int, epochs: int = 1, seed: int | None = None, pos: str = "pos", rest: bool = False) -> DataFrame:
    """Adds epoch and batch: each epoch deals all rows into batches, in order or shuffled by a seeded hash. rest: an epoch's last batch may be smaller."""
    if n % size and not rest:
        raise ValueError(f"{n} rows don't make batches of {size}")
    out = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is not None:
        place = F.row_number().over(W.partitionBy("epoch").orderBy(F.xxhash64(F.col(pos), F.col("epoch"), F.lit(seed)), pos)) - 1
        out = out.withColumn("_p", place)
    else:
        out = out.withColumn("_p", F.col(pos))
    return out.withColumn("batch", F.floor(F.col("_p") / size).cast("int")).drop("_p")


def drop_partial(df: DataFrame, size: int, batch: str = "batch") -> DataFrame:
    """Without the batch that isn't full."""
    full = df.groupBy(batch).count().filter(F.col("count") == size).select(batch)
    return df.join(full, batch, "left_semi")


def run_number(df: DataFrame, key: str, pos: str, within: str | None = None, name: str = "run_index") -> DataFrame:
    """Place of a row in its run of equal keys; a key that comes back later starts anew. within: runs don't cross its values, and tasks needn't either."""
    w = W.partitionBy(within).orderBy(pos) if within else W.orderBy(pos)
    new = (F.col(key) != F.lag(key).over(w)) | F.lag(key).over(w).isNull()
    out = df.withColumn("_run", F.sum(new.cast("int")).over(w))
    runs = W.partitionBy(*([within] if within else []), "_run").orderBy(pos)
    return out.withColumn(name, F.row_number().over(runs) - 1).drop("_run")


def sample_first(df: DataFrame, k: int, pos: str = "pos") -> DataFrame:
    return df.filter(F.col(pos) < k)


def sample_seeded(df: DataFrame, n: int, k: int, seed: int, pos: str = "pos") -> DataFrame:
    """k of n rows without replacement, the same for a seed; the draw is made on the driver."""
    import numpy as np

    chosen = np.random.default_rng(seed).choice(n, size=min(k, n), replace=False)
    picked = df.sparkSession.createDataFrame([(int(x),) for x in chosen], f"{pos} long")
    return df.join(F.broadcast(picked) if k <= 100_000 else picked, pos, "left_semi")


def sample_groups(df: DataFrame, group: str, k: int, seed: int = 0) -> DataFrame:
    """All rows of at most k groups, picked by a seeded hash."""
    picked = df.select(group).distinct().orderBy(F.xxhash64(F.col(group), F.lit(seed)), group).limit(k)
    return df.join(picked, group, "left_semi")


def resample(df: DataFrame, weight: Column, n: int, seed: int = 0, pos: str = "pos") -> DataFrame:
    """n rows drawn with replacement in proportion to a weight, by cumulative weights and uniform draws."""
    own = df.withColumn("_w", weight)
    w = W.orderBy(pos)
    spans = own.withColumn("_hi", F.sum("_w").over(w)).withColumn("_lo", F.col("_hi") - F.col("_w"))
    total = own.agg(F.sum("_w").alias("_all"))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.rand(seed).alias("_u")).crossJoin(F.broadcast(total)).withColumn("_u", F.col("_u") * F.col("_all"))
    return spans.join(draws, (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).drop("_w", "_lo", "_hi", "_u", "_all")


def resample_weight(score: str, kind: str = "pow", power: float = 2.0, group: str = "uid") -> Column:
    w = W.partitionBy(group)
    if kind == "pow":
        return F.pow(F.abs(F.col(score)), F.lit(power))
    if kind == "max_min":
        return F.when((F.col(score) == F.max(score).over(w)) | (F.col(score) == F.min(score).over(w)), 1.0).otherwise(0.0)
    if kind == "max_random":
        return F.when(F.col(score) == F.max(score).over(w), 1.0).otherwise(0.4)
    raise ValueError(f"no weights are named {kind}")


def shuffled_table(df: DataFrame, order: list[str], take: int, seed: int = 42) -> DataFrame:
    """Rows of a small table, sorted, shuffled with Python's seeded generator, the first ``take``."""
    rows = sorted(df.collect(), key=lambda r: tuple(r[c] for c in order))
    random.Random(seed).shuffle(rows)
    return df.sparkSession.createDataFrame(rows[:take], df.schema)
