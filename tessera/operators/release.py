"""Publishing a table: checks, public ids, split rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Classes of private markers.
PRIVATE = {
    "path": r"(?i)(?:/(?:home|users|mnt|root|data)/[\w.-]+/|[a-z]:\\\\users\\\\)",
    "secret": r"(?:sk-[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{20,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)",
    "address": r"(?i)[\w.+-]+@[\w-]+\.[a-z]{2,}",
    "host": r"\b(?:10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))(?:\.\d{1,3}){2,3}\b",
}


def _some(dtype: T.DataType, value: Column, test) -> Column | None:
    """Whether a test holds for any string within a value of a type, however deep."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(test(value), F.lit(False))
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.exists(value, lambda x: _some(dtype.elementType, x, test)), F.lit(False)) if _has_text(dtype.elementType) else None
    if isinstance(dtype, T.MapType):
        parts = [_some(T.ArrayType(t), f(value), test) for t, f in ((dtype.keyType, F.map_keys), (dtype.valueType, F.map_values)) if _has_text(t)]
        return parts[0] if len(parts) == 1 else parts[0] | parts[1] if parts else None
    if isinstance(dtype, T.StructType):
        parts = [_some(f.dataType, value[f.name], test) for f in dtype.fields if _has_text(f.dataType)]
        out = None
        for p in parts:
            out = p if out is None else out | p
        return out
    return None


def _has_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_text(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_text(dtype.keyType) or _has_text(dtype.valueType)
    return isinstance(dtype, T.StringType)


def _names(dtype: T.DataType) -> list[str]:
    if isinstance(dtype, T.StructType):
        return [n for f in dtype.fields for n in (f.name, *_names(f.dataType))]
    if isinstance(dtype, T.ArrayType):
        return _names(dtype.elementType)
    return []


def private_marks(df: DataFrame, patterns: dict[str, str] = PRIVATE) -> DataFrame:
    """Adds has_<class> for each class of markers, over all strings of a row; a field name with one is an error."""
    for kind, pattern in patterns.items():
        for name in _names(df.schema):
            if re.search(pattern, name):
                raise ValueError(f"the field name {name} has a {kind}")
        found = _some(df.schema, F.struct(*[F.col(c) for c in df.schema.names]), lambda v, p=pattern: v.rlike(p))
        df = df.withColumn(f"has_{kind}", F.lit(False) if found is None else found)
    return df


def repeated_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("times")).filter("times > 1")


def crossing_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups with rows on more than one side of a split."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("sides")).filter("sides > 1")


def public_ids(df: DataFrame, within: str, group: str, order: str, name: str = "public_id") -> DataFrame:
    """Ids "<within>_0001_q02": groups numbered in their order from 1 within a medium, rows within a group from 0.

    Numbers are made over the distinct groups and joined back, so no task sorts a medium's rows.
    """
    numbers = df.select(within, group).distinct().withColumn("_g", F.row_number().over(W.partitionBy(within).orderBy(group)))
    rows = df.withColumn("_q", F.row_number().over(W.partitionBy(within, group).orderBy(order)) - 1).join(numbers, [within, group])
    return rows.withColumn(name, F.format_string("%s_%04d_q%02d", F.col(within), F.col("_g"), F.col("_q"))).drop("_g", "_q")


def well_formed(value: Column, pattern: str) -> Column:
    """Full match."""
    return value.rlike(f"^(?:{pattern})$")


def expected_counts(df: DataFrame, key: str, wanted: dict) -> DataFrame:
    """Keys whose number of rows isn't the wanted one, missing ones among them."""
    want = df.sparkSession.createDataFrame(list(wanted.items()), f"{key} string, wanted long")
    got = df.groupBy(key).agg(F.count("*").alias("got"))
    return got.join(want, key, "full").select(key, F.coalesce("got", F.lit(0)).alias("got"), F.coalesce("wanted", F.lit(0)).alias("wanted")).filter("got != wanted")


def keep_short(df: DataFrame, length: Column, most: int) -> DataFrame:
    """Rows whose length is known and at most ``most``; a length that can't be told counts as too long."""
    return df.filter(F.coalesce(length, F.lit(most + 1)) <= most)
