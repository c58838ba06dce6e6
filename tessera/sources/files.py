"""Reading and publishing tables of files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READERS = {".parquet": lambda r, p: r.parquet(p), ".json": lambda r, p: r.json(p), ".jsonl": lambda r, p: r.json(p)}


def read_files(spark: SparkSession, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
    """Parquet, JSON and JSON lines by suffix, one after another; any other suffix is an error."""
    def one(path: str) -> DataFrame:
        suffix = re.search(r"\.[^./]+$", path.rstrip("/"))
        if not suffix or suffix[0].lower() not in READERS:
            raise ValueError(f"no reader for {path}")
        reader = spark.read.schema(schema) if schema else spark.read
        return READERS[suffix[0].lower()](reader, path)

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(one, paths))


def read_checked(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """Parquet with an expected number of rows."""
    df = spark.read.parquet(path)
    if (n := df.count()) != rows:
        raise ValueError(f"{path} has {n} rows, not {rows}")
    return df


def read_some(spark: SparkSession, root: str, pattern: str, format: str = "binaryFile") -> DataFrame:
    """Files under a folder whose names match a glob."""
    return spark.read.format(format).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)


def preference_pairs(df: DataFrame, prompt="prompt", chosen="chosen", rejected="rejected") -> DataFrame:
    return df.select(F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected"))


def publish(df: DataFrame, path: str, schema: T.StructType | None = None, partition_by: list[str] | None = None) -> None:
    """Parquet with zstd and dictionaries, under a pinned schema: other columns or types are an error."""
    if schema is not None:
        if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in schema]:
            raise ValueError(f"schema is {df.schema.simpleString()}, not {schema.simpleString()}")
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.enable.dictionary", "true").partitionBy(*(partition_by or [])).parquet(path)


def manifest(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """SHA-256 and size of each file under a folder, hashed where the files are read."""
    files = read_some(spark, root, pattern)
    return files.select(F.regexp_replace("path", "^.*/", "").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def dump_steps(df: DataFrame, path: str, step: str = "step") -> None:
    """JSON lines, a folder for each step, written anew for the steps that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(step).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Adds records to a JSON-lines log."""
    df.write.mode("append").json(path)


def metric_log(df: DataFrame, step: str = "step", name: str = "name", value: str = "value") -> DataFrame:
    """One record for each step, {"step", "data"}, from rows of names and values."""
    return df.groupBy(step).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("data"))


SINKS: dict = {"log": append_log}


def send(df: DataFrame, backends: list[str], **options) -> None:
    """Hand metrics to sinks by name; an unknown name is an error before anything is written."""
    unknown = [b for b in backends if b not in SINKS]
    if unknown:
        raise ValueError(f"no sinks named {unknown}; there are {', '.join(SINKS)}")
    for b in backends:
        SINKS[b](df, **options.get(b, {}))


def clean_metric_name(name):
    """Names that any backend takes: @ spelt out, slashes not repeated, other characters replaced."""
    return F.regexp_replace(F.regexp_replace(F.replace(name, F.lit("@"), F.lit("_at_")), "/+", "/"), r"[^A-Za-z0-9_\-. /]", "_")


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs as columns with dotted names."""
    def walk(dtype: T.StructType, path: list[str]):
        for f in dtype.fields:
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, [*path, f.name])
            else:
                yield F.col(".".join(f"`{p}`" for p in [*path, f.name])).alias(separator.join([*path, f.name]))

    return df.select(*walk(df.schema, []))


def save_batch(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_batch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cached_step(spark: SparkSession, path: str, step: int, compute) -> DataFrame:
    """A step's rows from an earlier run's files, else computed and written. Spark's own reader says whether they are there."""
    from pyspark.errors import AnalysisException

    at = f"{path}/step={step}"
    try:
        return spark.read.parquet(at)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    compute().write.parquet(at)
    return spark.read.parquet(at)


def expanded_samples(df: DataFrame, n: int, row: str = "row_id") -> DataFrame:
    """Each row n times for generation, numbered by ``sample``."""
    return df.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def gathered_responses(df: DataFrame, row: str = "row_id", response: str = "response") -> DataFrame:
    """A row's samples as one array, in order of ``sample``."""
    return df.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", response))), lambda x: x[response]).alias("responses"))


def scored_responses(df: DataFrame, score, source: str = "data_source") -> DataFrame:
    """Mean over a source's rows of each row's mean score over its responses; score makes a column of a response."""
    own = F.transform("responses", score)
    mean = F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.size(own)
    return df.groupBy(source).agg(F.avg(mean).alias("score"))


def markdown_sections(spark: SparkSession, path: str, heading: str = "##") -> DataFrame:
    """(file, title, body) of each section of whole Markdown files."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^.*/", "").alias("file"), "value")
    found = F.regexp_extract_all("value", F.lit(rf"(?ms)^{heading} (.*?)(?=^{heading} |\z)"), F.lit(1))
    return text.select("file", F.posexplode(found).alias("n", "section")).select("file", "n", F.substring_index("section", "\n", 1).alias("title"), F.trim(F.regexp_replace("section", r"(?s)\A[^\n]*\n", "")).alias("body"))


def register_source(spark: SparkSession, source: type) -> None:
    """A table format of one's own, by Spark's Python data source interface."""
    spark.dataSource.register(source)
