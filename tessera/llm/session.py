"""What the operators need from the session: tables, shared storage, sizes."""

from __future__ import annotations

import ctypes
import inspect
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a folder of its own; on
    a cluster that would not be shared, so it is an error there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = spark.sparkContext.getCheckpointDir()
        if not path:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
            path = spark.sparkContext.getCheckpointDir()
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    A checkpoint keeps the constraints that its plan implied. Over many rounds
    they multiply, and planning outlasts the work, so they aren't derived here.
    The shuffle files behind a checkpoint are of no more use and go with it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    settings = {"spark.sql.constraintPropagation.enabled": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return df.select("*").checkpoint(eager=True)  # a new plan, made under these settings
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def trim() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


#: Bytes of a group after which memory is handed back; that takes longer than a small group's work.
WORTH = 1 << 20


def light(f):
    """``f``, a function of Arrow batches or tables, that leaves no freed memory behind: Python workers outlive their tasks."""
    if inspect.isgeneratorfunction(f):

        def run(batches):
            yield from f(batches)
            trim()

    elif len(inspect.signature(f).parameters) == 2:

        def run(left, right):
            try:
                return f(left, right)
            finally:
                if left.nbytes + right.nbytes > WORTH:
                    trim()

    else:

        def run(rows):
            try:
                return f(rows)
            finally:
                if rows.nbytes > WORTH:
                    trim()

    return run


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB where the session has Spark's default of 64 MB: a task holds several copies of one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) == "67108864b":
        spark.conf.set(name, str(8 << 20))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Bytes of text of a piece, which a task holds in memory as a whole.
PIECE_BYTES = 4 << 20


def pieces(docs: DataFrame) -> int:
    """Into how many pieces a corpus is cut: so many that a piece has about
    PIECE_BYTES, whatever the corpus' size, and no fewer than fill the machines."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * shuffle_width(docs.sparkSession), -(-total // PIECE_BYTES))


def in_pieces(docs: DataFrame, *columns, n: int) -> DataFrame:
    """``columns`` of ``docs`` and ``piece``, which depends on doc_id alone."""
    return docs.select(*columns, F.pmod(F.hash("doc_id"), F.lit(n)).cast("int").alias("piece"))
