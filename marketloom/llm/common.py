"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space, and words as runs of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; Spark's reader alone opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: the cluster's ``spark.checkpoint.dir``, else (tests) one of our own; a cluster must set it."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if place is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        place = "file://" + tempfile.mkdtemp(prefix="marketloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(place)
    return place


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_dir(spark: SparkSession, path: str) -> None:
    """Removes a folder through Hadoop's file systems, wherever it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder; Spark's cleaner drops it with its last reader."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a table in the shared folder, which is compressed, where a checkpoint is not; it goes when the driver ends."""
    spark = df.sparkSession
    place = fresh_dir(spark, name)
    df.write.option("compression", "zstd").parquet(place)
    atexit.register(drop_quietly, spark, place)
    free(spark)
    return spark.read.parquet(place)


def fitted(df: DataFrame, rows: int, rows_a_task: int) -> DataFrame:
    """``df`` in no more partitions than ``rows`` rows need, without a shuffle; one that has fewer is left as it is.

    Small tables behind a shuffle otherwise cost a task for each of the session's shuffle partitions, and the driver
    remembers every task.
    """
    return df.coalesce(max(1, -(-rows // rows_a_task)))


def drop_quietly(spark: SparkSession, place: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        delete_dir(spark, place)


def free(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any longer."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that gives the memory of its task back to the machine; workers live on after their tasks."""

    def tidied(batches):
        import pyarrow

        pyarrow.set_memory_pool(pyarrow.system_memory_pool())  # the one whose memory can be given back
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    """Gives memory that is free in this process back to the machine."""
    import ctypes

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000):
    """For what is run inside: Arrow batches of so many rows at most, so that long texts make no large buffers on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, most: int):
    """For what is run inside: Arrow batches of so many bytes at most (or one row), on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with as many _ before them as keep them apart from the columns of ``df``."""
    taken, before = {c.lower() for c in df.columns}, ""
    while any((before + n).lower() in taken for n in names):
        before += "_"
    return [before + n for n in names]


def input_bytes(df: DataFrame) -> int:
    """Bytes that Catalyst's statistics give the plan: file sizes for a scan, an upper bound for most else."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(df: DataFrame, mb: int = 24, least: int = 1) -> int:
    """Partitions of about ``mb`` MB each of the input's files."""
    n = -(-input_bytes(df) // (mb << 20))
    return int(max(least, min(n, 200_000)))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it was."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` and its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """array<string>: the runs of anything but ASCII white space."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def over_runs(a: Column, k: int, f: Callable[[Column], Column]) -> Column:
    """array of f(slice of k neighbouring elements); the array must have k elements at least."""
    return F.transform(F.sequence(F.lit(1), F.size(a) - (k - 1)), lambda i: f(F.slice(a, i, F.lit(k))))
