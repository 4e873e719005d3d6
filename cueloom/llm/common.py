"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: One word is a run of anything but these six separators.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column | str) -> Column:
    """Lower-cases A-Z and nothing else; null stays null."""
    return F.translate(F.col(text) if isinstance(text, str) else text, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + x)


def offsets(lengths: Column) -> Column:
    """array<int>: for each of ``lengths`` (array<int>) the sum of those before it.

    An accumulator that grows would be copied at each step. So lengths are summed in blocks of 256: the work of an array of n
    is 128 n + (n / 256) ** 2 / 2 additions, seconds for a million.
    """
    size = 256

    def of(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / size).cast("int")), lambda j: _sum(F.slice(all_, j * size + 1, F.lit(size))))
        starts = let(blocks, lambda sums: F.transform(sums, lambda _, j: _sum(F.slice(sums, F.lit(1), j))))
        return let(starts, lambda at: F.transform(all_, lambda _, i: F.get(at, F.floor(i / size).cast("int")) + _sum(F.slice(all_, i - i % size + 1, i % size))))

    return let(lengths, lambda all_: F.when(F.size(all_) > 0, of(all_)).otherwise(all_))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Only a local session may do without: it gets a temporary one. On a cluster that would be another disk on each machine.
    """
    if place := spark.conf.get("spark.checkpoint.dir", None):
        return place
    if held := spark.sparkContext.getCheckpointDir():
        return held
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.mkdtemp(prefix='cueloom-')}"


def materialize(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: its rows survive the loss of any executor."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Scratch:
    """Intermediate tables, written as Parquet to the shared folder: compressed, and of a size that the planner knows."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.place, self.kept = spark, f"{shared_folder(spark)}/cueloom-{uuid.uuid4().hex}", 0

    def store(self, df: DataFrame) -> DataFrame:
        self.kept += 1
        path = f"{self.place}/{self.kept}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_all_but_last(self) -> None:
        for k in range(1, self.kept):
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{k}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most for this session: a Python worker and the JVM hold one each for every column set."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8388608")


def release_memory() -> None:
    """Gives freed memory back to the system; Python workers live on between tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage: only then does Spark delete the shuffle files of plans that nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    release_memory()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or it with underscores before it when the input has a column of that name already."""
    lowered = {c.lower() for c in taken}
    while wanted.lower() in lowered:
        wanted = "_" + wanted
    return wanted
