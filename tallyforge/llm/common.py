"""What the training-data operators share: tables, work folders and word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word contract: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scratch: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder of the session, or below that of ``scratch``.

    The cluster names the folder in ``spark.checkpoint.dir``. Only where that is unset and the context has none, and
    driver and executors are one process (master local or local[...], as in tests), is a temporary one made.
    """
    base = _scratch[-1] if _scratch else spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        base = context.getCheckpointDir()
        if not base:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="tallyforge-")
            context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tallyforge-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder of tables that nothing reads any more; one that isn't there is no fault."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Inside, all work folders lie in one, which is deleted at the end: what is wanted must be written before.

    Operators that write tables between their steps read them lazily, so only their caller knows when they may go.
    """
    folder = work_dir(spark)
    _scratch.append(folder)
    try:
        yield folder
    finally:
        _scratch.remove(folder)
        deleted(spark, folder)


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cuts the lineage of df by a Parquet table in a shared folder; survives the loss of executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; none for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5)
    return F.array_remove(F.split(flat, " "), "")


def computed_once(column: Column) -> Column:
    """The column, marked non-deterministic so that filters on it aren't rewritten to filters on its whole expression.

    The optimizer would push those below the projections that share parts of the expression, and so evaluate nested
    higher-order functions again for every element.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow that gives freed memory back when its partition ends; workers live on between stages."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return run
