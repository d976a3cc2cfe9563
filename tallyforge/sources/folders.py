"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only where that is unset, and driver and executors are one process (master local or local[...]), is a temporary one
    made.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tallyforge-")
    return f"{base.rstrip('/')}/tallyforge-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more; one that isn't there is no fault."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a table in a shared folder, a new one unless path says which: what is read again isn't computed again."""
    path = path or shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
