"""Task selection: eligibility, language and limits, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def eligible(seeds: DataFrame, present: DataFrame) -> DataFrame:
    """Completed, passed, not rejected by validation (null: not checked), and present in the directory listing."""
    chosen = seeds.where("status = 'completed' AND coalesce(passed, false) AND coalesce(tb_validated, true)")
    return chosen.join(present, "uuid", "left_semi")


def seed_dir(cwe: Column, uuid: Column) -> Column:
    """cwe-{number}/{uuid}."""
    return F.concat(F.lit("cwe-"), F.lower(F.replace(cwe, F.lit("CWE-"), F.lit(""))), F.lit("/"), uuid.cast("string"))


def with_language(seeds: DataFrame, language: str) -> DataFrame:
    return seeds.where(F.lower("language") == language.lower())


def by_language_priority(seeds: DataFrame, first: str, per: str, limit: int, position: str = "uuid") -> DataFrame:
    """Up to ``limit`` seeds of each ``per``, those of one language first, else in input order."""
    order = W.partitionBy(per).orderBy(F.when(F.col("language") == first, 0).otherwise(1), position)
    return seeds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def prefix(seeds: DataFrame, n: int, position: str = "uuid") -> DataFrame:
    """The first n rows by position; 0 is no limit."""
    return seeds.orderBy(position).limit(n) if n else seeds


def top_groups(rows: DataFrame, by: str, n: int = 10) -> DataFrame:
    """The n largest groups, ties by name."""
    return rows.groupBy(by).count().withColumnRenamed("count", "n").orderBy(F.desc("n"), by).limit(n)


def batch_counters(seeds: DataFrame) -> DataFrame:
    """Per group and in total: seeds, completed (or failed), successful; a group succeeds with one successful seed."""
    counts = seeds.rollup("cwe_id").agg(
        F.count(F.lit(1)).alias("total_seeds"),
        F.count_if(F.col("status").isin("completed", "failed")).alias("completed_seeds"),
        F.count_if(F.coalesce("passed", F.lit(False))).alias("successful_seeds"),
        F.grouping("cwe_id").cast("int").alias("is_total"),
    )
    return counts.withColumn("succeeded", F.col("successful_seeds") > 0)
