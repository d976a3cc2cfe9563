"""Semantic dedup of generated code: group by normalised hash, evaluate one run, copy its result to the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import code_hash, normalize_code
from tallyforge.sources.folders import written


def hashed(code: DataFrame) -> DataFrame:
    """(uuid, run_index, code_hash); code that normalises to nothing is a failed generation and left out."""
    rows = code.select("uuid", "run_index", normalize_code(F.col("code")).alias("normal"))
    return rows.where("normal <> ''").select("uuid", "run_index", code_hash(F.col("normal")).alias("code_hash"))


def groups(hashes: DataFrame, scope: str = "uuid") -> DataFrame:
    """One row for each group: its representative (smallest run_index, uuid) and size. scope: uuid, or global.

    Representatives are a min aggregation and not a window, so a group of any size is combined before the shuffle.
    """
    keys = ["code_hash"] if scope == "global" else ["uuid", "code_hash"]
    first = F.min(F.struct("run_index", "uuid")).alias("first")
    rows = hashes.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("size"))
    return rows.select(*keys, F.col("first.uuid").alias("rep_uuid"), F.col("first.run_index").alias("rep_run_index"), "size")


def representatives(hashes: DataFrame, scope: str = "uuid") -> DataFrame:
    """Every run with the run that stands for it. The hashes are written first, so that no code is normalised twice."""
    hashes = written(hashes)
    keys = ["code_hash"] if scope == "global" else ["uuid", "code_hash"]
    return hashes.join(groups(hashes, scope).drop("size"), keys).select("uuid", "run_index", "rep_uuid", "rep_run_index")


def stats(found: DataFrame) -> DataFrame:
    """Total, unique, duplicates, largest and mean group, and the share of duplicates."""
    n, total = F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))
    return found.agg(
        total.alias("total"), n.alias("unique_codes"), (total - n).alias("duplicates"), F.coalesce(F.max("size"), F.lit(0)).alias("max_group"),
        F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_group"), F.coalesce(F.try_divide((total - n).cast("double"), total.cast("double")), F.lit(0.0)).alias("rate"),
    )


def copied_results(mapping: DataFrame, results: DataFrame) -> DataFrame:
    """Results of representatives as rows of their duplicates, with lineage; targets that have a result are left alone."""
    others = mapping.where("NOT (uuid <=> rep_uuid AND run_index <=> rep_run_index)")
    missing = others.join(results.select("uuid", "run_index"), ["uuid", "run_index"], "left_anti")
    source = results.withColumnsRenamed({"uuid": "rep_uuid", "run_index": "rep_run_index"})
    lineage = F.concat_ws("/", F.col("rep_uuid").cast("string"), F.col("rep_run_index").cast("string")).alias("copied_from")
    return missing.join(source, ["rep_uuid", "rep_run_index"]).withColumn("copied_from", lineage).drop("rep_uuid", "rep_run_index")
