"""Mutation scores, coverage, the quality gate and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.selection import nth_value


def per_mutant(runs: DataFrame) -> DataFrame:
    """A mutant is detected if any test bench detects it."""
    return runs.groupBy("seed", "mutant").agg(F.bool_or("detected").alias("detected"), F.count(F.lit(1)).alias("pairs"), F.count_if("detected").alias("detected_pairs"))


def per_seed(runs: DataFrame) -> DataFrame:
    """Two grains: detected mutants over mutants, detected pairs over pairs; 0 for none. Effective from 0.5."""
    rate = lambda a, b: F.coalesce(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")), F.lit(0.0))
    rows = per_mutant(runs).withColumns({"one": F.lit(1), "hit": F.col("detected").cast("int")})
    return (
        rows.groupBy("seed")
        .agg(F.count(F.lit(1)).alias("mutants"), F.sum("hit").alias("detected_mutants"), F.sum("pairs").alias("pairs"), F.sum("detected_pairs").alias("detected_pairs"), rate("hit", "one").alias("mutation_rate"), rate("detected_pairs", "pairs").alias("tb_rate"))
        .withColumn("is_effective", F.col("mutation_rate") >= 0.5)
    )


def report(seeds: DataFrame) -> DataFrame:
    """Totals over per_seed, micro-averaged."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")), F.lit(0.0))
    return seeds.agg(
        F.count(F.lit(1)).alias("seeds"), F.count_if("is_effective").alias("effective"), F.count_if(~F.col("is_effective")).alias("weak"),
        F.coalesce(F.sum("mutants"), F.lit(0)).alias("mutants"), F.coalesce(F.sum("detected_mutants"), F.lit(0)).alias("detected"),
        ratio("detected_mutants", "mutants").alias("micro_rate"), ratio("detected_pairs", "pairs").alias("micro_tb_rate"),
    )


def gate(rate: Column, coverage: Column, least_rate: float = 0.5, least_coverage: float = 0.8) -> Column:
    """The reason to filter a seed, null if it passes; null rate: no directory; null coverage: not measured, passes."""
    weak, thin = rate < least_rate, F.coalesce(coverage < least_coverage, F.lit(False))
    return F.when(rate.isNull(), "directory_not_found").when(weak & thin, "low_mutation_and_coverage").when(weak, "low_mutation_rate").when(thin, "low_coverage")


def breakdown(gated: DataFrame) -> DataFrame:
    """Counts by reason; seeds without data aren't part of the filtered ones."""
    is_ = lambda r: F.count_if(F.col("reason") == r)
    return gated.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("reason").isNull()).alias("validated"),
        F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "directory_not_found")).alias("filtered"),
        is_("low_mutation_and_coverage").alias("both_low"), is_("low_mutation_rate").alias("low_mutation"), is_("low_coverage").alias("low_coverage"), is_("directory_not_found").alias("no_data"),
    )


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """mean, min, max and upper median (element n div 2 of the ordered values); zeros for none.

    The median is selected (operators/selection.py) by aggregations that run while the plan is made.
    """
    values = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    all_ = values.agg(zero(F.avg("v")).alias("mean"), zero(F.min("v")).alias("least"), zero(F.max("v")).alias("most"), F.count(F.lit(1)).alias("n"))
    n = all_.first()["n"]
    median = nth_value(values, "v", n // 2, n) if n else 0.0
    return all_.select("mean", "least", "most", F.lit(float(median)).alias("median"))


def coverage_union(lines: DataFrame) -> DataFrame:
    """Line coverage per seed over the union of lines of all test benches (seed, line, covered)."""
    merged = lines.groupBy("seed", "line").agg(F.bool_or("covered").alias("covered"))
    total, hit = F.count(F.lit(1)), F.count_if("covered")
    return merged.groupBy("seed").agg(total.alias("lines_total"), hit.alias("lines_covered"), F.coalesce(F.try_divide(hit.cast("double"), total.cast("double")), F.lit(0.0)).alias("coverage"))


def suite_rates(seeds: DataFrame, results: DataFrame) -> DataFrame:
    """Per seed: pass rate (0 without tests) and whether all passed (true without tests)."""
    rates = results.groupBy("uuid").agg(F.avg(F.col("passed").cast("int")).alias("rate"), F.every("passed").alias("every"), F.count(F.lit(1)).alias("n"))
    return seeds.select("uuid").join(rates, "uuid", "left").select("uuid", F.coalesce("n", F.lit(0)).alias("n_tests"), F.coalesce("rate", F.lit(0.0)).alias("pass_rate"), F.coalesce("every", F.lit(True)).alias("all_passed"))


def verified(claims: DataFrame, tests: DataFrame) -> DataFrame:
    """Claimed (uuid, passed) against actual passing (uuid, passed of each test); without tests a seed passes.

    A null claim is compared with nothing: it counts as consistent.
    """
    failed = tests.groupBy("uuid").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.coalesce("passed", F.lit(False))).alias("failed"))
    rows = claims.select("uuid", F.col("passed").alias("claimed")).join(failed, "uuid", "left").fillna(0, ["total", "failed"])
    rows = rows.withColumn("actual", F.col("failed") == 0)
    return rows.withColumn("consistent", F.coalesce(F.col("claimed") == F.col("actual"), F.lit(True)))
