"""Run results: keyed upsert, valid runs, Pass@1, Pass@k and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert_latest(log: DataFrame, keys: Sequence[str] = ("uuid", "run_index"), seq: str = "seq") -> DataFrame:
    """Keyed latest-write-wins over an append-only log: the row of largest seq for each key.

    max_by is combined before the shuffle, so a key that is delivered again and again costs one row for each map task.
    """
    rest = [c for c in log.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.col(seq)).alias("last")
    return log.groupBy(*keys).agg(last).select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))


def partial_update(base: DataFrame, updates: DataFrame, key: str, seq: str, columns: Sequence[str]) -> DataFrame:
    """Non-null values of updates overwrite, null ones keep: the last non-null value of each column by seq."""
    lasts = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"__{c}") for c in columns]
    merged = updates.groupBy(key).agg(*lasts)
    kept = [c for c in base.columns if c not in columns]
    return base.join(merged, key, "left").select(*kept, *(F.coalesce(f"__{c}", c).alias(c) for c in columns))


def with_end_time(updates: DataFrame, status: str = "status", at: str = "at") -> DataFrame:
    """updates with ``end_time``: the time of those that end a run, null for the others, so that an update keeps the last."""
    return updates.withColumn("end_time", F.when(F.col(status).isin("completed", "failed"), F.col(at)))


def valid_runs(runs: DataFrame) -> DataFrame:
    """Runs that ended and iterated at least once."""
    return runs.where("end_time IS NOT NULL AND end_time <> '' AND total_iterations > 0")


def is_first() -> Column:
    """Whether a run is run 0; a null index counts as 0."""
    return F.coalesce("run_index", F.lit(0)) == 0


def _of_first(column: str) -> Column:
    return F.min_by(F.col(column), F.coalesce("run_index", F.lit(0)))


def passk_per_seed(valid: DataFrame, k: int) -> DataFrame:
    """Any-of-k per seed; seeds without a valid run 0 are dropped.

    Security is any full security rate, whether or not that run passed functionally.
    """
    return (
        valid.groupBy("uuid")
        .agg(
            F.count(F.lit(1)).alias("actual_k"),
            F.bool_or("success").alias("functional_pass"),
            F.bool_or(F.col("s_rate") == 1.0).alias("security_pass"),
            F.max("f_rate").alias("best_f"),
            F.max("s_rate").alias("best_s"),
            F.count_if("success").alias("functional_passed_runs"),
            _of_first("success").alias("first_success"),
            _of_first("f_rate").alias("first_f"),
            _of_first("s_rate").alias("first_s"),
            _of_first("n_req").alias("n_req"),
            _of_first("total_iterations").alias("first_iterations"),
            F.bool_or(is_first()).alias("has_first"),
        )
        .where("has_first")
        .drop("has_first")
        .withColumn("requested_k", F.lit(k))
    )


def weighted_rate(rate: str, weight: str) -> Column:
    """Sum of rate x weight over the sum of weights; 0 for none."""
    return F.coalesce(F.try_divide(F.sum(F.col(rate) * F.col(weight)), F.sum(weight).cast("double")), F.lit(0.0))


def passk_summary(seeds: DataFrame, k: int) -> DataFrame:
    """One row over passk_per_seed, zeros without seeds; security is weighted by the number of requirements."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return seeds.agg(
        F.count(F.lit(1)).alias("total_seeds"),
        F.count_if(F.col("actual_k") == k).alias("seeds_with_full_k"),
        F.count_if((F.col("actual_k") > 0) & (F.col("actual_k") < k)).alias("seeds_degraded"),
        mean("actual_k").alias("avg_actual_k"),
        mean(F.col("first_success").cast("int")).alias("pass1_functional"),
        mean(F.col("functional_pass").cast("int")).alias("passk_functional"),
        weighted_rate("first_s", "n_req").alias("pass1_security"),
        weighted_rate("best_s", "n_req").alias("passk_security"),
        mean("first_iterations").alias("avg_iterations"),
    )


def run_summary(valid: DataFrame) -> DataFrame:
    """Means of the rates of the first and the final iteration, shares of runs with a full rate of each, and mean iterations.

    valid has first_f, first_s, f_rate and s_rate; a null rate counts as 0; all zeros without runs.
    """
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    rates = {"first_functional": "first_f", "first_security": "first_s", "final_functional": "f_rate", "final_security": "s_rate"}
    return valid.agg(
        F.count(F.lit(1)).alias("n_runs"),
        *(mean(F.coalesce(c, F.lit(0.0))).alias(f"avg_{name}") for name, c in rates.items()),
        *(mean((F.coalesce(c, F.lit(0.0)) == 1.0).cast("int")).alias(f"full_{name}") for name, c in rates.items()),
        mean("total_iterations").alias("avg_iterations"),
    )


def run_accounting(valid: DataFrame) -> DataFrame:
    """Completed runs, seeds with a run, and their ratio."""
    return valid.groupBy("uuid").count().agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("runs"), F.count(F.lit(1)).alias("seeds"), F.coalesce(F.avg("count"), F.lit(0.0)).alias("avg_k")
    )


def first_last(runs: DataFrame) -> DataFrame:
    """First and final rates and the number of iterations of each task, by index."""
    by = F.col("run_index")
    return runs.groupBy("uuid").agg(
        F.min_by("f_rate", by).alias("first_f"), F.max_by("f_rate", by).alias("final_f"), F.min_by("s_rate", by).alias("first_s"), F.max_by("s_rate", by).alias("final_s"), F.count(F.lit(1)).alias("iterations")
    )


def completed_seeds(runs: DataFrame, k: int) -> DataFrame:
    """Seeds with at least k different runs, run 0 among them."""
    return runs.groupBy("uuid").agg(F.countDistinct("run_index").alias("n_runs"), F.bool_or(is_first()).alias("has_first")).where((F.col("n_runs") >= k) & F.col("has_first")).select("uuid", "n_runs")


def expand_runs(cases: DataFrame, k: int) -> DataFrame:
    """Every case k times, run_index 0 to k - 1."""
    return cases.withColumn("run_index", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def initial_summary(cases: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """The result document before any run: how many cases are planned, no runs, and every metric 0."""
    return cases.groupBy(*by).agg(F.count(F.lit(1)).alias("n_planned"), F.lit(0).cast("long").alias("n_runs"), *(F.lit(0.0).alias(m) for m in metrics))
