"""Exact order statistics without a total order.

A sketch of the values inside of an interval names two bounds close to the wanted rank; counting against them is exact.
Each pass leaves about a thousandth of the values that were in between, so that a handful of aggregations find the
element among any number of rows. Values that occur often are met as bounds and counted as such, so equal values end a
search instead of prolonging it. Nothing is sorted but at most FEW values at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Relative rank error of a sketch is 1 / ACCURACY.
ACCURACY = 5_000
#: Values that are ordered in one task.
FEW = 10_000


def nth_value(rows: DataFrame, value: str, rank: int, total: int) -> float | None:
    """The element of this rank, from 0, of the ordered non-null values, of which there are ``total``; null beyond them.

    NaN counts as the largest value.
    """
    if not 0 <= rank < total:
        return None
    values = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    low, high, below, size = None, None, 0, total  # strictly between low and high lie ``size`` values, ``below`` before them
    while size > FEW:
        inside = _between(values, low, high)
        near = (rank - below + 0.5) / size
        ends = [min(1.0, max(0.0, near - 2 / ACCURACY)), min(1.0, near + 2 / ACCURACY)]
        a, b = inside.agg(F.percentile_approx("v", F.array(*map(F.lit, ends)), F.lit(ACCURACY))).first()[0]
        v = F.col("v")
        n = inside.agg(F.count_if(v < a).alias("under"), F.count_if(v == a).alias("at_a"), F.count_if((v > a) & (v < b)).alias("between"), F.count_if(v == b).alias("at_b")).first()
        start = below
        parts = [("under", low, a), ("at_a", a, a), ("between", a, b), ("at_b", b, b)] if a != b else [("under", low, a), ("at_a", a, a)]
        for part, x, y in parts:
            if rank < start + n[part]:
                if part in ("at_a", "at_b"):
                    return x
                low, high, below, size = x, y, start, n[part]
                break
            start += n[part]
        else:  # above both bounds
            low, below, size = b, start, below + size - start
    few = _between(values, low, high).orderBy("v").limit(rank - below + 1)
    return few.agg(F.max("v")).first()[0]


def _between(values: DataFrame, low: float | None, high: float | None) -> DataFrame:
    found = values if low is None else values.where(F.col("v") > low)
    return found if high is None else found.where(F.col("v") < high)


def quantile(rows: DataFrame, value: str, share: float) -> float | None:
    """The element at floor(share x n) of the n ordered values, the last one for 1; null without values."""
    total = rows.agg(F.count(value)).first()[0]
    return nth_value(rows, value, min(int(share * total), total - 1), total) if total else None
