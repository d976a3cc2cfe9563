"""A sweep over levels that ends for a key at its first failure."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.sources.folders import written


def swept(outcomes: DataFrame, levels: Sequence[int], key: str = "key") -> DataFrame:
    """(key, level, ok, n): what a sweep over the levels, in this order, runs.

    outcomes: (key, level, ok), the recorded outcomes; a level is ok for a key where all of them are, a null one isn't. A
    key goes on to a level only from the one before, so each level reads the outcomes of the keys that are left; a level
    without an outcome ends the sweep, too. Each level is written, so that the next is pruned by what is known.
    """
    done: list[DataFrame] = []
    for level in levels:
        rows = outcomes.where(F.col("level") == level)
        if done:
            rows = rows.join(done[-1].where("ok").select(key), key, "left_semi")
        found = rows.groupBy(key).agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"), F.count(F.lit(1)).alias("n"))
        found = found.select(key, F.lit(level).alias("level"), "ok", "n")
        done.append(written(found))
        if done[-1].where("ok").isEmpty():
            break
    return reduce(DataFrame.unionByName, done)
