"""Running values along the rows of a key, for keys of any length.

A window over a key needs all its rows in one task. Here the rows are dealt by ranges of (key, order), so that a long key
lies in several blocks; each block is folded for itself, and only the keys that go over the border of a block (one or two
for each block) take along what the blocks before have come to. Folds are associative, so nothing else is needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.sources.folders import written

_BLOCK = "__block"


@dataclass(frozen=True)
class Fold:
    """A running value.

    kind: ``sum`` (nulls count 0), ``max``, ``min`` and ``last`` (nulls are passed over), or ``tail``: an array of the
    values of the last ``rows`` rows, nulls among them. ``before`` leaves the row itself out.
    """

    kind: str
    value: Column
    rows: int = 0
    before: bool = False

    def local(self, value: Column, by, own: bool) -> Column:
        """Within a block; own tells whether the row itself counts."""
        until = 0 if own else -1
        if self.kind == "tail":
            # Structs, as collect_list leaves nulls out.
            held = F.collect_list(F.struct(value.alias("v"))).over(by.rowsBetween(until - self.rows + 1, until))
            return F.transform(held, lambda x: x["v"])
        span = by.rowsBetween(W.unboundedPreceding, until)
        if self.kind == "last":
            return F.last(value, ignorenulls=True).over(span)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](value).over(span)

    def over_blocks(self, state: Column) -> Column:
        """What the blocks before a block have come to."""
        by = W.partitionBy("__key").orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
        if self.kind == "tail":
            return self._cut(F.flatten(F.collect_list(state).over(by)))
        if self.kind == "last":
            return F.last(state, ignorenulls=True).over(by)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](state).over(by)

    def _cut(self, values: Column) -> Column:
        return F.slice(values, F.greatest(F.size(values) - self.rows, F.lit(0)) + 1, F.lit(self.rows))

    def joined(self, carried: Column, local: Column) -> Column:
        if self.kind == "tail":
            return F.when(carried.isNull(), local).otherwise(self._cut(F.concat(carried, local)))
        if self.kind == "last":
            return F.coalesce(local, carried)
        if self.kind == "sum":
            return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
        return F.greatest(local, carried) if self.kind == "max" else F.least(local, carried)


def scanned(rows: DataFrame, keys: Sequence[str], order: Sequence[str], folds: Mapping[str, Fold], blocks: int | None = None) -> DataFrame:
    """rows and a column for each fold, along ``order``, which must tell the rows of a key apart; keys may be null.

    The rows are written once, as the blocks must be the same for all that reads them. Spark chooses how many there are
    unless ``blocks`` says so.
    """
    values = {f"__v_{name}": fold.value for name, fold in folds.items()}
    by_range = [*keys, *order]
    placed = rows.withColumns(values)
    placed = placed.repartitionByRange(blocks, *by_range) if blocks else placed.repartitionByRange(*by_range)
    placed = placed.withColumns({_BLOCK: F.spark_partition_id(), "__key": F.struct(*keys), "__at": F.struct(*order)})
    placed = written(placed)

    by = W.partitionBy("__key", _BLOCK).orderBy("__at")
    local = {f"__l_{name}": fold.local(F.col(f"__v_{name}"), by, not fold.before) for name, fold in folds.items()}
    found = placed.withColumns(local)
    # At most the first and the last key of a block lie in another one too.
    ends = placed.groupBy(_BLOCK).agg(F.array(F.min("__key"), F.max("__key")).alias("ends"))
    ends = ends.select(_BLOCK, F.explode(F.array_distinct("ends")).alias("__key"))
    spread = ends.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__key")
    states = {f"__l_{name}": fold.local(F.col(f"__v_{name}"), by, True) for name, fold in folds.items()}
    last = placed.join(F.broadcast(spread), "__key", "left_semi").withColumns(states).groupBy("__key", _BLOCK)
    last = last.agg(F.max_by(F.struct(*states), F.col("__at")).alias("s"))
    carries = {f"__c_{name}": fold.over_blocks(F.col(f"s.__l_{name}")) for name, fold in folds.items()}
    carried = last.select("__key", _BLOCK, *(c.alias(name) for name, c in carries.items()))
    # Two rows for each block of the range partitioning at most.
    both = found.join(F.broadcast(carried), ["__key", _BLOCK], "left")
    out = {name: fold.joined(F.col(f"__c_{name}"), F.col(f"__l_{name}")) for name, fold in folds.items()}
    return both.select(*rows.columns, *(c.alias(name) for name, c in out.items()))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "nth", **more: Fold) -> DataFrame:
    """rows with their number in the key, from 1, as an int, and further folds."""
    out = scanned(rows, keys, order, {name: Fold("sum", F.lit(1)), **more})
    return out.withColumn(name, F.col(name).cast("int"))



def joined_by(rows: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """rows joined with the further columns of side, where null keys are equal, too."""
    key = F.struct(*keys)
    return rows.withColumn("__by", key).join(side.withColumn("__by", key).drop(*keys), "__by", how).drop("__by")
