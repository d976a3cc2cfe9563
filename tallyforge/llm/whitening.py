"""Embedding whitening by the principal components of a fit list.

Entries become whole numbers, so the fit list (each distinct vector once), its length n and its sums S are exact. Its rows
are centred before anything is multiplied: with S = q n + r, an entry's deviation x - q is a whole number and r / n lies in
[0, 1), so one rounding is all that a centred entry has. ``RowMatrix.computeGramianMatrix`` sums the products where the
rows are; the driver decomposes one matrix of dimensions squared, and ``mapInPandas`` projects every row on what it gives.

Nulls and edge cases: rows whose vector is null or holds null or non-finite entries are dropped. A vector shorter than the
longest counts as 0 where it has no entry; where all are empty, or no row remains, there are no rows. Repeated rows each
get their own. A component without variance (one distinct vector, fewer of them than dimensions) has whitened 0 and doesn't
count in identity_error. Null keys are kept. A deviation of 2^63 or more, which takes some 10^7 distinct vectors or very
large entries, is null as a long; ``deviation_digits`` always has it. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import table, work_dir, written

SCALE, COMPONENTS = 256, 4
#: A component whose share of the variance is below this has none beyond rounding.
NO_VARIANCE = 1e-13


@dataclass
class Fit:
    """n, S = whole * n + rest by dimension, and the leading components with their variances."""

    n: int
    whole: list[int]
    rest: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = (x - np.array(self.whole, float)) - np.array(self.rest, float) / self.n
        there = self.variances > NO_VARIANCE * self.trace
        return np.where(there, centred @ self.vectors / np.sqrt(np.where(there, self.variances, 1.0)), 0.0)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum of (n x - S)^2 over the dimensions of each row, exactly."""
        apart = int(max(abs(int(v) - w) for ends in (x.min(axis=0), x.max(axis=0)) for v, w in zip(ends, self.whole, strict=True)))
        if len(self.whole) * (self.n * (apart + 1)) ** 2 < 1 << 63:
            d = self.n * (x - np.array(self.whole, np.int64)) - np.array(self.rest, np.int64)
            return (d * d).sum(axis=1).tolist()
        return [sum((self.n * (v - w) - r) ** 2 for v, w, r in zip(row, self.whole, self.rest, strict=True)) for row in x.tolist()]


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x) of the rows whose vector is whole and finite; x holds floor(256 c) of each entry c."""
    entries = F.col(f"`{vector}`")
    fine = entries.isNotNull() & F.forall(entries, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return rows.where(fine).select(F.col(f"`{key}`").alias("key"), F.transform(entries, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("x"))


def _padded(rows: DataFrame, size: int) -> DataFrame:
    entry = lambda i: F.coalesce(F.get("x", i), F.lit(0).cast("long"))
    return rows.withColumn("x", F.when(F.size("x") == size, F.col("x")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), entry)))


def fitted(points: DataFrame, size: int, components: int = COMPONENTS) -> Fit | None:
    """The fit over the distinct vectors ``x`` of points; only sums by dimension and one square matrix reach the driver."""
    n = points.count()
    if not n:
        return None
    sums = points.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    by = {row["i"]: int(row["s"]) for row in sums.toLocalIterator()}
    whole, rest = zip(*(divmod(by[i], n) for i in range(size)), strict=True)
    base, share = (F.array(*(F.lit(float(v)) for v in values)) for values in (whole, [r / n for r in rest]))
    centred = F.transform("x", lambda v, i: v.cast("double") - F.get(base, i) - F.get(share, i))
    vectors = MLUtils.convertVectorColumnsFromML(points.select(array_to_vector(centred).alias("v")), "v")
    gram = RowMatrix(vectors, n, size).computeGramianMatrix().toArray()
    variances, axes = np.linalg.eigh(gram / n)
    take = np.argsort(-variances, kind="stable")[:components]
    axes = axes[:, take]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(take))] < 0, -1.0, 1.0)
    return Fit(n, list(whole), list(rest), axes, np.maximum(variances[take], 0.0), float(np.trace(gram) / n))


def identity_error(points: DataFrame, fit: Fit) -> float:
    """The largest entry of the covariance of the whitened fit list minus the identity, from the rows themselves."""
    there = [k for k in range(len(fit.variances)) if fit.variances[k] > NO_VARIANCE * fit.trace]
    names = [f"w{k}" for k in there]
    if not names:
        return 0.0

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame(fit.whitened(np.stack(frame["x"].to_numpy()))[:, there], columns=names)

    white = points.mapInPandas(work, ", ".join(f"{c} double" for c in names))
    means = white.agg(*(F.avg(c).alias(c) for c in names)).first()
    centred = white.select(*((F.col(c) - means[c]).alias(c) for c in names))
    products = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    found = centred.agg(*(F.avg(F.col(a) * F.col(b)) for a, b in products)).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(found, products, strict=True))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each remaining row and component: key, component, n, deviation, whitened, explained, identity_error."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    points, folder = quantised(rows, key, vector), work_dir(rows.sparkSession)
    size = points.agg(F.max(F.size("x"))).first()[0] or 0
    schema = "key string, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"
    fit = None
    if size:
        points = _padded(points, size)
        fit_list = written(points.select("x").distinct(), folder, "fit")
        fit = fitted(fit_list, size, components)
    if fit is None:
        found = spark.createDataFrame([], schema)
    else:
        error = identity_error(fit_list, fit)
        found = points.select(F.col("key").cast("string").alias("key"), "x").mapInPandas(_projected(fit, error), schema)
    return found.select(F.col("key").cast(kind).alias(key), *(c for c in found.columns if c != "key"))


def _projected(fit: Fit, error: float):
    explained = [float(e / fit.trace) if fit.trace > 0 else 0.0 for e in fit.variances]
    m = len(explained)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["x"].to_numpy())
            exact = fit.deviations(x)
            longs = pd.array([d if d < 1 << 63 else None for d in exact], dtype="Int64")
            yield pd.DataFrame(
                {
                    "key": frame["key"].repeat(m).to_numpy(),
                    "component": np.tile(np.arange(1, m + 1, dtype=np.int32), len(frame)),
                    "n": fit.n,
                    "deviation": longs.repeat(m),
                    "whitened": fit.whitened(x).reshape(-1),
                    "explained": explained * len(frame),
                    "identity_error": error,
                    "deviation_digits": np.repeat([str(d) for d in exact], m),
                }
            )

    return work


def query(spark, sf_dir):
    """op12: all embeddings on their four leading components."""
    return whiten(table(spark, sf_dir, "embeddings"))
