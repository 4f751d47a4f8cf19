"""Normalisation: global and per-column aggregates, and the expressions that apply them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspan.functions.vectors import norm


def global_minmax(df: DataFrame) -> DataFrame:
    """xmin, xmax over all cells."""
    return df.agg(F.min(F.array_min("features")).alias("xmin"), F.max(F.array_max("features")).alias("xmax"))


def cells(df: DataFrame) -> DataFrame:
    """id, pos, x: one row per cell."""
    return df.select("id", F.posexplode("features").alias("pos", "x"))


def column_summary(df: DataFrame) -> DataFrame:
    """pos, minimum, maximum, mean, deviation (population) of every column."""
    return cells(df).groupBy("pos").agg(F.min("x").alias("minimum"), F.max("x").alias("maximum"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))


@dataclass(frozen=True)
class Scaling:
    """x -> (x - xmin) / xmax - mean of its column. Division is by the maximum, not the range. With axes (one row per
    column): x - mean, projected on them."""

    xmin: float
    xmax: float
    means: tuple[float, ...]
    axes: tuple[tuple[float, ...], ...] | None = None

    def on(self, x: np.ndarray) -> np.ndarray:
        means = np.array(self.means)
        return (x - means) @ np.array(self.axes) if self.axes else (x - self.xmin) / self.xmax - means

    def apply(self, features: Column) -> Column:
        means = F.array(*[F.lit(m) for m in self.means])
        return F.zip_with(F.transform(features, lambda x: (x - self.xmin) / self.xmax), means, lambda x, m: x - m)


def fit_scaling(df: DataFrame) -> Scaling:
    """Two aggregates of fixed size: extremes, then column means of the scaled data."""
    lo, hi = global_minmax(df).first()
    if hi == lo == 0 or hi == 0:
        raise ValueError("the largest value is 0, so the data cannot be scaled by it")
    means = cells(df).groupBy("pos").agg(F.avg((F.col("x") - lo) / hi).alias("m")).orderBy("pos").collect()
    return Scaling(lo, hi, tuple(r["m"] for r in means))


def minmax_center(df: DataFrame, scaling: Scaling | None = None) -> DataFrame:
    scaling = scaling or fit_scaling(df)
    if not scaling.axes:
        return df.withColumn("features", scaling.apply(F.col("features")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = b.column("features").flatten().to_numpy(zero_copy_only=False)
                out = scaling.on(flat.reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))], ["id", "features"])

    return df.select("id", "features").mapInArrow(run, "id long, features array<double>")


def fit_projection(df: DataFrame, k: int) -> Scaling:
    """Centring and projection on the first k principal components."""
    means, axes = principal_axes(df, k)
    return Scaling(0.0, 1.0, tuple(means), tuple(map(tuple, axes)))


def l2_normalize(df: DataFrame) -> DataFrame:
    """Rows of unit length; rows shorter than 1e-8 stay."""
    n = norm(F.col("features"))
    return df.withColumn("features", F.transform("features", lambda x: x / F.when(n < 1e-8, 1.0).otherwise(n)))


def zscore(df: DataFrame) -> DataFrame:
    """Columns of mean 0 and population deviation 1; constant columns become 0."""
    stats = [(r["mean"], r["deviation"]) for r in column_summary(df).orderBy("pos").collect()]  # one row per column
    m, s = F.array(*[F.lit(a) for a, _ in stats]), F.array(*[F.lit(b if b > 0 else 1.0) for _, b in stats])
    return df.withColumn("features", F.zip_with(F.zip_with("features", m, lambda x, a: x - a), s, lambda x, b: x / b))


def seeded_zscore(df: DataFrame) -> DataFrame:
    """The index's own variant: deviations are sqrt((1 + sum of squares) / (n - 1))."""
    row = df.count()
    stats = cells(df).groupBy("pos").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v")).orderBy("pos").collect()
    m = F.array(*[F.lit(r["m"]) for r in stats])
    s = F.array(*[F.lit(((1 + r["v"] * row) / (row - 1)) ** 0.5) for r in stats])
    return df.withColumn("features", F.zip_with(F.zip_with("features", m, lambda x, a: x - a), s, lambda x, b: x / b))


def standardize(df: DataFrame) -> DataFrame:
    """All cells together to mean 0 and variance 1."""
    r = cells(df).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    return df.withColumn("features", F.transform("features", lambda x: (x - r["m"]) / (r["s"] or 1.0)))


def binarize(df: DataFrame, cut: float = 0.5) -> DataFrame:
    return df.withColumn("features", F.transform("features", lambda x: F.when(x > cut, 1.0).otherwise(0.0)))


#: Normalisation by metric: 2 unit rows, 0 none, 4 binary, 1 column z-scores.
def mode_for(metric: str) -> int:
    return {"cosine": 2, "correlation": 0, "hamming": 4}.get(metric, 1)


def normalize_for(df: DataFrame, metric: str) -> DataFrame:
    return {2: l2_normalize, 0: lambda x: x, 4: binarize, 1: seeded_zscore}[mode_for(metric)](df)


def principal_axes(df: DataFrame, k: int) -> tuple[list[float], list[list[float]]]:
    """Column means, and the first k principal axes as one row per column."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    means = [r["mean"] for r in column_summary(df).orderBy("pos").collect()]
    m = F.array(*[F.lit(x) for x in means])
    centred = df.select(array_to_vector(F.zip_with("features", m, lambda x, a: x - a)).alias("v"))
    axes = PCA(k=k, inputCol="v", outputCol="p").fit(centred).pc.toArray()
    sign = np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])  # the largest entry of an axis is positive
    return means, (axes * np.where(sign == 0, 1, sign)).tolist()


def pca(df: DataFrame, k: int) -> DataFrame:
    """Scores of the first k principal components (columns centred first)."""
    return minmax_center(df, fit_projection(df, k))


def reduced(df: DataFrame, width: int, metric: str = "euclidean", most: int = 100) -> DataFrame:
    """df with at most most dimensions: principal components beyond that, unless the metric is hamming."""
    return pca(df, most) if width > most and metric != "hamming" else df


def data_checks(df: DataFrame) -> DataFrame:
    """One row: share of cells that are 0 or 1, constant columns, cells that are NaN or infinite, variance of all cells."""
    per = cells(df).groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_if(F.col("x").isin(0.0, 1.0)).alias("bin"), F.count("*").alias("n"), F.count_if(F.isnan("x") | (F.abs("x") == float("inf"))).alias("bad"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    n = F.sum("n")
    return per.agg((F.sum("bin") / n).alias("binary_share"), F.count_if(F.col("lo") == F.col("hi")).alias("constant_columns"), F.sum("bad").alias("bad_cells"), (F.sum("q") / n - F.pow(F.sum("s") / n, 2)).alias("variance"))
