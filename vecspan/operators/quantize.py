"""Product quantisation: subspaces, codebooks, codes and reconstruction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspan.functions.vectors import sqeuclidean


def subspaces(d: int, least: int = 2) -> int:
    """Number of equal parts of least dimensions or more: 16, 8, 4 or 2 if they divide d, else its largest such divisor."""
    fits = [m for m in (16, 8, 4, 2, *range(d // least, 0, -1)) if d % m == 0 and d // m >= least]
    return fits[0] if fits else 1


def parts(rows: DataFrame, m: int, d: int) -> DataFrame:
    """id, sub, part."""
    w = d // m
    return rows.select("id", F.posexplode(F.array(*[F.slice("features", k * w + 1, w) for k in range(m)])).alias("sub", "part"))


def train(rows: DataFrame, m: int, d: int, k: int = 256, seed: int = 42, iterations: int = 100, sample: int = 100_000) -> DataFrame:
    """codebook: sub, code, centroid, from k-means in each subspace over at most sample rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark, n = rows.sparkSession, rows.count()
    some = rows if n <= sample else rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)) < sample)
    p = parts(some, m, d).cache()
    book = []
    for s in range(m):
        model = KMeans(k=min(k, max(2, n)), seed=seed, maxIter=iterations, tol=1e-6, featuresCol="v").fit(p.where(F.col("sub") == s).select(array_to_vector("part").alias("v")))
        book += [(s, c, [float(x) for x in centre]) for c, centre in enumerate(model.clusterCenters())]
    p.unpersist()
    return spark.createDataFrame(book, "sub int, code int, centroid array<double>")


def encode(rows: DataFrame, codebook: DataFrame, m: int, d: int) -> DataFrame:
    """id, sub, code: the nearest centroid, the lowest code on ties. The codebook has at most 256 m rows."""
    book = codebook.groupBy("sub").agg(F.sort_array(F.collect_list(F.struct("code", "centroid"))).alias("book"))
    near = F.transform("book", lambda c: F.struct(sqeuclidean(F.col("part"), c["centroid"]).alias("d"), c["code"].alias("code")))
    return parts(rows, m, d).join(F.broadcast(book), "sub").select("id", "sub", F.array_min(near)["code"].alias("code"))


def reconstruct(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """id, features."""
    j = codes.join(F.broadcast(codebook), ["sub", "code"])
    return j.groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("sub", "centroid"))), lambda x: x["centroid"])).alias("features"))
