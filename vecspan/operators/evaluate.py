"""Measures of embeddings: y columns are ARRAY<DOUBLE>, labels beside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspan.functions.vectors import euclidean, norm
from vecspan.operators import knn


def same_label_nearest(rows: DataFrame, broadcast_bytes: int = knn.BROADCAST_BYTES) -> DataFrame:
    """i, j, dist: the nearest row of the same label of each row that has one. rows: id, y, label."""
    own = rows.select("id", F.col("y").alias("features"), "label")
    n, d = knn.base_size(own)
    if 8 * n * d > broadcast_bytes:
        return knn._knn_nested(own, own, 8 * n * d, 1, "euclidean", True, by="label").select("i", "j", "dist")
    t = own.orderBy("label", "id").toArrow()
    at: dict = {}
    for k, label in enumerate(t.column("label").to_pylist()):
        at.setdefault(label, []).append(k)
    base = (t.column("id").to_numpy(), knn.matrix(t.column("features").combine_chunks()) if n else np.zeros((0, 0)), {k: np.array(v) for k, v in at.items() if k is not None})
    shared = rows.sparkSession.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, groups = shared.value
        for batch in batches:
            labels = batch.column("label").to_pylist()
            for label in {v for v in labels if v is not None}:
                pick = batch.filter(pa.array([v == label for v in labels]))
                b = groups[label]
                i, j, dist = knn.top_k(pick.column("id").to_numpy(), knn.matrix(pick.column("features")), ids[b], x[b], 1, "euclidean", True)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(dist)], ["i", "j", "dist"])

    return own.mapInArrow(run, knn.SCHEMA)


def same_label_quality(rows: DataFrame) -> DataFrame:
    """One row: mean over rows of the distance to the nearest row of the same label. rows: id, y, label."""
    return same_label_nearest(rows).agg(F.avg("dist").alias("quality"))


def within_between(rows: DataFrame) -> DataFrame:
    """same, n, mean: mean distance of pairs within and between labels."""
    a = rows.select(F.col("id").alias("i"), F.col("y").alias("a"), F.col("label").alias("la"))
    b = rows.select(F.col("id").alias("j"), F.col("y").alias("b"), F.col("label").alias("lb"))
    return a.join(b, F.col("i") < F.col("j")).groupBy((F.col("la") == F.col("lb")).alias("same")).agg(F.count("*").alias("n"), F.avg(euclidean(F.col("a"), F.col("b"))).alias("mean"))


def spread(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(norm(F.col("y"))).alias("spread"))


def compare(a: DataFrame, b: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """One row: mean squared and largest absolute difference of two embeddings' cells, cells that differ by more."""
    x = a.select("id", F.posexplode("y").alias("pos", "p"))
    y = b.select("id", F.posexplode("y").alias("pos", "q"))
    d = F.col("p") - F.col("q")
    return x.join(y, ["id", "pos"]).agg(F.avg(d * d).alias("mse"), F.max(F.abs(d)).alias("most"), F.count_if(F.abs(d) > tolerance).alias("n_differ"), F.avg(F.abs(d)).alias("mean_diff"))


def histogram(rows: DataFrame, col: str = "label") -> DataFrame:
    """label, n, percent."""
    total = rows.agg(F.count("*").alias("t"))
    return rows.groupBy(col).agg(F.count("*").alias("n")).withColumn("percent", F.col("n") * 100.0 / total.scalar())


def ranges(rows: DataFrame, *cols: str) -> DataFrame:
    """axis, least, most, span."""
    s = F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("x")) for c in cols])
    return rows.select(F.explode(s).alias("s")).groupBy("s.axis").agg(F.min("s.x").alias("least"), F.max("s.x").alias("most")).withColumn("span", F.col("most") - F.col("least"))


def sweep_summary(results: DataFrame) -> DataFrame:
    """One row: parameter of best (least) quality, its quality, least and most seconds. results: param, quality, seconds."""
    return results.agg(F.min_by("param", "quality").alias("best"), F.min("quality").alias("quality"), F.min("seconds").alias("fastest"), F.max("seconds").alias("slowest"))
