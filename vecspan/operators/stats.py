"""Statistics of distances and the safety figures derived from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspan.session import Stash

LEVELS = ("Normal", "Unusual", "Mild", "Extreme", "NoMansLand")


def element(values: Column, share: float) -> Column:
    """Element floor(share n) of a sorted array, from 0."""
    return F.get(values, F.least(F.floor(F.size(values) * share), F.size(values) - 1).cast("int"))


def elements(d: DataFrame, col: str, ranks: dict[str, int]) -> dict[str, float]:
    """Elements at these ranks (from 0) of the sorted column: rows are dealt by ranges of values, counted by range, and only the
    ranges that hold a rank are sorted, so no task sees all rows."""
    spark = d.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = d.select(F.col(col).alias("x")).where(F.col(col).isNotNull()).repartitionByRange(parts, "x").withColumn("part", F.spark_partition_id())
    ranged = Stash(spark).cut(ranged, "ranged")
    counts = sorted((r["least"], r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("x").alias("least")).collect())  # a row for each range
    want, before = {}, 0
    for _, part, n in counts:
        want.update({name: (part, r - before) for name, r in ranks.items() if before <= r < before + n})
        before += n
    if not want:
        return dict.fromkeys(ranks)
    row = F.row_number().over(W.partitionBy("part").orderBy("x")) - 1
    held = ranged.where(F.col("part").isin([p for p, _ in want.values()])).withColumn("r", row)
    got = held.agg(*[F.max(F.when((F.col("part") == p) & (F.col("r") == r), F.col("x"))).alias(name) for name, (p, r) in want.items()]).first()
    return {name: got[name] if name in want else None for name in ranks}


def distance_stats(d: DataFrame, col: str = "dist") -> DataFrame:
    """One row: least, p95, p99, mean, deviation (population), mild (mean + 2.5 deviations), extreme (+ 4). Percentiles are
    elements of the sorted distances."""
    n = d.agg(F.count(col).alias("n"), F.min(col).alias("least"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("deviation")).first()
    total = n["n"]
    p = elements(d, col, {name: min(int(total * share), max(total - 1, 0)) for name, share in (("p95", 0.95), ("p99", 0.99))})
    mean, dev = n["mean"], n["deviation"]
    row = (n["least"], p["p95"], p["p99"], mean, dev, *(mean + k * dev if total else None for k in (2.5, 4.0)))
    return d.sparkSession.createDataFrame([row], ", ".join(f"{c} double" for c in ("least", "p95", "p99", "mean", "deviation", "mild", "extreme")))


def sampled_stats(rows: DataFrame, most: int = 2000, seed: int = 42) -> DataFrame:
    """distance_stats() of all pairs of at most most rows, chosen by hash: the figures where neighbours fail."""
    from vecspan.operators.local import distance_stats as of
    from vecspan.operators.sampling import random_rows

    t = random_rows(rows.select("id", "features"), most, seed).orderBy("id").toArrow()  # at most most rows
    x = np.array(t.column("features").to_pylist(), float).reshape(t.num_rows, -1)
    pairs = [np.sqrt(((x[k + 1 :] - x[k]) ** 2).sum(1)) for k in range(len(x) - 1)]
    figures = of(np.concatenate(pairs)) if len(pairs) else dict.fromkeys(("least", "p95", "p99", "mean", "deviation", "mild", "extreme"))
    return rows.sparkSession.createDataFrame([tuple(figures.values())], ", ".join(f"{c} double" for c in figures))


def first_rows_stats(rows: DataFrame, first: int = 1000) -> DataFrame:
    """distance_stats() of all pairs among the first rows by id: the figures where no neighbour lists exist."""
    from vecspan.functions.vectors import euclidean

    some = rows.orderBy("id").limit(first)
    a = some.select(F.col("id").alias("i"), F.col("features").alias("a"))
    b = some.select(F.col("id").alias("j"), F.col("features").alias("b"))
    return distance_stats(a.join(b, F.col("i") < F.col("j")).select(euclidean(F.col("a"), F.col("b")).alias("dist")))


def neighbor_summary(neighbors: DataFrame) -> DataFrame:
    return neighbors.groupBy("i").agg(F.min("dist").alias("nearest"), F.avg("dist").alias("mean_dist"))


def confidence(nearest: Column, p95: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(-nearest / (p95 + 1e-8))))


def outlier_level(nearest: Column, s: dict[str, Column]) -> Column:
    return F.when(nearest <= s["p95"], 0).when(nearest <= s["p99"], 1).when(nearest <= s["mild"], 2).when(nearest <= s["extreme"], 3).otherwise(4)


def percentile_rank(nearest: Column, p95: Column) -> Column:
    return F.coalesce(F.least(F.lit(99.0), F.try_divide(nearest, p95) * 95.0), F.lit(0.0))


def z_score(nearest: Column, mean: Column, deviation: Column) -> Column:
    return F.when(deviation > 1e-8, (nearest - mean) / deviation).otherwise(0.0)


def level_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), level + 1)


# Texts of the outlier levels.
QUALITY = (
    "Excellent - Very similar to training data",
    "Good - Somewhat similar to training data",
    "Caution - Mild outlier, projection may be less accurate",
    "Warning - Extreme outlier, projection unreliable",
    "Critical - Far from training data, projection highly unreliable",
)


def quality_text(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in QUALITY]), level + 1)


def safety(nearest: DataFrame, stats: dict[str, float]) -> DataFrame:
    """nearest (with its column nearest) plus confidence, outlier_level, percentile_rank, z_score, is_reliable."""
    s = {k: F.lit(v) for k, v in stats.items()}
    x = F.col("nearest")
    out = nearest.withColumn("confidence", confidence(x, s["p95"])).withColumn("outlier_level", outlier_level(x, s))
    out = out.withColumn("percentile_rank", percentile_rank(x, s["p95"])).withColumn("z_score", z_score(x, s["mean"], s["deviation"]))
    return out.withColumn("is_reliable", (F.col("outlier_level") <= 1) & (F.col("confidence") >= 0.3))


def safety_report(scored: DataFrame) -> DataFrame:
    """outlier_level, level, n, reliable, confidence's least, most and mean."""
    return scored.groupBy("outlier_level").agg(
        F.count("*").alias("n"), F.count_if("is_reliable").alias("reliable"), F.min("confidence").alias("least"), F.max("confidence").alias("most"), F.avg("confidence").alias("mean")
    ).withColumn("level", level_name(F.col("outlier_level")))


def interpolation(neighbors: DataFrame, embedding: DataFrame) -> DataFrame:
    """i, pos, y: means of the neighbours' places weighted by 1 / (distance + 1e-8)."""
    y = embedding.select(F.col("id").alias("j"), F.posexplode("y").alias("pos", "y"))
    w = neighbors.select("i", "j", (1.0 / (F.col("dist") + 1e-8)).alias("w"))
    return w.join(y, "j").groupBy("i", "pos").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"))
