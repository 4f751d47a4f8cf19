"""Input contract of the vector operators: id LONG, features ARRAY<DOUBLE>, no nulls, NaN or infinities, one width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def vectors(df: DataFrame, id_col: str = "vec_id", features_col: str = "embedding", *keep: str) -> DataFrame:
    """id, features (as doubles) and the columns to keep."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.transform(features_col, lambda x: x.cast("double")).alias("features"), *keep)


def pack(df: DataFrame, id_expr: Column, *cols: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Numeric columns as one feature vector."""
    return df.select(id_expr.cast("long").alias("id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("features"), *keep)


def validity(df: DataFrame, col: str = "features") -> DataFrame:
    """One row: rows, NaN, infinite and null cells, least and greatest finite cell, least and greatest width."""
    x = df.select(F.size(col).alias("w"), F.explode_outer(col).alias("x"))
    bad = F.isnan("x") | (F.abs("x") == float("inf"))
    cells = x.agg(
        F.count_if(F.isnan("x")).alias("n_nan"), F.count_if(F.abs("x") == float("inf")).alias("n_inf"), F.count_if(F.col("x").isNull()).alias("n_null"),
        F.min(F.when(~bad, F.col("x"))).alias("least"), F.max(F.when(~bad, F.col("x"))).alias("greatest"), F.min("w").alias("w_min"), F.max("w").alias("w_max"),
    )
    return cells


def check(df: DataFrame, width: int | None = None) -> tuple[int, int]:
    """(rows, width) of a valid input; raises ValueError otherwise. One aggregate job."""
    bad = F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    row = df.agg(F.count("*").alias("n"), F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi"), F.count_if(bad | F.col("features").isNull()).alias("bad")).first()
    if not row["n"]:
        raise ValueError("the input has no rows")
    if row["bad"]:
        raise ValueError(f"{row['bad']} rows hold null, NaN or infinite features")
    if row["lo"] != row["hi"] or not row["lo"]:
        raise ValueError(f"feature widths differ: {row['lo']} to {row['hi']}")
    if width is not None and row["hi"] != width:
        raise ValueError(f"expected {width} features, got {row['hi']}")
    return row["n"], row["hi"]


def with_position(df: DataFrame, col: str = "id") -> DataFrame:
    """Adds pos, the row's place 0..n-1 in the order of col, by a range exchange and per-partition counts: no single task
    sees all rows."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, col).withColumn("__part", F.spark_partition_id())
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()  # one row per partition
    ordered, at = sorted(counts, key=lambda r: r["lo"]), 0
    edges = []
    for r in ordered:
        edges.append((r["lo"], r["hi"], at))
        at += r["n"]
    bin_ = F.lit(0)
    for k, (lo, _, _) in enumerate(edges):
        bin_ = F.when(F.col(col) >= lo, F.lit(k)).otherwise(bin_)
    base = F.element_at(F.array(*[F.lit(e[2]).cast("long") for e in edges]), F.col("__bin") + 1) if edges else F.lit(0).cast("long")
    return df.withColumn("__bin", bin_).withColumn("pos", F.row_number().over(W.partitionBy("__bin").orderBy(col)) - 1 + base).drop("__bin")


def degenerate(df: DataFrame) -> DataFrame:
    """One row: rows, width, and whether there are too few rows, too few features, or no more rows than features."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("features")), F.lit(0)).alias("d"))
    n, d = F.col("n"), F.col("d")
    return row.select("n", "d", (n <= 1).alias("few_rows"), (d <= 1).alias("few_features"), (n <= d).alias("unstable"))
