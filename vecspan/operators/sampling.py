"""Deterministic samples of rows. rows: id and more; pos is the row's place in id order (frame.with_position)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspan.functions.vectors import hash_draw


def prefix(rows: DataFrame, m: int) -> DataFrame:
    return rows.where(F.col("pos") < m)


def slice_rows(rows: DataFrame, start: int, count: int) -> DataFrame:
    return rows.where(F.col("pos").between(start, start + count - 1))


def evenly(rows: DataFrame, n: int, m: int) -> DataFrame:
    """m rows at places floor(i n / m), with their order at."""
    at = rows.sparkSession.range(m).select(F.col("id").alias("at"), F.least(F.floor(F.col("id") * n / m), F.lit(n - 1)).alias("pos"))
    return rows.join(at, "pos")


def random_rows(rows: DataFrame, m: int, seed: int = 42) -> DataFrame:
    """The m rows of least hash: a global top k, one short list per task."""
    return rows.withColumn("h", hash_draw(str(seed), F.col("id"))).orderBy("h", "id").limit(m).drop("h")


def stratified(rows: DataFrame, per: int, label: str = "label", seed: int = 42) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(label).orderBy(hash_draw(str(seed), F.col("id")), "id"))
    return rows.withColumn("r", rank).where(F.col("r") <= per).drop("r")


def with_replacement(rows: DataFrame, n: int, m: int, seed: int = 42) -> DataFrame:
    """m draws: at, and the row at the place drawn."""
    at = rows.sparkSession.range(m).select(F.col("id").alias("at"), F.pmod(hash_draw(str(seed), "draw", F.col("id")), F.lit(n)).alias("pos"))
    return rows.join(at, "pos")
