"""Classification by weighted votes of neighbours, and reports on it. Inputs: neighbors (i, j, rank, dist), labels (id, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def votes(neighbors: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """i, label, p: shares of the weights 1 / (1 + d / dmax); dmax of 0 counts as 1."""
    n = neighbors.where(F.col("rank") <= k) if k else neighbors
    most = F.max("dist").over(W.partitionBy("i"))
    n = n.withColumn("w", 1.0 / (1.0 + F.col("dist") / F.when(most > 0, most).otherwise(1.0)))
    per = n.join(labels.select(F.col("id").alias("j"), "label"), "j").groupBy("i", "label").agg(F.sum("w").alias("w"))
    return per.withColumn("p", F.col("w") / F.sum("w").over(W.partitionBy("i"))).select("i", "label", "p")


def classify(neighbors: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """id, true_label, predicted, confidence, is_correct; ties go to the lowest label."""
    v = votes(neighbors, labels, k)
    rank = F.row_number().over(W.partitionBy("i").orderBy(F.desc(F.round("p", 12)), "label"))
    best = v.withColumn("r", rank).where("r = 1").select(F.col("i").alias("id"), F.col("label").alias("predicted"), F.col("p").alias("confidence"))
    return best.join(labels.select("id", F.col("label").alias("true_label")), "id").withColumn("is_correct", F.col("predicted") == F.col("true_label"))


def probabilities(neighbors: DataFrame, labels: DataFrame) -> DataFrame:
    """id, probs MAP<label, p>."""
    return votes(neighbors, labels).groupBy(F.col("i").alias("id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "p")))).alias("probs"))


def report(c: DataFrame) -> DataFrame:
    """One row: rows, accuracy, mean confidence of right and wrong, confident (> 0.8) and doubtful (< 0.6) rows."""
    ok, p = F.col("is_correct"), F.col("confidence")
    return c.agg(
        F.count("*").alias("n"), F.avg(ok.cast("double")).alias("accuracy"), F.avg(F.when(ok, p)).alias("right_confidence"), F.avg(F.when(~ok, p)).alias("wrong_confidence"),
        F.count_if(p > 0.8).alias("confident"), F.count_if(p < 0.6).alias("doubtful"),
    )


def confusion(c: DataFrame) -> DataFrame:
    return c.groupBy("true_label", "predicted").agg(F.count("*").alias("n"))


def most_confused(c: DataFrame, top: int = 5) -> DataFrame:
    """The top wrong (true, predicted) pairs."""
    return confusion(c.where(~F.col("is_correct"))).orderBy(F.desc("n"), "true_label", "predicted").limit(top)


def difficult(neighbors: DataFrame, labels: DataFrame, k: int = 10, wide: int = 15, least: float = 0.3) -> DataFrame:
    """id, true_label, predicted, p_true: wrong by k neighbours (more than 3), and under least for the true label by wide."""
    wrong = classify(neighbors, labels, k).where(~F.col("is_correct"))
    enough = neighbors.where(F.col("rank") <= k).groupBy("i").agg(F.count("*").alias("n")).where("n > 3").select(F.col("i").alias("id"))
    p = votes(neighbors, labels, wide).select(F.col("i").alias("id"), F.col("label").alias("true_label"), F.col("p").alias("p_true"))
    out = wrong.join(enough, "id").join(p, ["id", "true_label"], "left").withColumn("p_true", F.coalesce("p_true", F.lit(0.0)))
    return out.where(F.col("p_true") < least).select("id", "true_label", "predicted", "p_true")


def pages(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """rows with page (from 0) and place on it, ordered per true label first."""
    at = F.row_number().over(W.partitionBy().orderBy(*order)) - 1
    return rows.withColumn("at", at).withColumn("page", F.floor(F.col("at") / size)).withColumn("place", F.col("at") % size).drop("at")
