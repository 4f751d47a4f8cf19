"""Sinks: embeddings as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embedding_columns(embedding: DataFrame, components: int, digits: int = 6) -> DataFrame:
    """Dim1, Dim2 .. with a fixed number of decimals."""
    return embedding.orderBy("id").select(*[F.format_string(f"%.{digits}f", F.col("y")[k]).alias(f"Dim{k + 1}") for k in range(components)])


def write_embedding_csv(embedding: DataFrame, path: str, components: int = 2) -> None:
    embedding_columns(embedding, components).write.mode("overwrite").option("header", True).csv(path)


def write_labelled_csv(embedding: DataFrame, path: str, label: str | None = None) -> None:
    """x, y and the label, where there is one."""
    cols = [F.col("y")[0].alias("x"), F.col("y")[1].alias("y")] + ([F.col(label).alias("label")] if label else [])
    embedding.orderBy("id").select(*cols).write.mode("overwrite").option("header", True).csv(path)


def projections(points: DataFrame) -> DataFrame:
    """plane, u, v: the three orthogonal views of x, y, z."""
    views = F.array(*[F.struct(F.lit(a + b).alias("plane"), F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ("xy", "xz", "yz")])
    return points.select(F.explode(views).alias("p")).select("p.*")
