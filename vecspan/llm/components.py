"""Connected components of an edge table by alternating large-star and small-star rounds, wholly in DataFrames.

Every round's edges are written to shared storage, so no lineage grows and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspan.llm.common import Stash


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    out = both.join(least, F.col("u") == F.col("k")).where(F.col("v") > F.col("u"))
    return out.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    linked = down.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def components(edges: DataFrame, stash: Stash | None = None) -> DataFrame:
    """v, component (the least vertex reachable) of every vertex of edges (u, v) that is not itself the least. Rounds
    go on until one changes nothing; their number grows with the logarithm of the vertices."""
    stash = stash or Stash(edges.sparkSession)
    now = stash.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark, last = _mark(now), None
    while mark[0] and mark != last:
        star = _large_star(now).where("u <> v").distinct()
        now = stash.cut(_small_star(star).where("u <> v").distinct(), "edges")
        last, mark = mark, _mark(now)
    return now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("component"))
