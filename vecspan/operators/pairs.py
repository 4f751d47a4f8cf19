"""Near, mid-range and far pairs of rows, and reports about them.

Pairs are i, j, kind (0 near, 1 mid-range, 2 far). Randomness is a counter-based hash of (seed, row, draw), so samples
do not depend on partitioning. Positions 0..n-1 are drawn; ids that are not contiguous get positions first
(frame.with_position). Draws are made per row and joined once, so no row ever meets all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspan.functions.vectors import distance, hash_draw
from vecspan.session import Stash

NEAR, MID, FAR = 0, 1, 2
EXTRA = 50
CANDIDATES = 6


def local_scale(neighbors: DataFrame) -> DataFrame:
    """i, sigma: the mean distance of ranks 4 to 6, at least 1e-10; shorter lists use what they have."""
    s = neighbors.groupBy("i").agg(
        F.avg(F.when(F.col("rank").between(4, 6), F.col("dist"))).alias("m"), F.max("rank").alias("n"), F.max_by("dist", "rank").alias("last"), F.avg(F.when(F.col("rank") >= 4, F.col("dist"))).alias("tail")
    )
    sigma = F.when(F.col("n") < 3, 1.0).when(F.col("n") >= 6, F.col("m")).otherwise(F.coalesce("tail", "last"))
    return s.select("i", F.greatest(sigma, F.lit(1e-10)).alias("sigma"))


def scaled(neighbors: DataFrame) -> DataFrame:
    """neighbors plus scaled = dist^2 / (sigma_i sigma_j)."""
    sigma = local_scale(neighbors)
    other = sigma.select(F.col("i").alias("j"), F.col("sigma").alias("sigma_j"))
    return neighbors.join(sigma, "i").join(other, "j").withColumn("scaled", F.col("dist") * F.col("dist") / (F.col("sigma") * F.col("sigma_j"))).select("i", "j", "rank", "dist", "scaled")


def near_pairs(neighbors: DataFrame, k: int) -> DataFrame:
    """The k pairs of each row with the least scaled distance. neighbors holds more than k per row (k + EXTRA)."""
    rank = F.row_number().over(W.partitionBy("i").orderBy("scaled", "j"))
    return scaled(neighbors).withColumn("r", rank).where(F.col("r") <= k).select("i", "j", F.lit(NEAR).alias("kind"))


def draws(rows: DataFrame, n: int, count: int, seed: int, what: str) -> DataFrame:
    """i, t, j: the distinct rows other than i among count draws, t the first draw that gave them."""
    drawn = rows.select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("t"))
    drawn = drawn.withColumn("j", F.pmod(hash_draw(str(seed), what, F.col("i"), F.col("t")), F.lit(n)))
    return drawn.where(F.col("i") != F.col("j")).groupBy("i", "j").agg(F.min("t").alias("t"))


def far_pairs(rows: DataFrame, near: DataFrame, n: int, count: int, seed: int = 42, oversample: int = 4) -> DataFrame:
    """count random pairs of each row that are not near pairs of it."""
    tries = count * oversample + 16
    left = draws(rows, n, tries, seed, "far").join(near.select("i", "j"), ["i", "j"], "left_anti")
    rank = F.row_number().over(W.partitionBy("i").orderBy("t"))
    return left.withColumn("r", rank).where(F.col("r") <= count).select("i", "j", F.lit(FAR).alias("kind"))


def mid_pairs(rows: DataFrame, n: int, count: int, seed: int = 42, metric: str = "euclidean", oversample: int = 2) -> DataFrame:
    """count pairs of each row, each the second nearest of six random rows; no row is a candidate twice."""
    if count and n - 1 < CANDIDATES:
        raise ValueError(f"mid-range pairs need more than {CANDIDATES} rows")
    count = min(count, (n - 1) // CANDIDATES)
    tries = count * CANDIDATES * oversample + 16
    place = F.row_number().over(W.partitionBy("i").orderBy("t")) - 1
    cand = draws(rows, n, tries, seed, "mid").withColumn("at", place).where(F.col("at") < count * CANDIDATES).withColumn("slot", F.floor(F.col("at") / CANDIDATES))
    x = rows.select(F.col("id").alias("i"), F.col("features").alias("a"))
    y = rows.select(F.col("id").alias("j"), F.col("features").alias("b"))
    measured = cand.join(x, "i").join(y, "j").withColumn("dist", distance(metric)(F.col("a"), F.col("b")))
    rank = F.row_number().over(W.partitionBy("i", "slot").orderBy("dist", "j"))
    return measured.withColumn("r", rank).where("r = 2").select("i", "j", F.lit(MID).alias("kind"))


def all_pairs(near: DataFrame, mid: DataFrame, far: DataFrame) -> DataFrame:
    return near.unionByName(mid).unionByName(far)


def shared_pairs(rows: DataFrame, n: int, counts, extra: int, metric: str, seed: int) -> DataFrame:
    """i, j, kind: the same pairs as of near_pairs, mid_pairs and far_pairs, of a table (ids are positions) that all tasks
    share: a row's list, draws and choice stay in one task, so nothing is exchanged. Lists are found once; the scales
    of all rows are shared before pairs are chosen."""
    from vecspan.operators import knn, local

    spark, k = rows.sparkSession, min(counts.near + extra, n - 1)

    def listed(i: np.ndarray, j: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.arange(0, j.size + 1, j.shape[1]), pa.int32())
        cols = [pa.array(i), pa.array(local.local_scale(dist)), pa.ListArray.from_arrays(ends, pa.array(j.ravel())), pa.ListArray.from_arrays(ends, pa.array(dist.ravel()))]
        return pa.RecordBatch.from_arrays(cols, ["i", "sigma", "j", "dist"])

    lists = Stash(spark).cut(knn.knn_lists(rows, k, metric, listed, "i long, sigma double, j array<long>, dist array<double>"), "lists")
    scales = lists.select("i", "sigma").toArrow()
    sigma = np.empty(n)
    sigma[scales.column("i").to_numpy()] = scales.column("sigma").to_numpy()
    shared = spark.sparkContext.broadcast((knn._collect(rows)[1], sigma))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, sigma = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, local.STEP):
                part = batch.slice(at, local.STEP)
                i = part.column("i").to_numpy()
                j, dist = (part.column(c).flatten().to_numpy().reshape(len(i), -1) for c in ("j", "dist"))
                near = local.near_pairs(j, dist, counts.near, sigma)
                made = [(np.repeat(i, near.shape[1]), near.ravel())]
                made.append(local.mid_pairs(x, counts.mid, seed, metric, rows=i) if counts.mid else (i[:0], i[:0]))
                made.append(local.far_pairs([set(r) for r in near.tolist()], n, counts.far, seed, rows=i) if counts.far else (i[:0], i[:0]))
                a, b = (np.concatenate([m[c] for m in made]) for c in (0, 1))
                kind = np.repeat(np.array([NEAR, MID, FAR], np.int32), [len(m[0]) for m in made])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(kind)], ["i", "j", "kind"])

    return lists.select("i", "j", "dist").mapInArrow(run, "i long, j long, kind int")


def valid(pairs: DataFrame, n: int) -> DataFrame:
    inside = (F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("i") < n) & (F.col("j") < n)
    return pairs.where(inside & (F.col("i") != F.col("j")) & F.col("kind").between(0, 2))


def undirected(pairs: DataFrame) -> DataFrame:
    """One pair of each unordered two, the one of the lowest kind and then lowest i."""
    rank = F.row_number().over(W.partitionBy(F.least("i", "j"), F.greatest("i", "j")).orderBy("kind", "i", "j"))
    return pairs.withColumn("r", rank).where("r = 1").select("i", "j", "kind")


def counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("kind").agg(F.count("*").alias("n"))


def quality(pairs: DataFrame, n: int) -> DataFrame:
    """One row: pairs by kind, self pairs, pairs out of bounds, percentage of rows that occur as i and as j."""
    return pairs.agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(("near", "mid", "far"))],
        F.count_if(F.col("i") == F.col("j")).alias("n_self"),
        F.count_if((F.col("i") < 0) | (F.col("j") < 0) | (F.col("i") >= n) | (F.col("j") >= n)).alias("n_outside"),
        (F.count_distinct("i") * 100.0 / n).alias("i_coverage"),
        (F.count_distinct("j") * 100.0 / n).alias("j_coverage"),
    )


def with_distance(pairs: DataFrame, rows: DataFrame, metric: str = "euclidean") -> DataFrame:
    x = rows.select(F.col("id").alias("i"), F.col("features").alias("a"))
    y = rows.select(F.col("id").alias("j"), F.col("features").alias("b"))
    return pairs.join(x, "i").join(y, "j").select("i", "j", "kind", distance(metric)(F.col("a"), F.col("b")).alias("dist"))


def distance_distribution(pairs: DataFrame, rows: DataFrame, metric: str = "euclidean") -> DataFrame:
    d = with_distance(pairs, rows, metric)
    return d.groupBy("kind").agg(F.min("dist").alias("least"), F.max("dist").alias("most"), F.avg("dist").alias("mean"), F.stddev_pop("dist").alias("deviation"))


def ordered_kinds(distribution: DataFrame) -> DataFrame:
    """One row: whether mean distances rise from near over mid-range to far."""
    m = [F.max(F.when(F.col("kind") == k, F.col("mean"))) for k in range(3)]
    return distribution.agg(((m[0] < m[1]) & (m[1] < m[2])).alias("ordered"))


def coverage(pairs: DataFrame) -> DataFrame:
    """kind, distinct rows that occur in it, most pairs of one row."""
    ends = pairs.select("kind", F.explode(F.array("i", "j")).alias("id"))
    per = ends.groupBy("kind", "id").agg(F.count("*").alias("degree"))
    return per.groupBy("kind").agg(F.count("*").alias("n_rows"), F.max("degree").alias("most"))


def anomalies(pairs: DataFrame, degree: int = 50) -> DataFrame:
    """One row: unordered pairs that occur more than once, rows in more than degree pairs."""
    twice = pairs.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    busy = pairs.select(F.explode(F.array("i", "j")).alias("id")).groupBy("id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > degree).alias("busy"))
    return twice.withColumn("busy", busy.scalar())


def distance_percentiles(rows: DataFrame, metric: str = "euclidean", first: int = 1000) -> DataFrame:
    """p25, p75, p90 of the distances among the first rows by id, taken as elements of the sorted list."""
    some = rows.orderBy("id").limit(first)
    a = some.select(F.col("id").alias("i"), F.col("features").alias("a"))
    b = some.select(F.col("id").alias("j"), F.col("features").alias("b"))
    d = a.join(b, F.col("i") < F.col("j")).select(distance(metric)(F.col("a"), F.col("b")).alias("d")).agg(F.sort_array(F.collect_list("d")).alias("d"))
    return d.select(*[F.get("d", F.floor(F.size("d") * p).cast("int")).alias(f"p{int(p * 100)}") for p in (0.25, 0.75, 0.9)])


def band_pairs(rows: DataFrame, n: int, count: int, low: float, high: float, seed: int = 42, metric: str = "euclidean") -> DataFrame:
    """Random unordered pairs whose distance lies in [low, high], from count draws per row."""
    d = draws(rows, n, count, seed, "band").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct().withColumn("kind", F.lit(MID))
    return with_distance(d, rows, metric).where(F.col("dist").between(low, high)).select("i", "j", "dist")


def near_resampled_far(rows: DataFrame, embedding: DataFrame, old: DataFrame, n: int, count: int, limit: float, seed: int = 42, tries: int = 100) -> DataFrame:
    """Far pairs drawn anew among rows close in the embedding (at most limit); slots that find none keep their old pair."""
    d = draws(rows, n, tries, seed, "close")
    x = embedding.select(F.col("id").alias("i"), F.col("y").alias("a"))
    y = embedding.select(F.col("id").alias("j"), F.col("y").alias("b"))
    close = d.join(x, "i").join(y, "j").where(distance("euclidean")(F.col("a"), F.col("b")) <= limit)
    slot = F.row_number().over(W.partitionBy("i").orderBy("t"))
    new = close.withColumn("slot", slot).where(F.col("slot") <= count).select("i", "slot", F.col("j").alias("new_j"))
    kept = old.where(F.col("kind") == FAR).withColumn("slot", F.row_number().over(W.partitionBy("i").orderBy("j")))
    return kept.join(new, ["i", "slot"], "left").select("i", F.coalesce("new_j", "j").alias("j"), F.lit(FAR).alias("kind"))
