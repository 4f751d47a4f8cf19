"""Nearest-neighbour joins: exact (SQL, broadcast blocks, nested blocks), inverted-file approximation, and their variants.

Results are i, j, rank (from 1), dist, ordered by (dist, j). exact_sql is one declarative plan up to SQL_PAIRS pairs and
for conditions of the caller; larger inputs take the blocks. exact_block ships the base to the tasks when its size, which is checked, is under BROADCAST_BYTES; beyond
that base and queries meet block by block on a block number, each pair of blocks yields its top k, and a grouped
top k merges them. ivf probes cells of a k-means and re-ranks exactly, block by block within a cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspan.functions.vectors import distance

BROADCAST_BYTES = 256 << 20
#: Bytes of a block where base and queries meet block by block: each table is copied once for each block of the other.
BLOCK_BYTES = 64 << 20
#: Pairs up to which the declarative form is run as it stands.
SQL_PAIRS = 1 << 20
SCHEMA = "i long, j long, dist double"


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def pair_distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Row-wise distances of two equally long matrices."""
    if metric == "correlation":
        a, b, metric = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True), "cosine"
    if metric in ("cosine", "angular"):
        na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
        zero = (na < 1e-10) | (nb < 1e-10)
        c = np.clip((a * b).sum(1) / np.where(zero, 1.0, na * nb), -1, 1)
        c = np.where(zero, 0.0, c)
        return 1 - c if metric == "cosine" else np.sqrt(np.maximum(2 - 2 * c, 0))
    if metric == "manhattan":
        return np.abs(a - b).sum(1)
    if metric == "hamming":
        return (np.abs(a - b) > 1e-6).mean(1)
    d = ((a - b) ** 2).sum(1)
    return d if metric == "sqeuclidean" else np.sqrt(d)


#: Cells of the gathered rows whose distances are computed at a time: they stay in the processor's cache.
GATHERED = 1 << 16
#: Pairs of a distance matrix that leave a task at a time; queries and base rows of its tiles. Rows of a tile are so short that
#: compressors find their mirror images close behind, so that files hold a distance once, and ids of tiles repeat.
PIECE = 1 << 17
TILE = (32, 16)


def row_distances(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows a[at_a] and b[at_b], gathered block by block."""
    out, step = np.empty(len(at_a)), max(1, GATHERED // max(1, a.shape[1]))
    for at in range(0, len(out), step):
        out[at : at + step] = pair_distance(a[at_a[at : at + step]], b[at_b[at : at + step]], metric)
    return out


def prepared(b: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """What all_distances needs of the base: its rows, centred and scaled for angles, and their squared lengths."""
    if metric in ("cosine", "correlation", "angular"):
        b = b - b.mean(1, keepdims=True) if metric == "correlation" else b
        n = np.sqrt((b * b).sum(1))
        return b / np.where(n < 1e-10, 1, n)[:, None], n
    return b, (b * b).sum(1) if metric not in ("manhattan", "hamming") else np.zeros(len(b))


def all_distances(q: np.ndarray, base: tuple[np.ndarray, np.ndarray], metric: str) -> np.ndarray:
    """Distances of every query to every row of a prepared base, for choosing candidates."""
    b, nb = base
    if metric in ("cosine", "correlation", "angular"):
        q, nq = prepared(q, metric)
        return 1 - np.where((nq < 1e-10)[:, None] | (nb < 1e-10)[None], 0, q @ b.T)
    if metric in ("manhattan", "hamming"):
        out = np.empty((len(q), len(b)))
        for k in range(len(q)):
            gap = np.abs(b - q[k])
            out[k] = gap.sum(1) if metric == "manhattan" else (gap > 1e-6).mean(1)
        return out
    out = (-2 * q) @ b.T
    out += nb
    out += (q * q).sum(1)[:, None]
    return np.maximum(out, 0, out=out)


#: Groups of base rows whose least distances bound the least distances of all.
SLABS = 32


def _bound(rough: np.ndarray, m: int) -> np.ndarray:
    """For each row a number that at least m of its distances, and hardly more of them, do not exceed."""
    groups = rough.shape[1] // SLABS
    if groups >= 4 * m:
        rough = rough[:, : groups * SLABS].reshape(len(rough), SLABS, groups).min(1)  # m groups hold m distances at least
    return np.partition(rough, m - 1, axis=1)[:, m - 1]


def top_k(qid: np.ndarray, q: np.ndarray, bid: np.ndarray, b: np.ndarray, k: int, metric: str, skip_self: bool, slack: int = 16, upto: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, dist of the k nearest by (dist, j); upto: among the rows with j <= i. Candidates by matrix product, distances of
    candidates anew."""
    if upto:  # rows of one step then need about the same part of the base
        by, to = np.argsort(qid, kind="stable"), np.argsort(bid, kind="stable")
        qid, q, all_bid, all_b = qid[by], q[by], bid[to], b[to]
    step = max(1, (32 << 20) // (8 * max(1, len(b))))
    base, parts = prepared(b, metric), []
    every = base
    for at in range(0, len(q), step):
        qi, qq = qid[at : at + step], q[at : at + step]
        if upto:
            end = int(np.searchsorted(all_bid, qi[-1], "right"))
            bid, b, base = all_bid[:end], all_b[:end], (every[0][:end], every[1][:end])
            if not end:
                continue
        rough = all_distances(qq, base, metric)
        if upto:
            rough[bid[None] > qi[:, None]] = np.inf
        if skip_self:
            rough[qi[:, None] == bid[None]] = np.inf
        m = min(len(b), k + slack)
        if m < len(b):
            row, col = np.nonzero(rough <= _bound(rough, m)[:, None] * (1 + 1e-9) + 1e-12)  # ties at the edge all come along
        else:
            row, col = np.nonzero(np.isfinite(rough))
        keep = np.isfinite(rough[row, col])
        row, col = row[keep], col[keep]
        dist = row_distances(qq, row, b, col, metric)
        order = np.lexsort((bid[col], dist, row))
        row, col, dist = row[order], col[order], dist[order]
        first = np.searchsorted(row, np.arange(len(qq)))
        rank = np.arange(len(row)) - first[row]
        pick = rank < k
        parts.append((qi[row[pick]], bid[col[pick]], dist[pick]))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _ranked(pairs: DataFrame, k: int, by: tuple[str, ...] = ("dist", "j")) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("i").orderBy(*by))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_sql(queries: DataFrame, base: DataFrame, k: int, metric: str = "euclidean", skip_self: bool = True, where: Column | None = None) -> DataFrame:
    """The declarative form: theta join and top k per key. Beyond SQL_PAIRS pairs the same rows come from the blocks."""
    if where is None and queries.count() * base.count() > SQL_PAIRS:
        return knn_block(queries, base, k, metric, skip_self)
    q = queries.select(F.col("id").alias("i"), F.col("features").alias("a"))
    b = base.select(F.col("id").alias("j"), F.col("features").alias("b"))
    pairs = q.join(b, F.col("i") != F.col("j") if skip_self else F.lit(True))
    pairs = pairs.where(where) if where is not None else pairs
    return _ranked(pairs.select("i", "j", distance(metric)(F.col("a"), F.col("b")).alias("dist")), k).select("i", "j", "rank", "dist")


def _collect(base: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = base.select("id", "features").orderBy("id").toArrow()
    return t.column("id").to_numpy(), matrix(t.column("features").combine_chunks()) if t.num_rows else np.zeros((0, 0))


def base_size(base: DataFrame) -> tuple[int, int]:
    r = base.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
    return r["n"], r["d"] or 0


def _met(queries: DataFrame, base: DataFrame, size: int, kernel: Callable, broadcast_bytes: int) -> DataFrame:
    """i, j, dist that kernel(query ids, queries, base ids, base) gives for all queries and the base (size bytes): the base
    is shared by all tasks, or both meet block by block."""
    if size > broadcast_bytes:
        return _met_nested(queries, base, size, kernel)
    shared = queries.sparkSession.sparkContext.broadcast(_collect(base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bid, b = shared.value
        for batch in batches:
            if batch.num_rows and len(bid):
                yield from _pieces(kernel(batch.column("id").to_numpy(), matrix(batch.column("features")), bid, b))

    parts = queries.sparkSession.sparkContext.defaultParallelism
    return queries.select("id", "features").repartition(parts, "id").mapInArrow(run, SCHEMA)


def _pieces(found) -> Iterator[pa.RecordBatch]:
    for i, j, dist in [found] if isinstance(found, tuple) else found:
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(dist)], ["i", "j", "dist"])


#: Rows of one group of knn_lists() where no boxes are made.
GROUP = 1 << 10


def knn_lists(rows: DataFrame, k: int, metric: str, emit: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What emit(ids, neighbours' ids, distances) makes of the k nearest others of groups of rows. All tasks share the rows, so
    every list is complete in one task; of flat tables only near boxes are read."""
    from vecspan.operators import local

    spark, (ids, x) = rows.sparkSession, _collect(rows)
    boxed = local.flat(len(ids), x.shape[1], k, metric)
    groups = local.boxes(x) if boxed else np.split(np.arange(len(ids)), range(GROUP, len(ids), GROUP))
    shared = spark.sparkContext.broadcast((ids, x, groups, *(local.bounds(x, groups) if boxed else (None, None))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, groups, low, high = shared.value
        for batch in batches:
            for g in batch.column("id").to_pylist():
                own = groups[g]
                if boxed:
                    j, dist = local.near_in_boxes(x, groups, low, high, g, k)
                else:
                    _, j, dist = top_k(own, x[own], np.arange(len(ids)), x, k, metric, True)
                    j, dist = j.reshape(len(own), -1), dist.reshape(len(own), -1)
                yield emit(ids[own], ids[j], dist)

    slices = min(len(groups), 8 * spark.sparkContext.defaultParallelism)
    return spark.range(0, len(groups), 1, max(1, slices)).mapInArrow(run, schema)


def _ranked_lists(i: np.ndarray, j: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    rank = np.tile(np.arange(1, j.shape[1] + 1, dtype=np.int32), len(i))
    return pa.RecordBatch.from_arrays([pa.array(a) for a in (np.repeat(i, j.shape[1]), j.ravel(), rank, dist.ravel())], ["i", "j", "rank", "dist"])


def knn_block(queries: DataFrame, base: DataFrame, k: int, metric: str = "euclidean", skip_self: bool = True, broadcast_bytes: int = BROADCAST_BYTES, upto: bool = False) -> DataFrame:
    """upto: only base rows with j <= i count."""
    from vecspan.operators import local

    n, d = base_size(base)
    if queries is base and skip_self and not upto and 8 * n * d <= broadcast_bytes and local.flat(n, d, k, metric):
        return knn_lists(base, k, metric, _ranked_lists, "i long, j long, rank int, dist double")
    found = _met(queries, base, 8 * n * d, lambda qid, q, bid, b: top_k(qid, q, bid, b, k, metric, skip_self, upto=upto), broadcast_bytes)
    return _ranked(found, k).select("i", "j", "rank", "dist")


def _knn_nested(queries: DataFrame, base: DataFrame, size: int, k: int, metric: str, skip_self: bool, by: str | None = None) -> DataFrame:
    found = _met_nested(queries, base, size, lambda qid, q, bid, b: top_k(qid, q, bid, b, k, metric, skip_self), by)
    return _ranked(found, k).select("i", "j", "rank", "dist")


def _met_nested(queries: DataFrame, base: DataFrame, size: int, kernel: Callable, by: str | None = None) -> DataFrame:
    """Blocks of the base (size bytes in all) meet blocks of the queries on the base block's number; with by, only rows
    that agree in that column."""
    blocks = max(2, -(-size // BLOCK_BYTES))
    own = [by] if by else []

    def packed(df: DataFrame, names: tuple[str, str, str]) -> DataFrame:
        bin_ = F.pmod(F.xxhash64("id"), F.lit(blocks))
        return df.groupBy(*own, bin_.alias(names[0])).agg(F.collect_list("id").alias(names[1]), F.flatten(F.collect_list("features")).alias(names[2]))

    b = packed(base, ("block", "bid", "bx"))
    q = packed(queries, ("qblock", "qid", "qx")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    pairs = q.join(b, [*own, "block"]).select("qid", "qx", "bid", "bx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qid, qx, bid, bx = (np.asarray(batch.column(c)[r].values.to_numpy(zero_copy_only=False)) for c in range(4))
                yield from _pieces(kernel(qid, qx.reshape(len(qid), -1), bid, bx.reshape(len(bid), -1)))

    return pairs.mapInArrow(run, SCHEMA)


def knn_ivf(queries: DataFrame, base: DataFrame, k: int, metric: str = "euclidean", cells: int = 16, probe: int = 4, seed: int = 42, skip_self: bool = True, sample: int = 100_000, given: list[list[float]] | None = None) -> DataFrame:
    """Approximate: k-means cells fitted on at most sample rows (or given centres), equi-join on the probe nearest cells, exact
    re-rank. Every base row is indexed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from vecspan.operators.normalize import l2_normalize

    unit = l2_normalize if metric in ("cosine", "angular", "correlation") else lambda x: x
    if given is None:
        n = base.count()
        fit_on = base if n <= sample else base.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)) < sample)
        given = KMeans(k=cells, seed=seed, featuresCol="v").fit(unit(fit_on).select(array_to_vector("features").alias("v"))).clusterCenters()
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in given])
    euclid = distance("sqeuclidean")

    def nearest(df: DataFrame, m: int) -> DataFrame:
        gaps = F.transform(centres, lambda c, at: F.struct(euclid(F.col("unit"), c).alias("d"), at.alias("cell")))
        u = unit(df.select("id", "features")).select("id", F.col("features").alias("unit"))
        u = df.select("id", "features").join(u, "id") if metric in ("cosine", "angular", "correlation") else df.select("id", "features", F.col("features").alias("unit"))
        return u.withColumn("cell", F.explode(F.transform(F.slice(F.array_sort(gaps), 1, m), lambda s: s["cell"]))).select("id", "features", "cell")

    n, d = base_size(base)
    return _knn_nested(nearest(queries, probe), nearest(base, 1), 8 * n * d, k, metric, skip_self, by="cell")


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "euclidean", mode: str = "exact_block", **more) -> DataFrame:
    """mode ivf without cells and probe takes the first setting of GRID whose measured recall reaches 0.95."""
    if mode == "ivf" and not {"cells", "probe", "given"} & set(more):
        best = tune_ivf(base, k, metric, stop=True).where("chosen").first()
        more |= {"cells": best["cells"], "probe": best["probe"]}
    return {"exact_sql": knn_sql, "exact_block": knn_block, "ivf": knn_ivf}[mode](queries, base, k, metric, **more)


def range_search(queries: DataFrame, base: DataFrame, eps: float, metric: str = "euclidean", at_least: int = 0, at_most: int = 1000) -> DataFrame:
    """Neighbours within eps, at most at_most of them; the nearest at_least come whatever their distance."""
    near = knn_block(queries, base, at_most, metric)
    return near.where((F.col("dist") <= eps) | (F.col("rank") <= at_least))


def grouped_search(queries: DataFrame, base: DataFrame, group_col: str, k: int, metric: str = "euclidean", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k nearest groups (numbers) of each query, a group counting by its nearest vector. All vectors are compared, each
    block of the base gives one distance for a query and group."""
    n, d = base_size(base)
    blocks = max(1, -(-8 * n * d // broadcast_bytes))
    out = None
    for block in range(blocks):
        rows = base.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block) if blocks > 1 else base
        t = rows.select("id", "features", F.col(group_col).cast("long").alias("grp")).orderBy("grp", "id").toArrow()
        x = matrix(t.column("features").combine_chunks()) if t.num_rows else np.zeros((0, d))
        shared = queries.sparkSession.sparkContext.broadcast((t.column("id").to_numpy(), x, t.column("grp").to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bid, b, grp = shared.value
            starts = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1]))) if len(grp) else grp
            for batch in batches:
                if not batch.num_rows or not len(bid):
                    continue
                ids, rows_ = [], []
                for i, q in zip(batch.column("id").to_pylist(), matrix(batch.column("features"))):
                    dist = pair_distance(np.broadcast_to(q, b.shape), b, metric)
                    dist[bid == i] = np.inf
                    ids.append(i)
                    rows_.append(np.minimum.reduceat(dist, starts))
                best = np.stack(rows_)
                i, g = np.repeat(ids, len(starts)), np.tile(grp[starts], len(ids))
                ok = np.isfinite(best.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(i[ok]), pa.array(g[ok]), pa.array(best.ravel()[ok])], ["i", "grp", "dist"])

        part = queries.select("id", "features").mapInArrow(run, "i long, grp long, dist double")
        out = part if out is None else out.unionByName(part)
    best = _ranked(out.groupBy("i", "grp").agg(F.min("dist").alias("dist")), k, ("dist", "grp"))
    return best.select("i", F.col("grp").cast(base.schema[group_col].dataType).alias("grp"), "rank", "dist")


def padded(neighbors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exactly k ranks for every query; missing ones are j = -1 at distance 1e6."""
    slots = queries.select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return slots.join(neighbors, ["i", "rank"], "left").select("i", F.coalesce("j", F.lit(-1)).cast("long").alias("j"), "rank", F.coalesce("dist", F.lit(1e6)).alias("dist"))


def prefix_knn(df: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """Neighbours among the rows up to and including the row itself, in id order (the state of an index as it grows)."""
    return knn_block(df, df, k, metric, skip_self=False, upto=True)


def _tiles(qid: np.ndarray, q: np.ndarray, bid: np.ndarray, b: np.ndarray, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i, j, dist of every query with the base rows behind it (by id), in both directions, about 2 PIECE rows at a time."""
    by, to = np.argsort(qid, kind="stable"), np.argsort(bid, kind="stable")
    qid, q, bid, b = qid[by], q[by], bid[to], b[to]
    tall, wide = TILE
    step = max(1, min(GATHERED // max(1, b.shape[1]), PIECE // tall) // wide) * wide
    for at in range(0, len(q), tall):
        i, x = qid[at : at + tall], q[at : at + tall]
        for c in range(int(np.searchsorted(bid, i[0], "right")), len(bid), step):
            j, y = bid[c : c + step], b[c : c + step]
            dist, whole = np.stack([pair_distance(row[None], y, metric) for row in x]), len(j) // wide * wide
            for cut in (slice(0, whole), slice(whole, len(j))):
                if len(j[cut]):
                    yield _woven(i, j[cut], dist[:, cut])


def _woven(i: np.ndarray, j: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, dist of the pairs with i < j of a block, tile by tile, each row of a tile before its mirror image."""
    wide = min(TILE[1], len(j))

    def tiled(v: np.ndarray) -> np.ndarray:
        return np.broadcast_to(v, dist.shape).reshape(len(i), -1, wide).swapaxes(0, 1).reshape(-1, wide)

    a, b, d = tiled(i[:, None]), tiled(j), tiled(dist)
    out = (np.stack(c, 1) for c in ((a, b), (b, a), (d, d)))
    if i[-1] < j[0]:
        return tuple(c.ravel() for c in out)
    keep = np.stack((a < b,) * 2, 1)
    return tuple(c[keep] for c in out)


def distance_matrix(df: DataFrame, metric: str = "euclidean", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """i, j, dist of all ordered pairs; each unordered pair is computed once."""
    n, d = base_size(df)
    return _met(df, df, 8 * n * d, lambda qid, q, bid, b: _tiles(qid, q, bid, b, metric), broadcast_bytes)


def recall(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """One row: share of the exact neighbours that were found."""
    n = exact.where(F.col("rank") <= k).agg(F.count("*").alias("n"))
    hits = exact.where(F.col("rank") <= k).select("i", "j").join(found.where(F.col("rank") <= k).select("i", "j"), ["i", "j"]).agg(F.count("*").alias("hits"))
    return hits.withColumn("n", n.scalar()).select((F.col("hits") / F.col("n")).alias("recall"))


#: (cells per sqrt(n), probes) tried in turn; the last probes every cell, which is exact.
GRID = ((1.0, 4), (1.0, 8), (0.5, 8), (0.5, 16), (0.25, 16), (0.25, 1 << 30))


def tune_ivf(base: DataFrame, k: int, metric: str = "euclidean", target: float = 0.95, n_queries: int = 100, seed: int = 42, stop: bool = False) -> DataFrame:
    """cells, probe, recall, chosen for each setting of the grid; the first that reaches the target is chosen. stop: the
    settings behind it are not tried."""
    n = base.count()
    sample = base.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n_queries)
    exact = knn_block(sample, base, k, metric).cache()
    rows, done = [], False
    for factor, probe in GRID:
        cells = max(2, int(factor * n**0.5))
        r = recall(exact, knn_ivf(sample, base, k, metric, cells, min(probe, cells), seed), k).first()["recall"]
        rows.append((cells, min(probe, cells), r, not done and r >= target))
        done = done or r >= target
        if done and stop:
            break
    exact.unpersist()
    return base.sparkSession.createDataFrame(rows, "cells int, probe int, recall double, chosen boolean")


def upsert(base: DataFrame, changes: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The index's rows after inserts and updates (by id) and deletions."""
    kept = base.join(changes.select("id"), "id", "left_anti").unionByName(changes)
    return kept.join(deleted.select("id"), "id", "left_anti") if deleted is not None else kept


def _marked(index: DataFrame, ids: DataFrame, value: bool) -> DataFrame:
    has = index if "deleted" in index.columns else index.withColumn("deleted", F.lit(False))
    hit = ids.select(F.col("id").alias("__id")).distinct()
    new = F.when(F.col("__id").isNotNull(), F.lit(value)).otherwise(F.col("deleted"))
    return has.join(hit, F.col("id") == F.col("__id"), "left").withColumn("deleted", new).drop("__id")


def mark_deleted(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index with these rows marked deleted; they stay, but live() leaves them out."""
    return _marked(index, ids, True)


def unmark_deleted(index: DataFrame, ids: DataFrame) -> DataFrame:
    return _marked(index, ids, False)


def live(index: DataFrame) -> DataFrame:
    return index.where(~F.col("deleted")).drop("deleted") if "deleted" in index.columns else index


def replace_deleted(index: DataFrame, changes: DataFrame) -> DataFrame:
    """Inserts that take the places of deleted rows: these go for good, and as many or fewer rows come."""
    return upsert(live(index), changes)


def fetch(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The live rows of these ids."""
    return live(index).join(ids.select("id").distinct(), "id", "left_semi")


def cross_neighbors(new: DataFrame, base: DataFrame, k: int, metric: str = "euclidean", extra: int = 50, mode: str = "exact_block") -> DataFrame:
    """The k nearest base rows of every new row, the first of k + extra candidates by plain distance."""
    near = knn(new, base, k + extra, metric, mode, skip_self=False)
    return near.where(F.col("rank") <= k)


def graph_checks(neighbors: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: self links, links to unknown rows, rows that no link reaches."""
    ids = nodes.select(F.col("id").alias("j"))
    loops = neighbors.agg(F.count_if(F.col("i") == F.col("j")).alias("self_links"))
    unknown = neighbors.join(ids, "j", "left_anti").agg(F.count("*").alias("x"))
    lonely = ids.join(neighbors.select("j").distinct(), "j", "left_anti").agg(F.count("*").alias("x"))
    return loops.withColumn("unknown_links", unknown.scalar()).withColumn("unreached", lonely.scalar())
