"""The three-phase optimiser: one step as DataFrames, and the fixed-length loop in a local and a distributed tier.

Forces between the ends of a pair with D = 1 + |y_i - y_j|^2: near w 20 / (10 + D)^2, mid-range w 20000 / (10000 + D)^2,
far -w 2 / (1 + D)^2, along y_i - y_j. The loop's state is the embedding with two moments. Locally it lives in numpy in one
task; in the distributed tier pairs stay cached on the executors in both directions, dealt by ranges of rows, the embedding
(n x components, whose size is checked) is broadcast each iteration, and every task returns the gradient of its own rows alone.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspan.functions.schedules import PHASES, weights_at
from vecspan.functions.vectors import normal, sqeuclidean
from vecspan.session import Stash

#: Pairs up to which the loop runs in one task.
LOCAL_PAIRS = 10_000_000


@dataclass(frozen=True)
class Adam:
    lr: float = 1.0
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-7

    def rate(self, t: int) -> float:
        return self.lr * math.sqrt(1 - self.beta2**t) / (1 - self.beta1**t)


def initial(rows: DataFrame, components: int = 2, deviation: float = 1e-4, seed: int = 42) -> DataFrame:
    """id, y: small normal numbers, a function of (seed, id, component)."""
    return rows.select("id", F.array(*[normal(str(seed), "init", F.col("id"), c) * deviation for c in range(components)]).alias("y"))


def ends(pairs: DataFrame, y: DataFrame) -> DataFrame:
    """pairs with yi, yj and d2 = 1 + squared distance."""
    a = y.select(F.col("id").alias("i"), F.col("y").alias("yi"))
    b = y.select(F.col("id").alias("j"), F.col("y").alias("yj"))
    return pairs.join(a, "i").join(b, "j").withColumn("d2", 1.0 + sqeuclidean(F.col("yi"), F.col("yj")))


def force(kind: Column, d: Column, w: tuple[float, float, float]) -> Column:
    near = w[0] * 20.0 / ((10.0 + d) * (10.0 + d))
    mid = w[1] * 20000.0 / ((10000.0 + d) * (10000.0 + d))
    return F.when(kind == 0, near).when(kind == 1, mid).otherwise(-w[2] * 2.0 / ((1.0 + d) * (1.0 + d)))


def gradient(pairs: DataFrame, y: DataFrame, w: tuple[float, float, float]) -> DataFrame:
    """id, pos, g: both ends of every pair, summed per row and component with a map-side combine."""
    e = ends(pairs, y).withColumn("c", force(F.col("kind"), F.col("d2"), w))
    e = e.withColumn("step", F.zip_with("yi", "yj", lambda a, b: a - b)).where(~F.isnan("c"))
    parts = F.array(F.struct(F.col("i").alias("id"), F.transform("step", lambda x: x * F.col("c")).alias("g")), F.struct(F.col("j").alias("id"), F.transform("step", lambda x: -x * F.col("c")).alias("g")))
    long = e.select(F.explode(parts).alias("p")).select("p.id", F.posexplode("p.g").alias("pos", "g"))
    return long.groupBy("id", "pos").agg(F.sum("g").alias("g"))


def clipped(grad: DataFrame, most: float) -> DataFrame:
    """Gradient scaled down to a global norm of most."""
    size = grad.agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("s"))
    return grad.withColumn("s", size.scalar()).select("id", "pos", F.when(F.col("s") > most, F.col("g") * most / F.col("s")).otherwise(F.col("g")).alias("g"))


def normalized(grad: DataFrame) -> DataFrame:
    """Gradient of global norm 1; one shorter than 1e-15 stays."""
    size = grad.agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("s"))
    return grad.withColumn("s", size.scalar()).select("id", "pos", F.when(F.col("s") > 1e-15, F.col("g") / F.col("s")).otherwise(F.col("g")).alias("g"))


def state_checks(embedding: DataFrame, components: int) -> DataFrame:
    """One row: rows, rows of another width, NaN and infinite cells of an embedding (id, y)."""
    y = F.col("y")
    bad = [F.sum(F.size(F.filter(y, f))) for f in (lambda x: F.isnan(x), lambda x: F.abs(x) == float("inf"))]
    return embedding.agg(F.count("*").alias("n"), F.count_if(F.size(y) != components).alias("n_wrong_width"), *[F.coalesce(b, F.lit(0)).cast("long").alias(n) for b, n in zip(bad, ("n_nan", "n_inf"))])


def gradient_checks(grad: DataFrame, most: float = 1e10) -> DataFrame:
    g = F.col("g")
    return grad.agg(F.count_if(F.isnan(g)).alias("n_nan"), F.count_if(F.abs(g) == float("inf")).alias("n_inf"), F.count_if(F.abs(g) > most).alias("n_large"))


def loss(pairs: DataFrame, y: DataFrame, w: tuple[float, float, float], objective: bool = False) -> DataFrame:
    """One row: mean loss of the pairs. The plain form measures with the distance itself, the objective with 1 + its square."""
    e = ends(pairs, y)
    d = F.col("d2") if objective else F.sqrt(F.col("d2") - 1.0)
    k = F.col("kind")
    term = F.when(k == 0, w[0] * d / (10.0 + d)).when(k == 1, w[1] * d / (10000.0 + d)).otherwise(w[2] / (1.0 + d))
    return e.agg(F.avg(term).alias("loss"))


def adam_step(state: DataFrame, grad: DataFrame, t: int, adam: Adam = Adam()) -> DataFrame:
    """state: id, pos, y, m, v. Rows without gradient count as zero."""
    s = state.join(grad, ["id", "pos"], "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    s = s.withColumn("m", adam.beta1 * F.col("m") + (1 - adam.beta1) * F.col("g")).withColumn("v", adam.beta2 * F.col("v") + (1 - adam.beta2) * F.col("g") * F.col("g"))
    return s.select("id", "pos", (F.col("y") - adam.rate(t) * F.col("m") / (F.sqrt("v") + adam.eps)).alias("y"), "m", "v")


def sgd_step(state: DataFrame, grad: DataFrame, lr: float) -> DataFrame:
    return state.join(grad, ["id", "pos"], "left").select("id", "pos", (F.col("y") - lr * F.coalesce("g", F.lit(0.0))).alias("y"))


def long_state(y: DataFrame) -> DataFrame:
    return y.select("id", F.posexplode("y").alias("pos", "y")).withColumn("m", F.lit(0.0)).withColumn("v", F.lit(0.0))


def pair_quality(pairs: DataFrame, y: DataFrame) -> DataFrame:
    """One row: mean of 1 / (1 + d) near, d / (100 + d) mid-range, d / (1 + d) far."""
    e = ends(pairs, y).withColumn("d", F.sqrt(F.col("d2") - 1.0))
    d, k = F.col("d"), F.col("kind")
    return e.agg(F.avg(F.when(k == 0, 1.0 / (1.0 + d)).when(k == 1, d / (100.0 + d)).otherwise(d / (1.0 + d))).alias("quality"))


def converged(history: DataFrame, window: int = 10, threshold: float = 1e-4) -> DataFrame:
    """iter, change, stopped: difference of the means of the last two half windows of the loss."""
    half = window // 2
    w = W.partitionBy().orderBy("iter")
    last = F.avg("loss").over(w.rowsBetween(-half + 1, 0))
    before = F.avg("loss").over(w.rowsBetween(-2 * half + 1, -half))
    enough = F.row_number().over(w) >= 2 * half
    h = history.withColumn("change", F.when(enough, F.abs(last - before)))
    return h.select("iter", "change", F.coalesce(F.col("change") < threshold, F.lit(False)).alias("stopped"))


def stopped_early(history: DataFrame, patience: int = 10) -> DataFrame:
    """iter, stopped: whether the least loss of the last patience entries is no better than 0.999 of the least so far."""
    w = W.partitionBy().orderBy("iter")
    recent, ever = F.min("loss").over(w.rowsBetween(-patience + 1, 0)), F.min("loss").over(w.rowsBetween(W.unboundedPreceding, 0))
    return history.withColumn("stopped", (F.row_number().over(w) >= patience) & (recent >= ever * 0.999)).select("iter", "stopped")


def initial_from(rows: DataFrame, components: int = 2) -> DataFrame:
    """id, y: a hundredth of the first principal components' scores."""
    from vecspan.operators.normalize import pca

    return pca(rows.select("id", "features"), components).select("id", F.transform("features", lambda x: 0.01 * x).alias("y"))


def initial_given(given: DataFrame, deviation: float = 1e-4) -> DataFrame:
    """id, y: a given start, its columns standardised and scaled by the deviation."""
    from vecspan.operators.normalize import zscore

    out = zscore(given.select("id", F.col("y").alias("features")))
    return out.select("id", F.transform("features", lambda x: x * deviation).alias("y"))


def phases(p1: int = 100, p2: int = 100, p3: int = 250) -> list[tuple[str, int, int]]:
    return [(PHASES[0], 0, p1), (PHASES[1], p1, p1 + p2), (PHASES[2], p1 + p2, p1 + p2 + p3)]


def phase_table(spark, iters: tuple[int, int, int] = (100, 100, 250)) -> DataFrame:
    """phase, first, last (the iteration behind it), and the weights at the first: near, mid, far."""
    rows = [(name, a, b, *map(float, weights_at(a, iters[0], iters[1]))) for name, a, b in phases(*iters)]
    return spark.createDataFrame(rows, "phase string, first int, last int, near double, mid double, far double")


def mean_loss(y: np.ndarray, i: np.ndarray, j: np.ndarray, kind: np.ndarray, w: tuple[float, float, float]) -> float:
    return _forces(y, i, j, kind, w)[1] / max(1, len(i))


def _steps(columns: np.ndarray, i: np.ndarray, others: np.ndarray, j: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Fills out with y_i - y_j of the pairs, a row for each component (gathers from one column are several times faster
    than from rows), and returns its squared length."""
    d, square = np.zeros(len(i)), np.empty(len(i))
    for column, other, step in zip(columns, others, out):
        np.subtract(column.take(i), other.take(j), out=step)
        np.multiply(step, step, out=square)
        d += square
    return d


def _forces_into(columns: np.ndarray, i: np.ndarray, j: np.ndarray, kind: int, w: tuple[float, float, float], limit: float | None, measure: bool, out: np.ndarray, others: np.ndarray | None = None) -> float:
    """Fills out (components x pairs) with the forces on i of pairs of one kind; returns their summed loss if it is measured.
    others: where j are rows of other columns."""
    d, lost = _steps(columns, i, columns if others is None else others, j, out), 0.0
    if measure:
        root = np.sqrt(d)
        far = {0: 10.0, 1: 10000.0}.get(kind)
        lost = float(w[kind] * ((root / (far + root)) if far else 1 / (1 + root)).sum())
    d += 1
    far, top = ((10.0, 20 * w[0]), (10000.0, 20000 * w[1]), (1.0, -2 * w[2]))[kind]
    c = far + d
    c *= c
    np.divide(top, c, out=c)
    if limit is not None and kind == 0:
        c *= (limit / 2) / np.sqrt(d)
    if not np.isfinite(c.sum()):
        c[~np.isfinite(c)] = 0
    out *= c
    return lost


def _gathered(force: np.ndarray, i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Gradient (n x components) of the forces of pairs (i, j)."""
    return np.stack([np.bincount(i, f, n) - np.bincount(j, f, n) for f in force], axis=1)


def _forces_of(y: np.ndarray, i: np.ndarray, j: np.ndarray, kind: int, w: tuple[float, float, float], limit: float | None = None, measure: bool = True) -> tuple[np.ndarray, float]:
    """Gradient and summed loss over pairs of one kind; limit: the variant for local structure."""
    if not w[kind] or not len(i):
        return np.zeros_like(y), 0.0
    force = np.empty((y.shape[1], len(i)))
    lost = _forces_into(np.ascontiguousarray(y.T), i, j, kind, w, limit, measure, force)
    return _gathered(force, i, j, len(y)), lost


def _forces(y: np.ndarray, i: np.ndarray, j: np.ndarray, kind: np.ndarray, w: tuple[float, float, float], limit: float | None = None) -> tuple[np.ndarray, float]:
    """The same over pairs of any kinds."""
    g, lost = np.zeros_like(y), 0.0
    for k in range(3):
        own = kind == k
        a, b = _forces_of(y, i[own], j[own], k, w, limit)
        g, lost = g + a, lost + b
    return g, lost


#: Draws for each far pair that the local variant replaces.
TRIES = 100


def _mixed(x: np.ndarray, k: np.ndarray | np.uint64) -> np.ndarray:
    x = (x + k) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _draw(seed: int, it: int, i: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    """A row for each draw t of every row i (rows x draws), as a hash of (seed, it, i, t)."""
    x = np.uint64(seed & 0xFFFFFFFFFFFFFFFF) ^ (i.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = _mixed(x, np.uint64(it + 1))[:, None]
    return (_mixed(x, t.astype(np.uint64) + np.uint64(1)) % np.uint64(n)).astype(np.int64)


#: Draws of a pair that are looked at together, TRIES in all; rows whose pairs are drawn together.
TRIED, DRAWN = (1, 3, 8, 16, 32, 40), 1024


def redraws(it: int, late: int) -> bool:
    """Whether far pairs are drawn anew before iteration it: after every tenth one past the first of the last phase."""
    return it - 1 > late and (it - 1) % 10 == 0


def resampled(y: np.ndarray, i: np.ndarray, j: np.ndarray, near_i: np.ndarray, near_j: np.ndarray, limit: float, seed: int, it: int) -> np.ndarray:
    """The other ends of the far pairs (i, j), drawn anew among rows at most limit away that are no near pair of i and no
    other draw of it; a pair that finds none in TRIES keeps its old end. i is sorted. Rows do not depend on each other, so
    threads take blocks of them, outside of tasks."""
    n, out = len(y), j.copy()
    rows, first = np.unique(i, return_index=True)
    ends = np.append(first[1:], len(i))
    near, columns = np.unique(near_i.astype(np.int64) * n + near_j), np.ascontiguousarray(y.T)

    def barred(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * n + b
        return near[np.minimum(np.searchsorted(near, key), len(near) - 1)] == key if len(near) else np.zeros(len(key), bool)

    def part(at: int) -> None:
        own, start, count = rows[at : at + DRAWN], first[at : at + DRAWN], (ends - first)[at : at + DRAWN]
        taken = np.full((len(own), int(count.max())), -1, np.int64)
        for s in range(taken.shape[1]):
            left, t = np.flatnonzero(count > s), s * TRIES
            for more in TRIED:
                a = own[left]
                b = _draw(seed, it, a, np.arange(t, t + more), n)
                d = np.zeros(b.shape)
                for column in columns:
                    step = column.take(b)
                    step -= column[a][:, None]
                    step *= step
                    d += step
                r, c = np.nonzero((d <= limit * limit) & (b != a[:, None]))  # in the order of the draws
                found = b[r, c]
                keep = np.flatnonzero(~barred(a[r], found) & ~(taken[left[r]] == found[:, None]).any(1))
                r, pick = np.unique(r[keep], return_index=True)
                hit, found = left[r], found[keep[pick]]
                out[start[hit] + s] = found
                taken[hit, s] = found
                left, t = np.delete(left, r), t + more
                if not len(left):
                    break

    with ThreadPoolExecutor(1 if TaskContext.get() else os.cpu_count()) as pool:
        list(pool.map(part, range(0, len(rows), DRAWN)))
    return out


#: Pairs whose forces the local tier computes at a time, alone and where threads share the work of THREADED pairs and more.
CHUNK, SHARED = 1 << 15, 1 << 17
THREADED = 1 << 20


@dataclass
class Run:
    y: np.ndarray
    history: list[tuple[int, str, float]] = field(default_factory=list)
    snapshots: dict[int, np.ndarray] = field(default_factory=dict)


def _adam(y: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, t: int, adam: Adam) -> None:
    if adam.beta1 == 0:  # plain gradient descent
        y -= adam.lr * g
    else:
        m *= adam.beta1
        m += (1 - adam.beta1) * g
        v *= adam.beta2
        v += (1 - adam.beta2) * g * g
        y -= adam.rate(t) * m / (np.sqrt(v) + adam.eps)
    np.copyto(y, 0.01, where=~np.isfinite(y))


def minimise(y: np.ndarray, gradient_at: Callable[[np.ndarray, tuple[float, float, float], int], tuple[np.ndarray, float]], n_pairs: int, iters: tuple[int, int, int] = (100, 100, 250), adam: Adam = Adam(), fixed: int = 0, progress: Callable[[str, int, int], None] | None = None, snapshots: tuple[int, ...] = ()) -> Run:
    """The fixed-length loop. The first fixed rows do not move."""
    run, m, v = Run(y.astype(np.float64).copy()), np.zeros_like(y, np.float64), np.zeros_like(y, np.float64)
    total = sum(iters)
    for it in range(total):
        if it in snapshots:
            run.snapshots[it] = run.y.copy()
        w = weights_at(it, iters[0], iters[1])
        g, lost = gradient_at(run.y, w, it)
        g[:fixed] = 0
        _adam(run.y, g, m, v, it + 1, adam)
        if it % 10 == 0 or it == total - 1:
            name = next(n for n, a, b in phases(*iters) if a <= it < b)
            run.history.append((it, name, lost / max(1, n_pairs)))
            if progress:
                progress(name, it, total)
    if total in snapshots:
        run.snapshots[total] = run.y.copy()
    return run


def local_loop(y: np.ndarray, i: np.ndarray, j: np.ndarray, kind: np.ndarray, iters: tuple[int, int, int], adam: Adam, limit: float | None = None, seed: int = 42, **more) -> Run:
    """All pairs in this process. Threads take chunks of one kind that fit the processor's cache, for the forces and then for
    their sums by row: the pairs' first ends are in order, the second ends are read in theirs."""
    order = np.lexsort((j, i, kind))
    i, j, kind = i[order], j[order], kind[order]
    edge = np.searchsorted(kind, [0, 1, 2, 3])
    far = slice(edge[2], edge[3])
    j = j.copy()
    kinds = [slice(edge[k], edge[k + 1]) for k in range(3)]
    step = SHARED if len(i) >= THREADED else CHUNK
    chunks = [(k, slice(a, min(a + step, edge[k + 1]))) for k in range(3) for a in range(edge[k], edge[k + 1], step)]
    force = np.empty((y.shape[1], len(i)))
    late, last = iters[0] + iters[1], sum(iters) - 1
    sums = [_runs_of(i[c], None) + _runs_of(j[c], np.argsort(j[c], kind="stable")) for c in kinds]

    def gradient_at(now: np.ndarray, w: tuple[float, float, float], it: int) -> tuple[np.ndarray, float]:
        near = limit if limit and it > late else None
        if limit and redraws(it, late):
            j[far] = resampled(now, i[far], j[far], i[: edge[1]], j[: edge[1]], limit, seed, it)
            sums[2] = _runs_of(i[far], None) + _runs_of(j[far], np.argsort(j[far], kind="stable"))
        measure = it % 10 == 0 or it == last
        columns = np.ascontiguousarray(now.T)
        lost = sum(run(lambda x: _forces_into(columns, i[x[1]], j[x[1]], x[0], w, near, measure, force[:, x[1]]), [c for c in chunks if w[c[0]]]))
        g = np.zeros((2, 3, *columns.shape))

        def add(x: tuple[int, int, tuple]) -> None:
            k, c, (order, cut, starts, rows) = x
            mine = force[c, kinds[k]]
            mine = mine[cut] if order is None else mine.take(order)
            g[int(order is not None), k, c, rows] = np.add.reduceat(mine, starts)

        run(add, [(k, c, block) for k in range(3) if w[k] for c in range(len(columns)) for block in sums[k]])
        return np.ascontiguousarray((g[0].sum(0) - g[1].sum(0)).T), lost

    with ThreadPoolExecutor(os.cpu_count()) as pool:
        run = (lambda f, x: list(pool.map(f, x))) if len(i) >= THREADED else (lambda f, x: list(map(f, x)))
        return minimise(y, gradient_at, len(i), iters, adam, **more)


def _runs_of(row: np.ndarray, order: np.ndarray | None) -> list[tuple[np.ndarray | None, slice, np.ndarray, np.ndarray]]:
    """Blocks of about SHARED pairs that end where a row ends: their places (order, or the slice as it stands), where each row
    starts in the block, and the rows."""
    if not len(row):
        return []
    row = row if order is None else row[order]
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    at = np.unique(np.searchsorted(first, np.arange(0, len(row), SHARED)))
    at = at[at < len(first)]
    ends, out = np.append(first[at[1:]], len(row)), []
    for a, b, x, y in zip(at, np.append(at[1:], len(first)), first[at], ends):
        cut = slice(x, y)
        out.append((None if order is None else order[cut], cut, first[a:b] - x, row[first[a:b]]))
    return out


#: Pairs of a partition of the distributed loop, in both directions; of one packed row at most, but for a row with more.
DEALT, PACKED = 1 << 23, 1 << 18


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, kind, rows, sizes, ends: pairs (part, kind, i, j), in this order, in blocks that end where a row ends: the rows,
    how many pairs each has, and their other ends, as 32-bit numbers."""
    held: list[list[np.ndarray]] = []
    waiting, limit = 0, PACKED

    def pieces(part: np.ndarray, kind: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
        for x, y in zip([0, *new.tolist()], [*new.tolist(), len(i)]):
            first = np.flatnonzero(np.concatenate(([True], i[x + 1 : y] != i[x : y - 1])))
            blobs = (i[x:y][first], np.diff(np.append(first, y - x)), j[x:y])
            yield pa.RecordBatch.from_arrays([pa.array(part[x : x + 1], pa.int64()), pa.array(kind[x : x + 1], pa.int32()), *[pa.array([v.astype(np.int32).tobytes()]) for v in blobs]], ["part", "kind", "rows", "sizes", "ends"])

    for b in batches:
        held.append([b.column(n).to_numpy() for n in ("part", "kind", "i", "j")])
        waiting += b.num_rows
        if waiting < limit:
            continue
        cols = [np.concatenate(c) for c in zip(*held)]
        ends = np.flatnonzero((cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]))
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut:
            yield from pieces(*[c[:cut] for c in cols])
        held, waiting = [[c[cut:] for c in cols]], waiting - cut
        limit = max(PACKED, 2 * waiting)
    if waiting:
        yield from pieces(*[np.concatenate(c) for c in zip(*held)])


def _pull(columns: np.ndarray, kind: int, rows: np.ndarray, sizes: np.ndarray, ends: np.ndarray, w: tuple[float, float, float], limit: float | None, measure: bool, out: np.ndarray, start_row: int) -> float:
    """Adds to out (components x rows from start_row on) the gradient that the pairs of a packed block give its rows; returns
    their summed loss if it is measured."""
    rows, ends, lost = rows.astype(np.int64), ends.astype(np.int64), 0.0
    to = np.cumsum(sizes, dtype=np.int64)
    cuts = np.unique(np.append(np.searchsorted(to, np.arange(CHUNK, to[-1], CHUNK)), len(rows)))
    x = 0
    for y in cuts[cuts > 0]:
        start = to[x - 1] if x else 0
        i, j = np.repeat(rows[x:y], sizes[x:y]), ends[start : to[y - 1]]
        force = np.empty((len(columns), len(j)))
        lost += _forces_into(columns, i, j, kind, w, limit, measure, force)
        first = np.concatenate(([0], to[x : y - 1] - start))
        for c in range(len(columns)):
            out[c, rows[x:y] - start_row] += np.add.reduceat(force[c], first)
        x = y
    return lost


#: Rows of a range of other ends, whose places stay in the processor's cache; ranges up to which pairs are dealt by them.
REACH, REACHES = 1 << 15, 256


def _row_type(rows_of: int) -> type:
    return np.uint16 if rows_of <= 1 << 16 else np.uint32


def _keyed(batches: Iterator[pa.RecordBatch], n: int, rows_of: int) -> Iterator[pa.RecordBatch]:
    """part, keys: the pairs (i, j, kind) in both directions as 64-bit numbers by partition of i, which order them by kind, range
    of j, i and j. n: rows in all."""
    held: list[list[np.ndarray]] = []

    def pieces() -> pa.RecordBatch:
        i, j, kind = (np.concatenate(c).astype(np.int64) for c in zip(*held))
        a, b = np.concatenate((i, j)), np.concatenate((j, i))
        part = a // rows_of
        keys = ((np.tile(kind, 2) * -(-n // REACH) + b // REACH) * rows_of + a % rows_of) * REACH + b % REACH
        order = np.argsort(part, kind="stable")
        part, keys = part[order], keys[order]
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array([k.tobytes() for k in np.split(keys, first[1:])])], ["part", "keys"])

    for b in batches:
        held.append([b.column(n).to_numpy() for n in ("i", "j", "kind")])
        if sum(len(h[0]) for h in held) >= 4 * PACKED:
            yield pieces()
            held = []
    if held and sum(len(h[0]) for h in held):
        yield pieces()


def _ranged(batches: Iterator[pa.RecordBatch], n: int, rows_of: int) -> Iterator[pa.RecordBatch]:
    """part, kind, reach, rows, ends: the pairs of _keyed() in blocks of one partition, kind and range of other ends, their rows
    and ends counted from the first of the partition and of the range, as short numbers."""
    held: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for part, keys in zip(b.column("part").to_pylist(), b.column("keys")):
            held.setdefault(part, []).append(np.frombuffer(keys.as_buffer(), np.int64))
    for part in sorted(held):
        keys = np.concatenate(held.pop(part))
        keys.sort()
        block, ranges = keys // (rows_of * REACH), -(-n // REACH)
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        for x, y in zip(first, np.append(first[1:], len(keys))):
            for at in range(x, y, PACKED):
                own, which = keys[at : min(at + PACKED, y)], int(block[x])
                blobs = [pa.array([v.tobytes()]) for v in ((own // REACH % rows_of).astype(_row_type(rows_of)), (own % REACH).astype(np.uint16))]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([which // ranges], pa.int32()), pa.array([which % ranges], pa.int64()), *blobs], ["part", "kind", "reach", "rows", "ends"])


def _pull_ranged(columns: np.ndarray, kind: int, reach: int, rows: np.ndarray, ends: np.ndarray, w: tuple[float, float, float], limit: float | None, measure: bool, out: np.ndarray, start_row: int) -> float:
    """_pull() for a block of _ranged(): both gathers stay within a short range of rows."""
    rows, ends, lost = rows.astype(np.int64), ends.astype(np.int64), 0.0
    force = np.empty((len(columns), len(rows)))
    own, others = columns[:, start_row : start_row + out.shape[1]], columns[:, reach * REACH : (reach + 1) * REACH]
    for at in range(0, len(rows), CHUNK):
        cut = slice(at, at + CHUNK)
        lost += _forces_into(own, rows[cut], ends[cut], kind, w, limit, measure, force[:, cut], others)
    for c in range(len(columns)):
        out[c] += np.bincount(rows, force[c], out.shape[1])
    return lost


def shared_losses(pairs: DataFrame, states: list[np.ndarray], w: tuple[float, float, float]) -> list[float]:
    """Mean loss of the pairs (positions) in each state, which all tasks share, in one pass over the pairs."""
    shared = pairs.sparkSession.sparkContext.broadcast(states)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states_of = [np.ascontiguousarray(y.T) for y in shared.value]
        n, lost = 0, np.zeros(len(states_of))
        for b in batches:
            n += b.num_rows
            i, j, kind = (b.column(c).to_numpy() for c in ("i", "j", "kind"))
            for k in range(3):
                own = kind == k
                a, z = i[own], j[own]
                force = np.empty((len(states_of[0]), len(a)))
                if w[k]:
                    lost += [_forces_into(columns, a, z, k, w, None, True, force) for columns in states_of]
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([lost.tolist()])], ["n", "lost"])

    rows = pairs.select("i", "j", "kind").mapInArrow(part, "n long, lost array<double>").collect()  # a row for each task
    shared.destroy()
    return (np.sum([r["lost"] for r in rows], axis=0) / max(1, sum(r["n"] for r in rows))).tolist()


def distributed_loop(y: np.ndarray, pairs: DataFrame, iters: tuple[int, int, int], adam: Adam, n_pairs: int, limit: float | None = None, seed: int = 42, **more) -> Run:
    """Pairs (positions i, j, kind) stay cached on the executors, in both directions, so that a row's gradient is the sum over
    its own pairs, and dealt by ranges of rows, so that a task returns the gradient of its rows and no other; each iteration is one
    job. They are cached as packed blocks of one kind and one range of other ends (of one kind alone, where a table has too many
    ranges), which reach the workers as they are, and kinds of weight 0 stay behind. Far pairs that are drawn anew are written to shared storage, a row's near and far ends in one row."""
    spark = pairs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    by_range = len(y) <= REACH * REACHES
    parts = cores * -(-2 * n_pairs // (DEALT * cores))  # whole rounds of tasks, as few as fit
    parts = parts if by_range else max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts)
    rows_of = max(1, -(-len(y) // parts))
    late = iters[0] + iters[1]
    first, stash, ends_of = pairs.select("i", "j", "kind"), Stash(spark) if limit else None, None
    first = first.persist() if limit else first

    def dealt(some: DataFrame) -> DataFrame:
        if by_range:
            n = len(y)
            keyed = some.mapInArrow(lambda b: _keyed(b, n, rows_of), "part long, keys binary").withColumn("at", F.col("part").cast("int")).repartitionById(parts, "at")
            return keyed.select("part", "keys").mapInArrow(lambda b: _ranged(b, n, rows_of), "part long, kind int, reach long, rows binary, ends binary").persist()
        one = some.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("kind").cast("int").alias("kind"))
        both = one.union(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "kind"))
        both = both.select(F.floor(F.col("i") / rows_of).cast("int").alias("part"), "kind", "i", "j")
        ordered = both.repartitionById(parts, "part").sortWithinPartitions("part", "kind", "i", "j")
        return ordered.mapInArrow(_packed, "part long, kind int, rows binary, sizes binary, ends binary").persist()

    kept = dealt(first)

    def redraw(now: np.ndarray, it: int) -> None:
        nonlocal kept, ends_of
        if ends_of is None:
            mine = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("j").cast("long")))).alias(n) for k, n in ((0, "near"), (2, "far"))]
            ends_of = first.where("kind in (0, 2)").groupBy(F.col("i").cast("long").alias("i")).agg(*mine)
        shared = spark.sparkContext.broadcast(now)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                b = b.take(pa.array(np.argsort(b.column("i").to_numpy())))
                i, near, far = b.column("i").to_numpy(), b.column("near"), b.column("far")
                sizes = [np.diff(x.offsets.to_numpy()) for x in (near, far)]
                new = resampled(shared.value, np.repeat(i, sizes[1]), far.flatten().to_numpy(), np.repeat(i, sizes[0]), near.flatten().to_numpy(), limit, seed, it)
                yield pa.RecordBatch.from_arrays([b.column("i"), near, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes[1]))), pa.int32()), pa.array(new))], ["i", "near", "far"])

        ends_of = stash.cut(ends_of.mapInArrow(part, "i long, near array<long>, far array<long>"), "far")
        shared.destroy()
        kept.unpersist()
        types = dict(first.dtypes)
        far = ends_of.select(F.col("i").cast(types["i"]).alias("i"), F.explode(F.col("far").cast(f"array<{types['j']}>")).alias("j"), F.lit(2).cast(types["kind"]).alias("kind"))
        kept = dealt(first.where("kind <> 2").union(far))

    def gradient_at(now: np.ndarray, w: tuple[float, float, float], it: int) -> tuple[np.ndarray, float]:
        close = limit if limit and it > late else None
        if limit and redraws(it, late):
            redraw(now, it)
        shared = spark.sparkContext.broadcast(now)

        measure, c = it % 10 == 0 or it == sum(iters) - 1, now.shape[1]

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns, sums, lost = np.ascontiguousarray(shared.value.T), {}, 0.0
            for b in batches:
                for k in range(b.num_rows):
                    at, kind = b.column("part")[k].as_py(), b.column("kind")[k].as_py()
                    if at not in sums:
                        sums[at] = np.zeros((c, min(rows_of, columns.shape[1] - at * rows_of)))
                    if by_range:
                        blobs = (np.frombuffer(b.column(n)[k].as_buffer(), t) for n, t in (("rows", _row_type(rows_of)), ("ends", np.uint16)))
                        lost += _pull_ranged(columns, kind, b.column("reach")[k].as_py(), *blobs, w, close, measure, sums[at], at * rows_of)
                    else:
                        blobs = (np.frombuffer(b.column(n)[k].as_buffer(), np.int32) for n in ("rows", "sizes", "ends"))
                        lost += _pull(columns, kind, *blobs, w, close, measure, sums[at], at * rows_of)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([g.tobytes() for g in sums.values()]), pa.array([lost] + [0.0] * (len(sums) - 1))], ["part", "g", "lost"])

        total, lost = np.zeros((c, len(now))), 0.0
        pulling = kept.where(F.col("kind").isin([k for k in range(3) if w[k]]))
        for b in pulling.mapInArrow(part, "part long, g binary, lost double").toArrow().to_batches():  # all together one gradient
            for at, blob, more_lost in zip(b.column("part").to_pylist(), b.column("g"), b.column("lost").to_pylist()):
                g = np.frombuffer(blob.as_buffer()).reshape(c, -1)
                total[:, at * rows_of :][:, : g.shape[1]] += g
                lost += more_lost
        shared.destroy()
        return np.ascontiguousarray(total.T), lost / 2

    try:
        return minimise(y, gradient_at, n_pairs, iters, adam, **more)
    finally:
        kept.unpersist()
        first.unpersist()
