"""The steps of a fit on matrices, for tables that fit one process. Draws, orders and ties are those of the DataFrame forms
in normalize, knn, pairs and stats; rows are positions 0..n-1."""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

import numpy as np

from vecspan.operators.knn import row_distances, top_k
from vecspan.operators.normalize import Scaling
from vecspan.operators.pairs import CANDIDATES, FAR, MID, NEAR

#: Rows whose mid-range candidates are measured at a time.
STEP = 512


def fit_scaling(x: np.ndarray) -> Scaling:
    lo, hi = float(x.min()), float(x.max())
    if hi == 0:
        raise ValueError("the largest value is 0, so the data cannot be scaled by it")
    return Scaling(lo, hi, tuple(float(m) for m in ((x - lo) / hi).mean(0)))


#: Widths up to which, and rows from which, neighbours are looked for among near boxes only; rows of a box.
FLAT, MANY, BOX = 3, 1 << 13, 1 << 10


def boxes(x: np.ndarray) -> list[np.ndarray]:
    """Rows in groups of at most BOX, by halving along the widest side."""
    out, left = [], [np.arange(len(x))]
    while left:
        at = left.pop()
        if len(at) <= BOX:
            out.append(at)
            continue
        side, half = int(np.argmax(np.ptp(x[at], axis=0))), len(at) // 2
        at = at[np.argpartition(x[at, side], half)]
        left += [at[:half], at[half:]]
    return out


def bounds(x: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest corners of the boxes."""
    return tuple(np.stack([f(x[at], axis=0) for at in groups]) for f in (np.min, np.max))


def near_in_boxes(x: np.ndarray, groups: list[np.ndarray], low: np.ndarray, high: np.ndarray, g: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and distances of the k nearest others of the rows of box g: they lie in boxes no further away than the k nearest
    in the own box, so no other box is read."""
    own = groups[g]
    inside = top_k(own, x[own], own, x[own], k, "euclidean", True)[2]
    reach = inside.max() if len(inside) == k * len(own) else np.inf
    gap = np.maximum(np.maximum(low - high[g], low[g] - high), 0)
    near = np.flatnonzero(np.sqrt((gap * gap).sum(1)) <= reach * (1 + 1e-9) + 1e-12)
    base = np.concatenate([groups[b] for b in near])
    _, j, dist = top_k(own, x[own], base, x[base], k, "euclidean", True)
    return j.reshape(len(own), -1), dist.reshape(len(own), -1)


def flat(n: int, d: int, k: int, metric: str) -> bool:
    """Whether neighbours are looked for among near boxes."""
    return metric == "euclidean" and d <= FLAT and n > MANY and k < BOX // 4


def _near_boxes(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """neighbors() of flat tables."""
    groups = boxes(x)
    low, high = bounds(x, groups)
    out_j, out_d = np.empty((len(x), k), np.int64), np.empty((len(x), k))

    def one(g: int) -> None:
        out_j[groups[g]], out_d[groups[g]] = near_in_boxes(x, groups, low, high, g, k)

    with ThreadPoolExecutor() as pool:
        list(pool.map(one, range(len(groups))))
    return out_j, out_d


def neighbors(x: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows (n, k) and distances (n, k) of the nearest others, by (distance, row)."""
    if flat(len(x), x.shape[1], k, metric):
        return _near_boxes(x, k)
    ids = np.arange(len(x))
    cuts = np.linspace(0, len(x), 1 + min(len(x), 2 * (os.cpu_count() or 1)), dtype=int)
    with ThreadPoolExecutor() as pool:
        parts = list(pool.map(lambda c: top_k(ids[c[0] : c[1]], x[c[0] : c[1]], ids, x, k, metric, True), zip(cuts, cuts[1:])))
    return tuple(np.concatenate([p[c] for p in parts]).reshape(len(x), k) for c in (1, 2))


class Lists:
    """Neighbour lists that several fits of one table share: found once with the most neighbours, cut for each fit."""

    def __init__(self, most: int):
        self.most, self.kept = most, {}

    def get(self, x: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
        if k > self.most:
            return neighbors(x, k, metric)
        if metric not in self.kept or self.kept[metric][0].shape != x.shape or not np.array_equal(self.kept[metric][0], x):
            self.kept[metric] = (x, *neighbors(x, min(self.most, len(x) - 1), metric))
        return tuple(a[:, :k] for a in self.kept[metric][1:])


def local_scale(dist: np.ndarray) -> np.ndarray:
    m = dist.shape[1]
    if m < 3:
        sigma = np.ones(len(dist))
    elif m >= 6:
        sigma = dist[:, 3:6].sum(1) / 3
    else:
        sigma = dist[:, 3:].sum(1) / (m - 3) if m > 3 else dist[:, -1]
    return np.maximum(sigma, 1e-10)


def near_pairs(j: np.ndarray, dist: np.ndarray, k: int, sigma: np.ndarray | None = None) -> np.ndarray:
    """The k rows of each row with the least scaled distance. sigma: the scales of all rows, where j and dist are not theirs."""
    own = local_scale(dist)
    sigma = own if sigma is None else sigma
    order = np.lexsort((j, dist * dist / (own[:, None] * sigma[j])), axis=-1)[:, :k]
    return np.take_along_axis(j, order, 1)


def draws(n: int, count: int, tries: int, seed: int, what: str, barred: list[set[int]], rows: Iterable[int] | None = None) -> list[list[int]]:
    """The first count distinct rows of each row's tries draws, other than itself and its barred rows. rows: those that draw,
    in the order of barred; else all."""
    prefix, ends, out, md5 = f"{seed}|{what}|", [f"|{t}".encode() for t in range(tries)], [], hashlib.md5
    for i, away in zip(range(n) if rows is None else rows, barred):
        own, got, start = away | {i}, [], f"{prefix}{i}".encode()
        for end in ends:
            j = int.from_bytes(md5(start + end).digest()[:4]) % n
            if j not in own:
                own.add(j)
                got.append(j)
                if len(got) == count:
                    break
        out.append(got)
    return out


def far_pairs(near: list[set[int]], n: int, count: int, seed: int, oversample: int = 4, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    got = draws(n, count, count * oversample + 16, seed, "far", near, None if rows is None else rows.tolist())
    return np.repeat(np.arange(n) if rows is None else rows, [len(g) for g in got]), np.array([j for g in got for j in g], np.int64)


def mid_pairs(x: np.ndarray, count: int, seed: int, metric: str, oversample: int = 2, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    n = len(x)
    if count and n - 1 < CANDIDATES:
        raise ValueError(f"mid-range pairs need more than {CANDIDATES} rows")
    count = min(count, (n - 1) // CANDIDATES)
    every = np.arange(n) if rows is None else rows
    got = draws(n, count * CANDIDATES, count * CANDIDATES * oversample + 16, seed, "mid", [set()] * len(every), every.tolist())
    out_i, out_j = [], []
    for at in range(0, len(every), STEP):
        part = got[at : at + STEP]
        lens = [len(g) for g in part]
        i, j = np.repeat(every[at : at + STEP], lens), np.array([b for g in part for b in g], np.int64)
        slot = np.concatenate([np.arange(m) // CANDIDATES for m in lens]) if lens else np.zeros(0, np.int64)
        dist = row_distances(x, i, x, j, metric)
        order = np.lexsort((j, dist, slot, i))
        i, j, slot = i[order], j[order], slot[order]
        first = np.concatenate(([True], (i[1:] != i[:-1]) | (slot[1:] != slot[:-1])))
        second = np.flatnonzero(first[:-1] & ~first[1:]) + 1 if len(first) > 1 else np.zeros(0, np.int64)
        out_i.append(i[second])
        out_j.append(j[second])
    return np.concatenate(out_i), np.concatenate(out_j)


def sample_pairs(x: np.ndarray, counts, extra: int, metric: str, seed: int, near: np.ndarray | None = None, lists: Lists | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, kind. near: (i, j) rows of given neighbour pairs, in place of sampled ones."""
    n = len(x)
    if near is None:
        j, dist = (lists.get if lists else neighbors)(x, min(counts.near + extra, n - 1), metric)
        own = near_pairs(j, dist, counts.near)
        near = np.stack((np.repeat(np.arange(n), own.shape[1]), own.ravel()))
    barred: list[set[int]] = [set() for _ in range(n)]
    for a, b in zip(*near.tolist()):
        barred[a].add(b)
    none = (np.zeros(0, np.int64),) * 2
    mid = mid_pairs(x, counts.mid, seed, metric) if counts.mid else none
    far = far_pairs(barred, n, counts.far, seed) if counts.far else none
    i, j = (np.concatenate((near[k], mid[k], far[k])) for k in (0, 1))
    return i, j, np.repeat([NEAR, MID, FAR], [near.shape[1], len(mid[0]), len(far[0])])


def initial(n: int, components: int, deviation: float, seed: int) -> np.ndarray:
    """Small normal numbers, by the hash of (seed, row, component)."""
    out = np.empty((n, components))
    for i in range(n):
        for c in range(components):
            a, b = ((int(hashlib.md5(f"{seed}|init|{i}|{c}|{x}".encode()).hexdigest()[:8], 16) + 0.5) / (1 << 32) for x in "ab")
            out[i, c] = math.sqrt(-2.0 * math.log(a)) * math.cos(2.0 * 3.141592653589793 * b)
    return out * deviation


def distance_stats(dist: np.ndarray) -> dict[str, float]:
    d = np.sort(dist.ravel())
    mean, deviation = float(d.mean()), float(d.std())
    p95, p99 = (float(d[min(int(len(d) * p), len(d) - 1)]) for p in (0.95, 0.99))
    return {"least": float(d[0]), "p95": p95, "p99": p99, "mean": mean, "deviation": deviation, "mild": mean + 2.5 * deviation, "extreme": mean + 4.0 * deviation}
