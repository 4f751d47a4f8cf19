"""Scalar rules of the embedding: phase weights, learning rates, pair counts, recommendations and formats."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


# Names of the phases.
PHASES = ("Phase 1: Global Structure", "Phase 2: Balance", "Phase 3: Local Structure")


def phase_weights(it: Column, p1: int = 100, p2: int = 100) -> tuple[Column, Column, Column]:
    """Weights of near, mid-range and far pairs at iteration it."""
    first, second = it < p1, it < p1 + p2
    near = F.when(first, 2.0).when(second, 3.0).otherwise(1.0)
    mid = F.when(first, 1000.0 + (3.0 - 1000.0) * it / float(p1)).when(second, 3.0).otherwise(0.0)
    return near, mid, F.lit(1.0)


def weights_at(it: int, p1: int = 100, p2: int = 100) -> tuple[float, float, float]:
    if it < p1:
        return 2.0, 1000.0 + (3.0 - 1000.0) * it / p1, 1.0
    return (3.0, 3.0, 1.0) if it < p1 + p2 else (1.0, 0.0, 1.0)


def phase_name(it: Column, p1: int = 100, p2: int = 100) -> Column:
    return F.when(it < p1, PHASES[0]).when(it < p1 + p2, PHASES[1]).otherwise(PHASES[2])


def interpolated(it: Column, total: int, start: float, end: float) -> Column:
    return start + (end - start) * it / float(total)


def stagnation_rate(lr: Column, loss: Column, previous: Column, still: Column) -> Column:
    """10 % down after more than ten iterations without change (still), 2 % up when the loss fell."""
    flat = F.abs(loss - previous) < 1e-8
    return F.when(flat & (still > 10), lr * 0.9).when(~flat & (loss < previous), lr * 1.02).otherwise(lr)


def cosine_rate(lr: float, it: Column, total: int) -> Column:
    return lr * 0.5 * (1.0 + F.cos(F.lit(math.pi) * it / float(total)))


def step_rate(lr: float, it: Column, factor: float, every: int) -> Column:
    return lr * F.pow(F.lit(factor), F.floor(it / every).cast("double"))


def adaptive_rate(lr: Column, loss: Column, previous: Column) -> Column:
    """5 % down when the loss rose, 2 % up when it fell by more than 1e-6, within [1e-6, 10]."""
    moved = F.when(loss > previous, lr * 0.95).when(loss - previous < -1e-6, lr * 1.02).otherwise(lr)
    return F.greatest(F.lit(1e-6), F.least(F.lit(10.0), moved))


def recommended_neighbors(n: Column) -> Column:
    """10 up to 10,000 rows, then 15 more for each power of ten, within [10, 100]."""
    k = F.floor(10.0 + 15.0 * (F.log10(n.cast("double")) - 4.0))
    return F.greatest(F.lit(10), F.least(F.lit(100), k)).cast("int")


@dataclass(frozen=True)
class PairCounts:
    near: int
    mid: int
    far: int


def pair_counts(n: int, k: int, mn_ratio: float, fp_ratio: float) -> PairCounts:
    """Pairs per row; fractions are cut off. Rejects counts that n rows cannot serve."""
    if not 0 < k < n:
        raise ValueError(f"neighbours must be in 1..{n - 1}, got {k}")
    if mn_ratio < 0 or fp_ratio < 0:
        raise ValueError("pair ratios must not be negative")
    most = min(n * (n - 1) // 2, 1 << 30) // n
    mid, far = int(k * mn_ratio), int(k * fp_ratio)
    return PairCounts(k, min(mid, max(most, 0)), min(far, n - 1 - k))


def rounded_pair_counts(n: int, k: int | None, mn_ratio: float, fp_ratio: float) -> PairCounts:
    """The variant that rounds: k defaults to the recommendation, counts shrink until they fit n rows."""
    if k is None:
        k = 10 if n <= 10000 else int(round(10 + 15 * (math.log10(n) - 4)))
    mid, far = int(round(k * mn_ratio)), int(round(k * fp_ratio))
    k, mid, far = min(k, n - 1), min(mid, n - 1), min(far, n - 1)
    if k + mid + far >= n:
        share = (n - 1) / (k + mid + far)
        k, mid, far = (int(x * share) for x in (k, mid, far))
    if k < 1 or far < 1:
        raise ValueError("too few rows for the pairs asked for")
    return PairCounts(k, mid, far)


def nice_step(span: Column, ticks: int = 8, least: float = 0.1) -> Column:
    """Axis step of 1, 2 or 5 times a power of ten for about this many ticks; 1 for an empty range."""
    rough = span / float(ticks)
    power = F.pow(F.lit(10.0), F.floor(F.log10(rough)).cast("double"))
    lead = F.when(power >= rough, 1.0).when(2.0 * power >= rough, 2.0).otherwise(5.0)
    return F.when(span > 0, F.greatest(lead * power, F.lit(least))).otherwise(1.0)


def format_bytes(n: Column) -> Column:
    """Bytes with two decimals in the largest unit up to TB that leaves 1 or more."""
    out = F.concat(F.format_string("%.2f", n / 1024.0**4), F.lit(" TB"))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(n < 1024 ** (k + 1), F.concat(F.format_string("%.2f", n / 1024.0**k), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_duration(ms: float) -> str:
    if ms < 1000:
        return f"{int(ms)} ms"
    return f"{int(ms / 1000)} s" if ms < 60000 else f"{int(ms / 60000)} min {int(ms % 60000 / 1000)} s"


def memory_estimate(n: int, d: int, components: int, pairs: int) -> int:
    """Bytes of the dense input, the embedding with two moments, and the pairs."""
    return 8 * n * d + 3 * 8 * n * components + 20 * pairs


STRATEGIES = {
    "standard": {"lr": 1.0, "iterations": 1.0, "far": 1.0},
    "fast": {"lr": 1.5, "iterations": 0.7, "far": 1.0},
    "accurate": {"lr": 0.8, "iterations": 1.3, "far": 1.0},
    "memory": {"lr": 1.0, "iterations": 1.0, "far": 0.8},
}


def remaining(now: int, total: int, seconds: float) -> str:
    """Time left at the rate so far."""
    if not now or seconds <= 0:
        return "unknown"
    return format_duration((total - now) * seconds / now * 1000)


def complexity_note(n: int, d: int) -> str:
    """What to expect of an exact neighbour join; empty below 10^9 operations."""
    work = n * n * d
    if work > 1e11:
        return "warning: hours; consider the ivf mode"
    return "notice: several minutes" if work > 1e9 else ""


def neighbor_warning(k: int, n: int) -> str:
    """Warns of fewer neighbours than recommended: 10 below 10,000 rows, then 15 more for each power of ten."""
    least = 10 if n < 10000 else max(10, min(100, int(10 + 15 * (math.log10(n) - 4))))
    return f"{k} neighbours, {least} or more are recommended for {n} rows" if k < least else ""


def tuned(n: int, neighbors: int, lr: float, mn_ratio: float, iters: tuple[int, int, int]) -> dict:
    """Settings for the size: few rows take fewer neighbours and smaller steps, many rows fewer iterations."""
    if n < 100:
        neighbors, lr, mn_ratio = max(1, min(neighbors, n // 2)), min(lr, 0.5), max(mn_ratio, 0.2)
    elif n > 10000:
        neighbors = min(neighbors, 50)
    if n < 1000:
        lr *= 0.8
    if n > 5000:
        iters = (min(iters[0], 50), min(iters[1], 50), min(iters[2], 100))
    return {"neighbors": neighbors, "lr": lr, "mn_ratio": mn_ratio, "iters": iters}
