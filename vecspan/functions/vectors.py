"""Distances and vector arithmetic as JVM-side expressions over ARRAY<DOUBLE>.

Metrics: euclidean, cosine, manhattan, correlation, hamming (share of coordinates that differ by more than 1e-6),
angular (sqrt(2 - 2 cos)), sqeuclidean. An unknown name means euclidean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_NORM = 1e-10
DIFFERS = 1e-6


def fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def zip_fold(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return fold(F.zip_with(a, b, f))


def dot(a: Column, b: Column) -> Column:
    return zip_fold(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sqeuclidean(a: Column, b: Column) -> Column:
    return zip_fold(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sqeuclidean(a, b))


def cosine(a: Column, b: Column) -> Column:
    na, nb = norm(a), norm(b)
    return F.when((na < ZERO_NORM) | (nb < ZERO_NORM), 1.0).otherwise(1.0 - clamp(dot(a, b) / (na * nb), -1.0, 1.0))


def manhattan(a: Column, b: Column) -> Column:
    return zip_fold(a, b, lambda x, y: F.abs(x - y))


def centred(a: Column) -> Column:
    mean = fold(a) / F.size(a)
    return F.transform(a, lambda x: x - mean)


def correlation(a: Column, b: Column) -> Column:
    return cosine(centred(a), centred(b))


def hamming(a: Column, b: Column) -> Column:
    return zip_fold(a, b, lambda x, y: F.when(F.abs(x - y) > DIFFERS, 1.0).otherwise(0.0)) / F.size(a)


def angular(a: Column, b: Column) -> Column:
    return F.sqrt(F.greatest(2.0 - 2.0 * (1.0 - cosine(a, b)), F.lit(0.0)))


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "euclidean": euclidean,
    "cosine": cosine,
    "manhattan": manhattan,
    "correlation": correlation,
    "hamming": hamming,
    "angular": angular,
    "sqeuclidean": sqeuclidean,
}
#: Metric ids of the public interface.
METRIC_NAMES = {0: "euclidean", 1: "cosine", 2: "manhattan", 3: "correlation", 4: "hamming"}


def distance(metric: str | int) -> Callable[[Column, Column], Column]:
    name = METRIC_NAMES.get(metric, "euclidean") if isinstance(metric, int) else metric
    return METRICS.get(name, euclidean)


def hash_draw(*parts: Column | str | int) -> Column:
    """Counter-based random number: the first 8 hexadecimal digits of an MD5 digest as a long in [0, 2^32)."""
    cols = [F.lit(p) if isinstance(p, int | str) else p for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    return (hash_draw(*parts) + 0.5) / float(1 << 32)


def normal(*parts: Column | str | int) -> Column:
    """Standard normal numbers by Box and Muller's transform of two hashed uniforms."""
    return F.sqrt(-2.0 * F.log(uniform(*parts, "a"))) * F.cos(2.0 * F.lit(3.141592653589793) * uniform(*parts, "b"))
