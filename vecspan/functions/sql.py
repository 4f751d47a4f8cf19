"""The distances as SQL functions, so that queries and filters written in SQL can use them."""

from __future__ import annotations

from pyspark.sql import SparkSession

_FOLD = "aggregate({}, CAST(0 AS DOUBLE), (s, x) -> s + x)"


def _zip(a: str, b: str, body: str) -> str:
    return _FOLD.format(f"zip_with({a}, {b}, (x, y) -> {body})")


def _cosine(a: str, b: str) -> str:
    dot, na, nb = _zip(a, b, "x * y"), f"sqrt({_zip(a, a, 'x * y')})", f"sqrt({_zip(b, b, 'x * y')})"
    return f"CASE WHEN {na} < 1e-10 OR {nb} < 1e-10 THEN CAST(1 AS DOUBLE) ELSE 1 - least(greatest({dot} / ({na} * {nb}), -1), 1) END"


_CENTRED = "transform({0}, x -> x - " + _FOLD.format("{0}") + " / size({0}))"

FUNCTIONS = {
    "vec_dot": _zip("a", "b", "x * y"),
    "vec_sqeuclidean": _zip("a", "b", "(x - y) * (x - y)"),
    "vec_euclidean": f"sqrt({_zip('a', 'b', '(x - y) * (x - y)')})",
    "vec_manhattan": _zip("a", "b", "abs(x - y)"),
    "vec_hamming": _zip("a", "b", "CASE WHEN abs(x - y) > 1e-6 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END") + " / size(a)",
    "vec_cosine": _cosine("a", "b"),
    "vec_correlation": _cosine(_CENTRED.format("a"), _CENTRED.format("b")),
    "vec_angular": f"sqrt(greatest(2 - 2 * (1 - ({_cosine('a', 'b')})), 0))",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions for the session; their names. Each takes two ARRAY<DOUBLE> and is inlined by the optimizer."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    return sorted(FUNCTIONS)
