"""Sources: point clouds in CSV (also zipped), a binary image container (also zipped), and synthetic tables."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.functions.vectors import hash_draw, normal, uniform

# Fixed values of the container format: magic, number of header bytes, and the header's little-endian layout
# (magic, version, images, rows, columns, labels, reserved).
MAGIC = b"MNST"
HEADER_BYTES = 32
HEADER = "<4s5iq"


def csv_points(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """x, y, z of a CSV file; header lines (0,1,2 or x,y,z) and empty lines are skipped, other broken lines fail. limit: the
    first points of the file."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if limit:
        lines = lines.select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("at"), F.monotonically_increasing_id().alias("line"))
    lines = lines.where(~F.lower(F.regexp_replace("value", r"\s", "")).rlike(r"^(0,1,2|x,y,z)(,|$)"))
    cols = F.split("value", ",")
    ok = F.when(F.size(cols) >= 3, cols).otherwise(F.raise_error(F.lit("a line has fewer than three fields")))
    if limit:
        lines = lines.orderBy("file", "at", "line").limit(limit)
    return lines.select(*[F.trim(ok[k]).cast("double").alias(c) for k, c in enumerate("xyz")])


def _first(raw: bytes, suffix: str) -> bytes:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        name = next(n for n in z.namelist() if n.lower().endswith(suffix))
        return z.read(name)


def zipped_csv_points(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z of the first .csv in each zip file; files are read by Spark, one task each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                rows = [x.split(",") for x in _first(raw, ".csv").decode().splitlines() if x.strip()]
                if rows and [c.strip().lower() for c in rows[0][:3]] in (["x", "y", "z"], ["0", "1", "2"]):
                    rows = rows[1:]
                a = np.array([[float(c) for c in r[:3]] for r in rows]).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(a[:, k]) for k in range(3)], list("xyz"))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "x double, y double, z double")


def parse_container(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Pixels (n, rows * columns) and labels; a label count of 0 or one that exceeds the file is repaired from its size."""
    magic, _, n, rows, cols, n_labels, _ = struct.unpack(HEADER, raw[:HEADER_BYTES])
    if magic != MAGIC:
        raise ValueError("not an image container")
    rows, cols = rows or 28, cols or 28
    left, size = len(raw) - HEADER_BYTES, rows * cols
    if n <= 0 or n * size > left:
        n = left // (size + 1)
    n_labels = n if n_labels <= 0 or n * size + n_labels > left else n_labels
    pixels = np.frombuffer(raw, np.uint8, n * size, HEADER_BYTES).reshape(n, size)
    labels = np.frombuffer(raw, np.uint8, min(n_labels, left - n * size), HEADER_BYTES + n * size)
    return pixels, labels


def images(spark: SparkSession, path: str) -> DataFrame:
    """file, id (place in its file), features ARRAY<DOUBLE>, label of containers and zipped containers (.dat)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                pixels, labels = parse_container(_first(raw, ".dat") if raw[:2] == b"PK" else raw)
                for at in range(0, len(pixels), 1000):
                    part = pixels[at : at + 1000].astype(np.float64)
                    own = [int(x) for x in labels[at : at + len(part)]] + [None] * max(0, at + len(part) - max(at, len(labels)))
                    cols = [pa.array([path_] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(list(part), pa.list_(pa.float64())), pa.array(own[: len(part)], pa.int32())]
                    yield pa.RecordBatch.from_arrays(cols, ["file", "id", "features", "label"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, id long, features array<double>, label int")


def digit_patterns(spark: SparkSession, n: int = 1000, d: int = 784, seed: int = 42) -> DataFrame:
    """Synthetic digits: level 0.1 (i mod 10), noise within 0.05."""
    noise = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda k: 0.1 * (F.col("id") % 10) + 0.1 * (uniform(str(seed), F.col("id"), k) - 0.5))
    return spark.range(min(n, 1000)).select("id", noise.alias("features"), (F.col("id") % 10).cast("int").alias("label"))


PATTERNS = ("standard", "sparse", "binary", "clustered", "correlated", "outliers")


def pattern(spark: SparkSession, kind: str, n: int, d: int, seed: int = 42) -> DataFrame:
    """id, features of a synthetic table: normal; 20 % normal and the rest 0; 0 or 1; three centres; correlated; far outliers."""
    key = F.col("id")

    def cell(k):
        z, u = normal(str(seed), kind, key, k), uniform(str(seed), kind, "u", key, k)
        if kind == "standard":
            return z
        if kind == "sparse":
            return F.when(u < 0.2, z).otherwise(0.0)
        if kind == "binary":
            return F.when(u < 0.5, 0.0).otherwise(1.0)
        if kind == "clustered":
            return (hash_draw(str(seed), "centre", key) % 3 - 1) * 2.0 + 0.5 * z
        if kind == "correlated":
            return 0.7 * normal(str(seed), "base", key) + 0.3 * z
        return F.when(u < 0.5, -1.0).otherwise(1.0) * (10.0 + 5.0 * uniform(str(seed), kind, "size", key, k))

    if kind not in PATTERNS:
        raise ValueError(f"unknown pattern {kind!r}")
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), cell).alias("features"))


# Fixed values of the part rules, as shares of each axis' range: feet below, legs below, head's margin in x, head and
# trunk below in y, head above in z; tusks beyond in x, above in z, and within this distance of the middle in y.
FEET, LEGS, MARGIN, FRONT, UPPER = 0.08, 0.28, 0.36, 0.415, 0.5
TUSK_X, TUSK_Z, TUSK_Y = 0.9, 0.85, 0.1


def body_parts(points: DataFrame) -> DataFrame:
    """points (x, y, z) plus part: feet, legs, head, trunk, tusks or body. Head overrides legs and feet, trunk
    only takes what is body, tusks are cut out of the trunk."""
    e = points.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    span = {c: (e[f"hi_{c}"] or 0.0) - (e[f"lo_{c}"] or 0.0) for c in "xyz"}
    low, high = {c: e[f"lo_{c}"] or 0.0 for c in "xyz"}, {c: e[f"hi_{c}"] or 0.0 for c in "xyz"}
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    left, right, front = low["x"] + span["x"] * MARGIN, high["x"] - span["x"] * MARGIN, low["y"] + span["y"] * FRONT
    feet, legs = z < low["z"] + span["z"] * FEET, z < low["z"] + span["z"] * LEGS
    head = x.between(left, right) & (y < front) & (z > low["z"] + span["z"] * UPPER)
    trunk = ((x < left) | (x > right)) & (y < front)
    tusks = (x > low["x"] + span["x"] * TUSK_X) & (z > low["z"] + span["z"] * TUSK_Z) & (F.abs(y - (low["y"] + high["y"]) / 2) < span["y"] * TUSK_Y)
    part = F.when(head, "head").when(feet, "feet").when(legs, "legs").when(trunk & tusks, "tusks").when(trunk, "trunk").otherwise("body")
    return points.withColumn("part", part)


def encoded_labels(rows: DataFrame, col: str, id_col: str = "id") -> DataFrame:
    """rows plus label: codes of col in order of first appearance. There is one code row per distinct value."""
    first = rows.groupBy(col).agg(F.min(id_col).alias("first"))
    from pyspark.sql import Window as W

    codes = first.withColumn("label", F.row_number().over(W.partitionBy().orderBy("first")) - 1).select(F.col(col).alias("__v"), "label")
    return rows.join(codes, rows[col].eqNullSafe(F.col("__v"))).drop("__v")
