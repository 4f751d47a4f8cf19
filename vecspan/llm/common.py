"""Shared pieces of the operators: word splitting, Arrow mapping and shared-storage tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspan.session import Stash, shared_dir  # noqa: F401 - re-exported for the operators

#: SQL pattern of a word: a run without ASCII white space. bytes.split() in Python splits at exactly these bytes.
WORD_SQL = r"[^\x20\x09-\x0D]+"

#: Rows of one Arrow batch; texts may be long, so batches stay small.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that none holds much more than SLICE_BYTES (one long row may)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * SLICE_BYTES / max(1, batch.column(column).nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], dict | pa.RecordBatch], schema: str | T.StructType, column: str = "text") -> DataFrame:
    """mapInArrow with f(batch) giving a dict of columns in the order of schema, for slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            out = f(batch)
            yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that are needed, under fixed names: other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def parallel(spark: SparkSession, least: int = 12) -> int:
    """Partitions for a keyed exchange: the session's setting, which a cluster sizes to its data."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
