"""Streaming projection: an extension beyond batch use. New rows are placed and scored per micro-batch against a fixed model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecspan.operators.model import EmbeddingModel


def score_stream(stream: DataFrame, model: EmbeddingModel, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """stream: id, features. sink gets each batch's transform_with_safety() and the batch's number."""
    writer = stream.writeStream.foreachBatch(lambda df, epoch: sink(model.transform_with_safety(df), epoch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def severity_windows(scored: DataFrame, time_col: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of outlier levels per time window, for a stream or a table with a time column."""
    return scored.withWatermark(time_col, late).groupBy(F.window(time_col, width), "outlier_level").agg(F.count("*").alias("n"))
