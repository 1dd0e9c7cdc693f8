"""Series that grow: granules arrive as a stream of chunk rows and append along a dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_chunks(stream: DataFrame, steps: int, below: int, to: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of (member, array_path, chunk_lin, ...) rows, each member's chunks moved to
    their place behind the members before it.

    Every member has `steps` chunks along the first dimension and `below` chunks to one step of
    it, so the place is arithmetic and a late member needs no rewrite.
    """
    moved = stream.withColumn("chunk_lin", F.col("chunk_lin") + F.col("member") * (steps * below))
    return moved.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_series(events: DataFrame, every: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Chunk statistics of an event stream by type and time window, with a watermark for late rows."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
