"""Bars from a stream of ticks: watermarked tumbling windows on the session grid.

A window is emitted once the watermark has passed its end: the same bars as the batch aggregation gives for complete windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candlewick.operators.bars import in_session


def tick_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Parquet files of a folder as they come; schema: symbol string, ts timestamp, price double, volume bigint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_bars(ticks: DataFrame, length: str = "1 hour", offset: str = "15 minutes", late: str = "2 days") -> DataFrame:
    """symbol, ts, open, high, low, close, volume of each closed window that starts on the session grid (09:15 plus lengths; use an
    offset of 1 hour 15 minutes for 4 hours)."""
    windows = ticks.where(in_session("ts")).withWatermark("ts", late).groupBy("symbol", F.window("ts", length, None, offset))
    out = windows.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").cast("long").alias("volume"))
    return out.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def write_stream(bars: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends closed bars to Parquet, exactly once with the checkpoint, and stops when the input is read."""
    return bars.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
