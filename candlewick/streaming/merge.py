"""Late data: a stream of ticks merged into stored bars, however late a tick comes, each batch once.

A micro-batch is aggregated to parts of bars, which carry the times of their first and last tick.  A part and a stored bar of
the same window make one bar again, so no state is kept between batches and no tick is too late.  Only the days that a batch touches
are written anew.  The version that has a batch's rows names the batch, in the same log entry: a batch that is sent again after a
crash finds its number there and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candlewick.operators.bars import in_session
from candlewick.sources.tables import Store

KEYS = ["symbol", "ts"]


def parts(ticks: DataFrame, length: str = "1 hour", offset: str = "15 minutes") -> DataFrame:
    """symbol, ts, open, high, low, close, volume, first_at, last_at of the windows that ticks (symbol, ts, price, volume) fall in.
    Ticks of one time come in the order of their price."""
    at = F.struct("ts", "price")
    rows = ticks.where(in_session("ts")).groupBy("symbol", F.window("ts", length, None, offset)).agg(
        F.min(at).alias("a"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(at).alias("b"), F.sum("volume").cast("long").alias("volume"),
    )
    return rows.select("symbol", F.col("window.start").alias("ts"), F.col("a.price").alias("open"), "high", "low", F.col("b.price").alias("close"), "volume", F.col("a").alias("first_at"), F.col("b").alias("last_at"))


def joined(bars: DataFrame) -> DataFrame:
    """One bar for all parts of a window."""
    whole = bars.groupBy(*KEYS).agg(
        F.min("first_at").alias("first_at"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last_at").alias("last_at"), F.sum("volume").cast("long").alias("volume"),
    )
    return whole.select(*KEYS, F.col("first_at.price").alias("open"), "high", "low", F.col("last_at.price").alias("close"), "volume", "first_at", "last_at")


def merge(store: Store, table: str, fresh: DataFrame, stream: str, batch: int) -> bool:
    """Merges parts of bars into the stored ones, as batch number `batch` of a stream; False if the batch is in already."""
    base = store.version()
    done = base.note.get("streams", {})
    if done.get(stream, -1) >= batch:
        return False
    fresh = fresh.withColumn("day", F.to_date("ts"))
    days = [str(r.day) for r in fresh.select("day").distinct().collect()]  # the days of one micro-batch
    old = store.read_parts(table, days, base)
    rows = fresh if old is None else fresh.unionByName(old)
    note = {"streams": done | {stream: batch}}
    store.publish_parts(table, joined(rows).withColumn("day", F.to_date("ts")), "day", note, base)
    return True


def merge_stream(ticks: DataFrame, store: Store, table: str, stream: str, checkpoint: str, length: str = "1 hour", offset: str = "15 minutes") -> StreamingQuery:
    """Merges a stream of ticks, batch by batch, and stops when the input is read."""

    def each(batch: DataFrame, number: int) -> None:
        merge(store, table, parts(batch, length, offset), stream, number)

    return ticks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_bars(store: Store, table: str) -> DataFrame:
    """symbol, ts, open, high, low, close, volume of all days."""
    rows = store.read_parts(table)
    if rows is None:
        raise KeyError(f"{store.root} has no table {table}")
    return rows.select(*KEYS, "open", "high", "low", "close", "volume")
