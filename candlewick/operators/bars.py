"""Bar construction (B1-B7, G1, G2): cleaning fetched bars, aggregating ticks and resampling on the session grid.

Times are exchange wall times; a session runs from 09:15 to 15:30, and an hour bar starts at 09:15, 10:15, ... 15:15.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.plans.views import ohlcv

START, END = 555, 930  # minutes of the day


def minute(ts: str) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def at_minute(ts: str, minutes: Column) -> Column:
    """The day of ts at a minute of the day."""
    return F.date_trunc("day", F.col(ts)).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))


def bin_start(ts: str, length: int) -> Column:
    """The start of the session bin of `length` minutes that holds ts."""
    return at_minute(ts, START + F.floor((minute(ts) - START) / length) * length)


def in_session(ts: str) -> Column:
    return (minute(ts) >= START) & (minute(ts) < END)


def clean(bars: DataFrame, hourly: bool, arrival: str = "nth") -> DataFrame:
    """B1: bars without null time or price, hourly ones at the seven session starts only, daily ones at midnight; of bars with one
    time the last to arrive stays."""
    bars = bars.dropna(subset=["ts", "open", "high", "low", "close"])
    bars = bars.where(in_session("ts") & ((minute("ts") - START) % 60 == 0)) if hourly else bars.withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    last = Window.partitionBy("symbol", "ts").orderBy(F.col(arrival).desc())
    return bars.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def drop_forming(bars: DataFrame, now: Column, timeframe: str) -> DataFrame:
    """B2: without a series' last bar if that ends after `now`."""
    end = at_minute("ts", F.lit(END)) if timeframe == "1d" else F.least(F.col("ts") + F.expr("INTERVAL 1 HOUR"), at_minute("ts", F.lit(END)))
    latest = F.max("ts").over(Window.partitionBy("symbol"))
    return bars.withColumn("_last", latest).where(~((F.col("ts") == F.col("_last")) & (end > now))).drop("_last")


def resample(bars: DataFrame, hours: int = 4, now: Column | None = None) -> DataFrame:
    """Bars of `hours`, anchored at the session's start; bins that are not over at `now` are left out."""
    binned = bars.withColumn("bin", bin_start("ts", 60 * hours))
    sums = (F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").cast("long").alias("volume"))
    out = binned.groupBy("symbol", "bin").agg(*sums).withColumnRenamed("bin", "ts")
    end = F.least(F.col("ts") + F.make_dt_interval(hours=F.lit(hours)), at_minute("ts", F.lit(END)))
    return (out if now is None else out.where(end <= now)).select("symbol", "ts", "open", "high", "low", "close", "volume")


def from_ticks(ticks: DataFrame, length: int = 60) -> DataFrame:
    """Bars of `length` minutes from ticks or minute prices; those outside the session go, repeated ones are summed."""
    binned = ticks.where(in_session("ts")).withColumn("bin", bin_start("ts", length))
    return ohlcv(binned, ["symbol", "bin"], "price", "ts", "volume").withColumnRenamed("bin", "ts")


def round_volume(volume: Column) -> Column:
    """Half-even, null is 0."""
    return F.coalesce(F.rint(volume), F.lit(0.0)).cast("long")


def period_start(period: str, today: Column) -> Column:
    """The date a period (`5y`, `6mo`, `730d`; case and blanks do not count) before today."""
    text = period.strip().lower()
    for unit, back in (("mo", lambda n: F.add_months(today, -n)), ("y", lambda n: F.add_months(today, -12 * n)), ("d", lambda n: F.date_sub(today, n))):
        if text.endswith(unit) and text[: -len(unit)].isdigit():
            return back(int(text[: -len(unit)]))
    raise ValueError(f"not a period: {period!r}")


def stamp_daily(bars: DataFrame) -> DataFrame:
    """Daily bars start at 09:15."""
    return bars.withColumn("ts", at_minute("ts", F.lit(START)))


def watermarks(bars: DataFrame, overlap: int = 2) -> DataFrame:
    """last_ts of each series, and the day from which to fetch again."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    return last.withColumn("fetch_from", F.date_sub(F.to_date("last_ts"), overlap))


def bars_sql(ticks: str, minutes: int) -> str:
    return f"""SELECT symbol, date_trunc('day', ts) + to_minutes((555 + (((hour(ts)*60+minute(ts))-555)//{minutes})*{minutes})::INT) AS ts,
  arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(volume)::BIGINT AS volume FROM ({ticks}) GROUP BY 1, 2"""
