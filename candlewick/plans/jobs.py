"""Job control as dataset functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.calendar import with_session

#: The steps in their order.
STEPS = ("reap", "ingest", "reconcile", "indicators", "signals", "actions", "broker", "ledger", "evaluate")
REQUESTS = 13  # that a full history of one symbol takes


def reap(runs: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """Runs that are `running` for longer become failed."""
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.make_dt_interval(hours=F.lit(hours)))
    return runs.withColumns({"message": F.when(stale, f"no end after {hours} h").otherwise(F.col("message")), "status": F.when(stale, "failed").otherwise(F.col("status"))})


def is_due(jobs: DataFrame, now: str, days: DataFrame) -> DataFrame:
    """Adds due: enabled, a trading day, the clock at or past `at` (HH:MM), and not run today."""
    df = with_session(jobs.withColumn("_today", F.to_date(now)), "_today", days, "_d_")
    due = F.col("enabled") & F.coalesce("_d_is_trading_day", F.lit(False)) & (F.date_format(now, "HH:mm") >= F.col("at")) & F.coalesce(F.to_date("last_run") < F.col("_today"), F.lit(True))
    return df.select(*jobs.columns, due.alias("due"))


def recheck_set(checks: DataFrame) -> DataFrame:
    """D3: symbols whose signals are to be made again."""
    return checks.where("changed").select("symbol_id").distinct()


def ingest_plan(symbols: DataFrame, watermarks: DataFrame, full_start: Column, restated: DataFrame) -> DataFrame:
    """Mode (full, incremental, rebuild) and start of each symbol."""
    df = symbols.join(watermarks, "symbol", "left").join(restated.select("symbol", F.lit(True).alias("_r")).distinct(), "symbol", "left")
    mode = F.when(F.col("last_ts").isNull(), "full").when(F.col("_r"), "rebuild").otherwise("incremental")
    return df.withColumn("mode", mode).withColumn("start", F.when(F.col("mode") == "incremental", F.col("fetch_from")).otherwise(full_start)).drop("_r")


def step_status(runs: DataFrame) -> DataFrame:
    """Adds outcome."""
    return runs.withColumn("outcome", F.when(F.col("status") == "failed", "failed").when((F.col("status") != "completed") | (F.coalesce("failures", F.lit(0)) > 0), "warning").otherwise("ok"))


def step_summary(runs: DataFrame) -> DataFrame:
    """Runs by outcome, and whether any failed."""
    return step_status(runs).groupBy("outcome").agg(F.count("*").alias("n")).withColumn("bad", F.col("outcome") == "failed")


def parse_steps(text: str) -> list[str]:
    """The named steps in their own order, each once."""
    asked = {s.strip() for s in text.split(",") if s.strip()}
    if unknown := asked - set(STEPS):
        raise ValueError(f"unknown steps: {', '.join(sorted(unknown))}")
    return [s for s in STEPS if s in asked]


def settings(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """Defaults with stored values for known keys."""
    return defaults.join(stored.withColumnRenamed("value", "_v"), "key", "left").select("key", F.coalesce("_v", "value").alias("value"))


def merge_universe(old: DataFrame, new: DataFrame) -> DataFrame:
    """Symbols of both; empty new values keep the old ones, symbols on the list are active; adds change."""
    given = ["name", "industry", "isin"]
    n = new.select("symbol", *(F.nullif(F.trim(F.col(c)), F.lit("")).alias("n_" + c) for c in given), F.lit(True).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(n, "symbol", "full")
    change = F.when(F.col("_old").isNull(), "created").when(F.col("_new"), "updated").otherwise("kept")
    return both.select("symbol", *(F.coalesce("n_" + c, c).alias(c) for c in given), F.coalesce("_new", "active").alias("active"), change.alias("change"))


def request_estimate(n_symbols: int, per_second: float = 3.0) -> tuple[int, float]:
    """Requests and seconds of a full rebuild."""
    return n_symbols * REQUESTS, n_symbols * REQUESTS / per_second


def sync_status(message: Column) -> Column:
    """D14."""
    return F.when(message.isNull(), "ok").when(message.rlike("(?i)auth|token"), "auth_failed").otherwise("error")


def cutover_plan(bars: DataFrame, symbols: DataFrame, source: str, frames: tuple[str, ...] = ("1d", "1h", "4h")) -> DataFrame:
    """Adds done: each timeframe has rows, and none from another source."""
    counts = bars.groupBy("symbol_id", "timeframe").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("source") != source, 1).otherwise(0)), F.lit(0)).alias("foreign_n"))
    clean = counts.where(F.col("timeframe").isin(*frames) & (F.col("n") > 0)).groupBy("symbol_id").agg(F.count("*").alias("_frames"), F.sum("foreign_n").alias("_foreign"))
    done = F.coalesce((F.col("_frames") == len(frames)) & (F.col("_foreign") == 0), F.lit(False))
    return symbols.join(clean, "symbol_id", "left").withColumn("done", done).drop("_frames", "_foreign")


def counts_by_timeframe(signals: DataFrame, frames: tuple[str, ...] = ("1h", "4h", "1d")) -> DataFrame:
    """Rows of each timeframe, 0 where there are none."""
    spark = signals.sparkSession
    every = spark.createDataFrame([(t,) for t in frames], "timeframe string")
    return every.join(signals.groupBy("timeframe").agg(F.count("*").alias("n")), "timeframe", "left").select("timeframe", F.coalesce("n", F.lit(0)).alias("n"))


def resample_gaps(made: DataFrame, stored: DataFrame) -> DataFrame:
    """Of bars made from hourly ones, how many are not stored, and how many are stored with other values."""
    s = stored.select("symbol", "ts", *(F.col(c).alias("s_" + c) for c in ("open", "high", "low", "close", "volume")))
    df = made.join(s, ["symbol", "ts"], "left")
    differs = reduce(lambda a, b: a | b, (F.abs(F.col(c) - F.col("s_" + c)) > 1e-9 for c in ("open", "high", "low", "close", "volume")))
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("s_close").isNull()).alias("missing"), F.count_if(differs).alias("wrong"))


def orphans(stored: DataFrame, hourly: DataFrame, hours: int = 4) -> DataFrame:
    """Stored bars without any hourly bar in [ts, ts + hours), on the session grid or off it.  They meet on whole hours."""
    hour = lambda c: F.date_trunc("hour", c).cast("timestamp_ntz")
    spread = stored.select("symbol", "ts").withColumn("_hour", F.explode(F.sequence(hour(F.col("ts")), hour(F.col("ts") + F.make_dt_interval(hours=F.lit(hours))), F.make_dt_interval(hours=F.lit(1)))))
    below = hourly.select("symbol", F.col("ts").alias("_ts"), hour(F.col("ts")).alias("_hour"))
    backed = spread.join(below, ["symbol", "_hour"]).where((F.col("_ts") >= F.col("ts")) & (F.col("_ts") < F.col("ts") + F.make_dt_interval(hours=F.lit(hours))))
    return stored.join(backed.select("symbol", "ts").distinct(), ["symbol", "ts"], "left_anti")


def without_hourly(bars: DataFrame) -> DataFrame:
    """Symbols that have daily but no hourly bars."""
    return bars.where("timeframe = '1d'").select("symbol_id").distinct().join(bars.where("timeframe = '1h'").select("symbol_id"), "symbol_id", "left_anti")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """The number of rows of each table."""
    return reduce(DataFrame.union, [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in sorted(tables.items())])
