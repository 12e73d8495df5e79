"""Matching fills to signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.calendar import with_session
from candlewick.operators.signals import EVENTS
from candlewick.plans.views import rounded

GAP, BACK, LEAST = 5.0, 5, 0.5


def candidates(fills: DataFrame, signals: DataFrame, days: DataFrame, back: int = BACK) -> DataFrame:
    """(fill, signal) pairs of one symbol with the signal at most `back` sessions before the fill.  Joined on the symbol and
    the session number, of which a fill has back + 1: an equi-join."""
    f = with_session(fills, "trade_date", days, "f_").withColumn("_no", F.explode(F.sequence(F.col("f_session_no") - back, F.col("f_session_no"))))
    s = with_session(signals.withColumn("signal_date", F.to_date("ts")), "signal_date", days, "s_").select("symbol_id", F.col("s_session_no").alias("_no"), "signal_date", F.col("ts").alias("signal_ts"), "strategy", "entry", "stop_loss", "target_1", "target_2")
    return f.join(s, ["symbol_id", "_no"]).where("signal_date <= trade_date").withColumn("sessions", F.col("f_session_no") - F.col("_no")).drop("_no", "f_session_no", "f_session_date", "f_is_trading_day")


def match(pairs: DataFrame, gap: float = GAP, back: int = BACK, least: float = LEAST) -> DataFrame:
    """M1, M2: the best signal of each fill, with confidence and reason.

    score = half for closeness of price, 0.3 for an event (half of that for Confluence), 0.2 for closeness in time; at least
    `least`.  Equal scores (to 9 digits) go to events, then to the later signal."""
    kind = F.when(F.col("strategy").isin(*EVENTS), 1.0).when(F.col("strategy") == "Confluence", 0.5).otherwise(0.0)
    df = pairs.withColumn("gap_pct", F.abs(F.try_divide(F.col("price") - F.col("entry"), "entry")) * 100).where((F.col("gap_pct") <= gap) & (F.col("sessions") <= back))
    df = df.withColumns({"score": 0.5 * (1 - F.col("gap_pct") / gap) + 0.3 * kind + 0.2 * (1 - F.col("sessions") / back), "is_event": kind == 1.0}).where(F.col("score") >= least)
    best = Window.partitionBy("trade_id").orderBy(rounded("score", 9).desc(), F.col("is_event").desc(), F.col("signal_ts").desc(), "strategy")
    df = df.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    reason = F.format_string("%s @%s, fill %.1f%% from entry", "strategy", F.date_format("signal_ts", "yyyy-MM-dd"), rounded("gap_pct", 1))
    return df.select("trade_id", "symbol_id", "strategy", "signal_ts", "entry", "stop_loss", "target_1", "target_2", "sessions", "gap_pct", rounded("score", 4).alias("confidence"), reason.alias("reason"))


def apply_matches(positions: DataFrame, matches: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """M3: positions with the match of their opening fill; manual ones (position_id, strategy, entry, stop_loss, target_1,
    target_2) win, with confidence 1 and reason `manual`."""
    fields = ["strategy", "entry", "stop_loss", "target_1", "target_2", "confidence", "reason"]
    found = matches.select(F.col("trade_id").alias("position_id"), *fields)
    if manual is not None:
        own = manual.select("position_id", *fields[:5], F.lit(1.0).alias("confidence"), F.lit("manual").alias("reason"))
        found = found.join(own, "position_id", "left_anti").unionByName(own)
    return positions.join(found, "position_id", "left").withColumn("matched", F.col("strategy").isNotNull())


def manual_matches(requests: DataFrame, positions: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M3: (matches for apply_matches(), requests without such a signal).  requests: position_id, strategy, ts; the signal is the daily
    one of the position's symbol with that strategy and time."""
    named = requests.join(positions.select("position_id", "symbol_id"), "position_id", "left")
    daily = signals.where("timeframe = '1d'").select("symbol_id", "strategy", "ts", "entry", "stop_loss", "target_1", "target_2").dropDuplicates(["symbol_id", "strategy", "ts"])
    found = named.join(daily.withColumn("_found", F.lit(True)), ["symbol_id", "strategy", "ts"], "left")
    matches = found.where("_found").select("position_id", "strategy", "entry", "stop_loss", "target_1", "target_2")
    return matches, found.where("_found is null").select("position_id", "strategy", "ts")
