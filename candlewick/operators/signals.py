"""Entry strategies (T1-T18): each a function from indicator frames to signals.

A strategy returns symbol_id, timeframe, ts, strategy, entry, stop_loss, target_1, target_2, risk_pct and details (a struct of
its own fields).  Prices are rounded half-even to 2 digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.operators.indicators import lag, last_rows, ordered, rolling, true, volume_label
from candlewick.plans.views import SER, rounded

# Names and texts that stored signals carry.
TREND, MACD_TEXT, BAND_TEXT, VOLUME_TEXT = "GREEN ✓", ("Bullish ✓", "Bearish X"), ("Upper half ✓", "Lower half X"), ("✓", "X")
CONVICTION = ("HIGH ⚡", "STRONG", "MODERATE")
#: Strategies whose signals are events rather than states.
EVENTS = ("PIPELINE", "S1_ST_Flip", "S2_MACD_Zero", "S3_BB_Squeeze", "TTM_Squeeze")


@dataclass(frozen=True)
class Strategy:
    """A strategy over bars with the values of numbered(): columns adds what it needs, hit says where it fires, row is the
    signal (a struct, see _row; null where there is none after all)."""

    columns: Callable[[DataFrame], DataFrame]
    hit: Callable[[], Column]
    row: Callable[[], Column]

    def __call__(self, frame: DataFrame) -> DataFrame:
        return fired(frame, [self])


def fired(frame: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """The signals of the strategies in one pass over the frame: one row a signal."""
    df = numbered(frame)
    for s in strategies:
        df = s.columns(df)
    found = F.array_compact(F.array(*(F.when(true(s.hit()), s.row()) for s in strategies)))
    return df.select(*SER, F.explode(found).alias("s")).select(*SER, "s.*")


def _row(name: str, stop: Column, first: float, second: float, details: dict[str, Column]) -> Column:
    """The signal of a bar; targets are multiples of the unrounded close, the risk is that of the rounded stop."""
    stop = rounded(stop, 2)
    risk = rounded((F.col("close") - stop) / F.col("close") * 100, 2)
    return _struct(name, F.col("ts"), {"entry": rounded("close", 2), "stop_loss": stop, "target_1": rounded(F.col("close") * first, 2), "target_2": rounded(F.col("close") * second, 2), "risk_pct": risk}, details)


def _struct(name: str, ts: Column, prices: dict[str, Column], details: dict[str, Column]) -> Column:
    text = F.to_json(F.struct(*(v.alias(k) for k, v in details.items())))
    return F.struct(ts.alias("ts"), F.lit(name).alias("strategy"), *(v.alias(k) for k, v in prices.items()), text.alias("details"))


def numbered(df: DataFrame) -> DataFrame:
    """Adds i (0-based place in the series) and the previous bar's values."""
    before = {f"prev_{c}": lag(c) for c in ("close", "supertrend_dir", "macd_12_26", "bb_upper", "ttm_momentum")}
    return df.withColumns({"i": F.row_number().over(ordered()) - 1, **before})


def volume_ratio() -> Column:
    return rounded(F.col("volume") / F.col("volume_ma_20"), 2)


#: The direction turns up on more than average volume.
supertrend_flip = Strategy(
    lambda df: df,
    lambda: (F.col("i") >= 1) & (F.col("prev_supertrend_dir") == -1) & (F.col("supertrend_dir") == 1) & (F.col("volume") > F.col("volume_ma_20")),
    lambda: _row("S1_ST_Flip", F.col("supertrend_10_3") * 0.995, 1.07, 1.12, {"supertrend": rounded("supertrend_10_3", 2), "vol_ratio": volume_ratio()}),
)

#: MACD crosses zero upwards while the direction is up; stop below the last 10 bars.
macd_zero = Strategy(
    lambda df: df.withColumn("swing_low", F.min("low").over(last_rows(10, 1))),
    lambda: (F.col("i") >= 10) & (F.col("prev_macd_12_26") <= 0) & (F.col("macd_12_26") > 0) & (F.col("supertrend_dir") == 1),
    lambda: _row("S2_MACD_Zero", F.col("swing_low") * 0.995, 1.07, 1.12, {"macd": rounded("macd_12_26", 4)}),
)


def _band_hit(window: int = 10, volume: float = 1.5) -> Column:
    fresh = (F.col("close") > F.col("bb_upper")) & (F.col("prev_close") <= F.col("prev_bb_upper"))
    return (F.col("i") >= window + 1) & F.col("was_narrow") & fresh & (F.col("volume") > volume * F.col("volume_ma_20"))


def _band_row() -> Column:
    more = {"upper_bb": rounded("bb_upper", 2), "middle_bb": rounded("bb_middle", 2), "bandwidth": rounded("bb_bandwidth", 4), "vol_ratio": volume_ratio()}
    return _row("S3_BB_Squeeze", F.col("bb_middle"), 1.08, 1.15, more)


#: A close above the upper band, after bands narrower than 0.03 in the last 10 bars, on high volume.
band_squeeze = Strategy(lambda df: df.withColumn("was_narrow", F.max(true(F.col("bb_bandwidth") < 0.03).cast("int")).over(last_rows(10, 1)) == 1), _band_hit, _band_row)


def reward_to_risk(target: Column, stop: Column) -> Column:
    """(target - close) / (close - stop), 0 if the close is not above the stop."""
    return F.when(F.col("close") > stop, rounded((target - F.col("close")) / (F.col("close") - stop), 2)).otherwise(0.0)


def _confluence_columns(df: DataFrame) -> DataFrame:
    df = df.withColumn("macd_below", F.max(true(F.col("macd_12_26") < 0).cast("int")).over(last_rows(10, 1)) == 1)
    df = df.withColumns({
        "macd_ok": true((F.col("macd_12_26") > F.col("macd_signal_9")) & (F.col("macd_hist") > 0)), "bb_ok": true(F.col("close") > F.col("bb_middle")),
        "vol_ok": true(F.col("volume") > F.col("volume_ma_20")), "room": (F.col("bb_upper") - F.col("close")) / F.col("close"),
    })
    return df.withColumn("score", 1 + F.col("macd_ok").cast("int") + F.col("bb_ok").cast("int") + F.col("vol_ok").cast("int"))


def _confluence_hit(least: int = 3) -> Column:
    return (F.col("i") >= 30) & (F.col("supertrend_dir") == 1) & ~true(F.col("room") < 0.01) & (F.col("score") >= least)


def _confluence_row() -> Column:
    high = F.col("macd_ok") & F.coalesce("macd_below", F.lit(False))
    stop, target = rounded(F.col("supertrend_10_3") * 0.99, 2), rounded(F.col("close") * 1.07, 2)
    more = {
        "rr_ratio": reward_to_risk(target, stop), "score": F.concat(F.col("score").cast("string"), F.lit("/4")),
        "conviction": F.when(high, CONVICTION[0]).when(F.col("score") == 4, CONVICTION[1]).otherwise(CONVICTION[2]), "supertrend": rounded("supertrend_10_3", 2),
        "breakdown": F.struct(
            F.lit(TREND).alias("supertrend"), F.when(F.col("macd_ok"), MACD_TEXT[0]).otherwise(MACD_TEXT[1]).alias("macd"), high.alias("high_conviction"),
            F.when(F.col("bb_ok"), BAND_TEXT[0]).otherwise(BAND_TEXT[1]).alias("bb_position"), F.format_string("%.1f%%", rounded(F.col("room") * 100, 1)).alias("room_to_upper"),
            F.concat(F.format_string("%.1fx avg ", rounded(F.col("volume") / F.col("volume_ma_20"), 1)), F.when(F.col("vol_ok"), VOLUME_TEXT[0]).otherwise(VOLUME_TEXT[1])).alias("volume"),
        ),
    }
    return _row("Confluence", F.col("supertrend_10_3") * 0.99, 1.07, 1.12, more)


#: A score of trend (a veto), MACD, place within the bands and volume; not within 1 % of the upper band.
confluence = Strategy(_confluence_columns, _confluence_hit, _confluence_row)


def _ttm_row() -> Column:
    stop, target = rounded(F.col("kc_middle") * 0.99, 2), rounded(F.col("close") * 1.08, 2)
    more = {"rr_ratio": reward_to_risk(target, stop), "momentum": rounded("ttm_momentum", 4), "kc_mid": rounded("kc_middle", 2), "squeeze_bars": F.col("squeeze_bars")}
    return _row("TTM_Squeeze", F.col("kc_middle") * 0.99, 1.08, 1.15, more)


#: The squeeze ends with positive, rising momentum while the direction is up.
ttm_squeeze = Strategy(
    lambda df: df.withColumn("squeeze_bars", F.sum(F.col("ttm_squeeze_on").cast("int")).over(last_rows(20, 1))),
    lambda: (F.col("i") >= 1) & F.col("ttm_squeeze_off") & (F.col("ttm_momentum") > 0) & (F.col("ttm_momentum") > F.col("prev_ttm_momentum")) & (F.col("supertrend_dir") == 1),
    _ttm_row,
)


# The ten steps of the breakout pipeline.


def trend_ok(strong: float = 25.0) -> Column:
    """T1."""
    return true((F.col("close") > F.col("ema_50")) & (F.col("ema_50") > F.col("ema_200")) & (F.col("ema_50") > lag("ema_50")) & (F.col("adx_14") > strong))


def consolidating(window: int = 15, most: float = 0.05, back: int = 10) -> Column:
    """The range of the bars before is narrow, and the average range has fallen."""
    low = rolling(F.min, "low", window, 1)
    return true((F.try_divide(rolling(F.max, "high", window, 1) - low, low) < most) & (F.col("atr_10") - lag("atr_10", back) < 0))


def resistance(window: int = 15) -> Column:
    """T3."""
    return rolling(F.max, "high", window, 1)


def breakout(buffer: float = 0.2) -> Column:
    """T4."""
    return true(F.col("close") - F.col("resistance") >= buffer * F.col("atr_10"))


def breakout_strength() -> Column:
    """T4: distance above the resistance in average ranges."""
    return F.try_divide(F.col("close") - F.col("resistance"), "atr_10")


def accelerating(back: int = 2) -> Column:
    """T5."""
    return true((F.col("macd_hist") > 0) & (F.col("macd_hist") - lag("macd_hist", back) > 0))


def entry_mode(strong: float = 0.5) -> Column:
    """T6."""
    x = F.col("breakout_atr")
    return F.when(x >= strong, "IMMEDIATE").when(x > 0, "WAIT_RETEST").otherwise("NONE")


def valid_retest(tolerance: float = 0.015) -> Column:
    """Close to its own bar's resistance, above it, and up on the day."""
    near = F.try_divide(F.abs(F.col("low") - F.col("resistance")), "resistance") <= tolerance
    return true(near & (F.col("close") > F.col("resistance")) & (F.col("close") > F.col("open")))


def stop_loss(entry: Column, low: Column, atr: Column, buffer: float = 0.5, risk: float = 1.0) -> Column:
    """Below the structural low, but at most `risk` percent below the entry."""
    return rounded(F.greatest(low - buffer * atr, entry * (1 - risk / 100)), 2)


def exit_signal(stop: str = "trailing_stop") -> Column:
    """T9."""
    return true(F.col("close") < F.col(stop))


def pipeline_steps(df: DataFrame, adx: float = 25.0, rvol: float = 1.5) -> DataFrame:
    """Adds the steps of T1-T7 and setup, the bar at which all hold."""
    df = df.withColumns({"i": F.row_number().over(ordered()) - 1, "resistance": resistance(), "trend": trend_ok(adx), "consolidated": consolidating(), "accelerating": accelerating()})
    df = df.withColumns({"breakout_atr": breakout_strength(), "was_consolidated": F.coalesce(lag("consolidated"), F.lit(False)), "retest": valid_retest()})
    setup = F.col("trend") & F.col("was_consolidated") & breakout() & F.col("accelerating") & true(F.col("rvol_20") >= rvol)
    return df.withColumns({"setup": setup, "mode": entry_mode()})


def breakouts(adx: float = 25.0, rvol: float = 1.5, least: int = 210, window: int = 10) -> Strategy:
    """Strong breakouts enter at once; weak ones at the first valid retest within the next window - 1 bars.  Two breakouts may
    share a retest; both are kept.  Series below `least` bars have no signal."""

    def columns(df: DataFrame) -> DataFrame:
        df = pipeline_steps(df, adx, rvol)
        bar = F.struct("ts", "close", "low_11", "atr_10", "rvol_20")
        df = df.withColumns({"series_size": F.count("*").over(Window.partitionBy(*SER)), "low_11": F.min("low").over(ordered().rowsBetween(-window, 0))}).withColumn("bar", bar)
        ahead = F.min(F.when(F.col("retest"), F.struct("i", "bar"))).over(ordered().rowsBetween(1, window - 1))
        df = df.withColumn("next_retest", ahead)
        return df.withColumn("at", F.when(F.col("mode") == "IMMEDIATE", F.col("bar")).when(F.col("mode") == "WAIT_RETEST", F.col("next_retest.bar")))

    def row() -> Column:
        entry, atr = F.col("at.close"), F.col("at.atr_10")
        stop = stop_loss(entry, F.col("at.low_11"), atr)
        prices = {"entry": rounded(entry, 2), "stop_loss": stop, "target_1": rounded(entry + 2 * atr, 2), "target_2": rounded(entry + 3.5 * atr, 2), "risk_pct": rounded((entry - stop) / entry * 100, 2)}
        more = {
            "entry_mode": F.when(F.col("mode") == "IMMEDIATE", "IMMEDIATE").otherwise("RETEST"), "atr": rounded(atr, 2), "rvol": rounded("at.rvol_20", 2),
            "volume_grade": volume_label("at.rvol_20"), "breakout_atr": rounded("breakout_atr", 2),
        }
        return _struct("PIPELINE", F.col("at.ts"), prices, more)

    return Strategy(columns, lambda: F.col("setup") & (F.col("series_size") >= least) & F.col("at").isNotNull(), row)


def pipeline(df: DataFrame, adx: float = 25.0, rvol: float = 1.5, least: int = 210, window: int = 10) -> DataFrame:
    """The signals of breakouts()."""
    return breakouts(adx, rvol, least, window)(df)


#: The registry that callers extend, by a Strategy or any function from frames to signals.
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "PIPELINE": breakouts(), "S1_ST_Flip": supertrend_flip, "S2_MACD_Zero": macd_zero, "S3_BB_Squeeze": band_squeeze, "Confluence": confluence, "TTM_Squeeze": ttm_squeeze,
}


def run(frame: DataFrame, strategies: list[str] | None = None, held: DataFrame | None = None) -> DataFrame:
    """Signals of the strategies over all series but those held back (held: symbol_id, timeframe).  All strategies of the
    registry that are a Strategy share one pass over the frame."""
    if held is not None:
        frame = frame.join(held.select(*SER).distinct(), SER, "left_anti")
    chosen = [STRATEGIES[s] for s in strategies or STRATEGIES]
    together = [s for s in chosen if isinstance(s, Strategy)]
    parts = [fired(frame, together)] if together else []
    return reduce(DataFrame.unionByName, parts + [s(frame) for s in chosen if not isinstance(s, Strategy)])


def regenerated(old: DataFrame, new: DataFrame, attempted: DataFrame) -> DataFrame:
    """Old signals without those of the attempted (symbol_id, timeframe, strategy), and the new ones."""
    return old.join(attempted.select(*SER, "strategy").distinct(), [*SER, "strategy"], "left_anti").unionByName(new)


def scan(bars: DataFrame, frame_of: Callable[[DataFrame], DataFrame], cutoff: Column, freshness_days: int = 3) -> DataFrame:
    """Signals as of a day, without looking ahead: bars up to the cutoff only, then signals of the last days."""
    seen = bars.where(F.to_date("ts") <= cutoff)
    return run(frame_of(seen)).where(F.datediff(cutoff, F.to_date("ts")) <= freshness_days)


def fields(signals: DataFrame, names: dict[str, str]) -> DataFrame:
    """Signals with fields of `details` as columns."""
    return signals.withColumns({n: F.get_json_object("details", f"$.{n}").cast(t) for n, t in names.items()})


def oracle(frame: str, strategy: str) -> str:
    """DuckDB's SQL for one strategy, on CTEs that end in the indicator frame `f`."""
    r2 = lambda x: f"round_even(({x})*100, 0)/100"

    def out(stop: str, first: float, second: float) -> str:
        s = r2(stop)
        return f"SELECT symbol_id, timeframe, ts, '{strategy}' AS strategy, {r2('close')} AS entry, {s} AS stop_loss, {r2(f'close*{first}')} AS target_1, {r2(f'close*{second}')} AS target_2, {r2(f'(close-{s})/close*100')} AS risk_pct FROM n"

    n = f"""{frame}, n AS (SELECT *, rn - 1 AS i, lag(close) OVER o AS pclose, lag(supertrend_dir) OVER o AS pdir, lag(macd_12_26) OVER o AS pmacd, lag(bb_upper) OVER o AS pup,
  lag(ttm_momentum) OVER o AS pmom, min(low) OVER (o ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS swing,
  coalesce(bool_or(bb_bandwidth < 0.03) OVER (o ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), false) AS narrow,
  coalesce(macd_12_26 > macd_signal_9 AND macd_hist > 0, false)::INT + coalesce(close > bb_middle, false)::INT + coalesce(volume > volume_ma_20, false)::INT + 1 AS score
  FROM f WINDOW o AS (PARTITION BY symbol_id ORDER BY ts))"""
    by = {
        "S1_ST_Flip": (out("supertrend_10_3*0.995", 1.07, 1.12), "i >= 1 AND pdir = -1 AND supertrend_dir = 1 AND volume > volume_ma_20"),
        "S2_MACD_Zero": (out("swing*0.995", 1.07, 1.12), "i >= 10 AND pmacd <= 0 AND macd_12_26 > 0 AND supertrend_dir = 1"),
        "S3_BB_Squeeze": (out("bb_middle", 1.08, 1.15), "i >= 11 AND narrow AND close > bb_upper AND pclose <= pup AND volume > volume_ma_20*1.5"),
        "Confluence": (out("supertrend_10_3*0.99", 1.07, 1.12), "i >= 30 AND supertrend_dir = 1 AND NOT coalesce((bb_upper-close)/close < 0.01, false) AND score >= 3"),
        "TTM_Squeeze": (out("kc_middle*0.99", 1.08, 1.15), "i >= 1 AND ttm_squeeze_off AND ttm_momentum > 0 AND ttm_momentum > pmom AND supertrend_dir = 1"),
    }
    select, where = by[strategy]
    return f"{n} {select} WHERE {where}"


def pipeline_oracle(frame: str, adx: float, rvol: float) -> str:
    r2 = lambda x: f"round_even(({x})*100, 0)/100"
    return f"""{frame}, a AS (SELECT *, rn - 1 AS i, count(*) OVER (PARTITION BY symbol_id) AS size, lag(ema_50) OVER o AS pe50, lag(atr_10, 10) OVER o AS patr, lag(macd_hist, 2) OVER o AS phist,
  CASE WHEN rn > 15 THEN max(high) OVER (o ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) END AS res, CASE WHEN rn > 15 THEN min(low) OVER (o ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) END AS lo15,
  min(low) OVER (o ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS low11 FROM f WINDOW o AS (PARTITION BY symbol_id ORDER BY ts)),
c AS (SELECT *, lag(coalesce((res-lo15)/lo15 < 0.05 AND atr_10 - patr < 0, false)) OVER (PARTITION BY symbol_id ORDER BY ts) AS wascons FROM a),
s AS (SELECT *, (close-res)/atr_10 AS strength FROM c WHERE size >= 210 AND close > ema_50 AND ema_50 > ema_200 AND ema_50 > pe50 AND adx_14 > {adx} AND wascons
  AND close - res >= 0.2*atr_10 AND macd_hist > 0 AND macd_hist - phist > 0 AND rvol_20 >= {rvol}),
t AS (SELECT *, close > res AND close > open AND abs(low-res)/res <= 0.015 AS retest FROM c),
e AS (SELECT s.symbol_id, s.i, s.strength, CASE WHEN s.strength >= 0.5 THEN s.i ELSE min(t.i) END AS j FROM s LEFT JOIN t ON t.symbol_id = s.symbol_id AND t.i BETWEEN s.i + 1 AND s.i + 9 AND t.retest GROUP BY s.symbol_id, s.i, s.strength),
x AS (SELECT c.*, {r2("greatest(low11-0.5*atr_10, close*(1-1.0/100))")} AS stop FROM e JOIN c ON c.symbol_id = e.symbol_id AND c.i = e.j)
SELECT symbol_id, timeframe, ts, 'PIPELINE' AS strategy, {r2("close")} AS entry, stop AS stop_loss, {r2("close+2*atr_10")} AS target_1, {r2("close+3.5*atr_10")} AS target_2, {r2("(close-stop)/close*100")} AS risk_pct FROM x"""
