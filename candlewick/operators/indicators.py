"""Indicators of each series (I1-I15): window functions around the recurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.operators.recurrence import with_recurrences
from candlewick.plans.views import SER, daily_bars_sql, rounded

#: The labels of relative volume that stored signals carry.
LABELS = ("STRONG (>=2x avg)", "CONFIRMED (>=1.5x avg)", "WEAK (<1.5x avg)")
#: The 21 stored columns.
STORED = [
    "atr_10", "supertrend_10_3", "supertrend_dir", "macd_12_26", "macd_signal_9", "macd_hist", "ema_50", "ema_200", "adx_14", "bb_upper", "bb_middle",
    "bb_lower", "bb_bandwidth", "volume_ma_20", "kc_upper", "kc_middle", "kc_lower", "ttm_squeeze_on", "ttm_squeeze_off", "ttm_momentum", "rvol_20",
]


def ordered():
    return Window.partitionBy(*SER).orderBy("ts")


def last_rows(n: int, skip: int = 0):
    """The window of n rows that ends `skip` rows before this one."""
    return ordered().rowsBetween(-(n - 1) - skip, -skip)


def rolling(agg, column: str, n: int, skip: int = 0) -> Column:
    """An aggregate over n rows, null until all n are there."""
    over = last_rows(n, skip)
    return F.when(F.count(column).over(over) == n, agg(column).over(over))


def lag(column: str, n: int = 1) -> Column:
    return F.lag(column, n).over(ordered())


def true(condition: Column) -> Column:
    """A comparison with an undefined value is false."""
    return F.coalesce(condition, F.lit(False))


def indicator_frame(bars: DataFrame) -> DataFrame:
    """Bars (symbol_id, timeframe, ts, open, high, low, close, volume) with all STORED columns and atr_14, true_range.

    Undefined values are null.  One shuffle by series (none, if bars are stored in buckets, see sources/bar_store.py).
    """
    return finished(with_recurrences(bars))


def finished(df: DataFrame) -> DataFrame:
    """The frame from bars with their recurrences."""
    df = df.withColumns({
        "bb_upper": F.col("bb_middle") + 2 * F.col("spread"), "bb_lower": F.col("bb_middle") - 2 * F.col("spread"),
        "macd_12_26": F.col("ema_12") - F.col("ema_26"), "kc_middle": F.col("ema_20"), "ttm_momentum": F.col("momentum"),
        "kc_upper": F.col("ema_20") + 1.5 * F.col("atr_10"), "kc_lower": F.col("ema_20") - 1.5 * F.col("atr_10"),
        "rvol_20": F.try_divide(F.col("volume").cast("double"), "volume_ma_20"),
    })
    df = df.withColumns({"bb_bandwidth": F.try_divide(F.col("bb_upper") - F.col("bb_lower"), "bb_middle"), "macd_hist": F.col("macd_12_26") - F.col("macd_signal_9")})
    return df.select(*SER, "ts", "open", "high", "low", "close", "volume", *STORED, "atr_14", "true_range")


def volume_confirmed(rvol: str = "rvol_20", least: float = 1.5) -> Column:
    """I12."""
    return true(F.col(rvol) >= least)


def volume_label(rvol: str = "rvol_20") -> Column:
    """Strong from 2, confirmed from 1.5, else weak."""
    return F.when(F.col(rvol) >= 2, LABELS[0]).when(F.col(rvol) >= 1.5, LABELS[1]).otherwise(LABELS[2])


def volume_divergence(n: int = 5) -> Column:
    """Over the last n bars the close rose while the volume's trend line fell; false below n + 1 bars."""
    over = last_rows(n)
    x = F.col("_rn").cast("double")
    slope = F.count("volume").over(over) * F.sum(x * F.col("volume")).over(over) - F.sum(x).over(over) * F.sum("volume").over(over)
    return true((F.col("_rn") > n) & (F.col("close") > lag("close", n - 1)) & (slope < 0))


def with_volume_divergence(bars: DataFrame, n: int = 5) -> DataFrame:
    return bars.withColumn("_rn", F.row_number().over(ordered())).withColumn("volume_divergence", volume_divergence(n)).drop("_rn")


def trailing_stop(df: DataFrame, multiple: float = 2.5) -> DataFrame:
    """Adds trailing_stop, the running maximum of (running high - multiple * ATR)."""
    so_far = ordered().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_level", F.max("high").over(so_far) - multiple * F.col("atr_10"))
    return df.withColumn("trailing_stop", F.max("_level").over(so_far)).drop("_level")


def compared(df: DataFrame) -> DataFrame:
    """Values rounded for comparison between engines."""
    kinds = dict(df.dtypes)
    return df.select(*(rounded(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns))


def frame_sql(view: str = "flat") -> str:
    """DuckDB CTEs that end in `f`: the indicator frame, recurrences as a recursive query over row numbers."""

    def ewm(prev: str, x: str, a: str) -> str:
        return f"CASE WHEN {prev} IS NULL THEN {x} WHEN {x} IS NULL THEN {prev} ELSE ((1-{a})*{prev}+{a}*{x})/((1-{a})+{a}) END"

    e12, e26 = ewm("r.e12", "b.close", "(2/13.0::DOUBLE)"), ewm("r.e26", "b.close", "(2/27.0::DOUBLE)")
    return f"""WITH RECURSIVE bars AS ({daily_bars_sql(view)}),
w0 AS (SELECT *, row_number() OVER o AS rn, lag(close) OVER o AS pc, lag(high) OVER o AS ph, lag(low) OVER o AS pl FROM bars WINDOW o AS (PARTITION BY symbol_id ORDER BY ts)),
w AS (SELECT *, greatest(high-low, abs(high-pc), abs(low-pc)) AS tr, greatest(high-ph, 0) AS up, greatest(pl-low, 0) AS dn,
  CASE WHEN count(*) OVER n20 = 20 THEN (max(high) OVER n20 + min(low) OVER n20)/2 END AS mid,
  CASE WHEN count(*) OVER n20 = 20 THEN avg(close) OVER n20 END AS bm, CASE WHEN count(*) OVER n20 = 20 THEN stddev_samp(close) OVER n20 END AS bs,
  CASE WHEN count(*) OVER n20 = 20 THEN avg(volume) OVER n20 END AS vma FROM w0 WINDOW n20 AS (PARTITION BY symbol_id ORDER BY ts ROWS 19 PRECEDING)),
b AS (SELECT *, CASE WHEN pc IS NOT NULL THEN CASE WHEN up < dn THEN 0 ELSE up END END AS pdm, CASE WHEN pc IS NOT NULL THEN CASE WHEN dn < up THEN 0 ELSE dn END END AS mdm FROM w),
r AS (SELECT symbol_id, rn, close, close AS e12, close AS e26, 0.0::DOUBLE AS sg, close AS e20, close AS e50, close AS e200, tr AS a10, tr AS a14,
  NULL::DOUBLE AS p, NULL::DOUBLE AS m, NULL::DOUBLE AS dx, 1.0::DOUBLE AS wt, NULL::DOUBLE AS mom, (high+low)/2+3*tr AS fu, (high+low)/2-3*tr AS fl, 1 AS dir, 0.0::DOUBLE AS st FROM b WHERE rn = 1
UNION ALL SELECT symbol_id, rn, close, e12, e26, sg, e20, e50, e200, a10, a14, p, m,
  CASE WHEN x IS NULL THEN dx WHEN dx IS NULL THEN x ELSE (wt*(1-1/14.0::DOUBLE)*dx+(1/14.0::DOUBLE)*x)/(wt*(1-1/14.0::DOUBLE)+(1/14.0::DOUBLE)) END,
  CASE WHEN x IS NULL AND dx IS NOT NULL THEN wt*(1-1/14.0::DOUBLE) ELSE 1.0 END, mom, fu, fl,
  CASE WHEN dir = 1 THEN CASE WHEN close < fl THEN -1 ELSE 1 END ELSE CASE WHEN close > fu THEN 1 ELSE -1 END END,
  CASE WHEN (CASE WHEN dir = 1 THEN CASE WHEN close < fl THEN -1 ELSE 1 END ELSE CASE WHEN close > fu THEN 1 ELSE -1 END END) = 1 THEN fl ELSE fu END
 FROM (SELECT *, 100*abs(100*(p/nullif(a14,0))-100*(m/nullif(a14,0)))/nullif(100*(p/nullif(a14,0))+100*(m/nullif(a14,0)), 0) AS x,
   CASE WHEN bu < pfu OR pclose > pfu THEN bu ELSE pfu END AS fu, CASE WHEN bl > pfl OR pclose < pfl THEN bl ELSE pfl END AS fl,
   {ewm("pmom", "(close-(mid+e20)/2)", "(2/21.0::DOUBLE)")} AS mom
  FROM (SELECT b.symbol_id, b.rn, b.close, b.mid, r.dx, r.wt, r.dir, r.mom AS pmom, r.close AS pclose, r.fu AS pfu, r.fl AS pfl, {e12} AS e12, {e26} AS e26,
    {ewm("r.sg", f"(({e12})-({e26}))", "(2/10.0::DOUBLE)")} AS sg, {ewm("r.e20", "b.close", "(2/21.0::DOUBLE)")} AS e20, {ewm("r.e50", "b.close", "(2/51.0::DOUBLE)")} AS e50,
    {ewm("r.e200", "b.close", "(2/201.0::DOUBLE)")} AS e200, {ewm("r.a10", "b.tr", "(1/10.0::DOUBLE)")} AS a10, {ewm("r.a14", "b.tr", "(1/14.0::DOUBLE)")} AS a14,
    {ewm("r.p", "b.pdm", "(1/14.0::DOUBLE)")} AS p, {ewm("r.m", "b.mdm", "(1/14.0::DOUBLE)")} AS m,
    (b.high+b.low)/2+3*({ewm("r.a10", "b.tr", "(1/10.0::DOUBLE)")}) AS bu, (b.high+b.low)/2-3*({ewm("r.a10", "b.tr", "(1/10.0::DOUBLE)")}) AS bl
   FROM r JOIN b ON b.symbol_id = r.symbol_id AND b.rn = r.rn + 1))),
f0 AS (SELECT b.symbol_id, '1d' AS timeframe, b.ts, b.rn, b.open, b.high, b.low, b.close, b.volume, a10 AS atr_10, st AS supertrend_10_3, dir::BIGINT AS supertrend_dir,
  e12-e26 AS macd_12_26, sg AS macd_signal_9, e12-e26-sg AS macd_hist, e50 AS ema_50, e200 AS ema_200, dx AS adx_14, bm+2*bs AS bb_upper, bm AS bb_middle, bm-2*bs AS bb_lower,
  ((bm+2*bs)-(bm-2*bs))/bm AS bb_bandwidth, vma AS volume_ma_20, e20+1.5*a10 AS kc_upper, e20 AS kc_middle, e20-1.5*a10 AS kc_lower,
  coalesce(bm+2*bs < e20+1.5*a10 AND bm-2*bs > e20-1.5*a10, false) AS ttm_squeeze_on, mom AS ttm_momentum, b.volume/vma AS rvol_20, a14 AS atr_14, tr AS true_range FROM b JOIN r USING (symbol_id, rn)),
f AS (SELECT *, coalesce(lag(ttm_squeeze_on) OVER o, false) AND NOT ttm_squeeze_on AS ttm_squeeze_off FROM f0 WINDOW o AS (PARTITION BY symbol_id ORDER BY ts))"""


def oracle() -> str:
    doubles = [c for c in ["open", "high", "low", "close", *STORED, "atr_14", "true_range"] if c not in ("supertrend_dir", "ttm_squeeze_on", "ttm_squeeze_off")]
    out = ", ".join(f"round_even({c}*1e6, 0)/1e6 AS {c}" for c in doubles)
    return f"{frame_sql()} SELECT symbol_id, timeframe, ts, volume, supertrend_dir, ttm_squeeze_on, ttm_squeeze_off, {out} FROM f"
