"""The research panel (I16-I18, P12, P13, J17, J18, G21, G22): indicators in another convention, screens and panel checks.

Averages here start with the mean of the first n values, and relative volume is measured against the 20 bars before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.operators.quantiles import exact_quantile
from candlewick.operators.recurrence import smoothed, sorted_series, whole_series, with_columns
from candlewick.sources.tables import kept


def series():
    return Window.partitionBy("exchange", "symbol").orderBy("date")


def seeded(x: np.ndarray, n: int, alpha: float, first: np.ndarray | None = None) -> np.ndarray:
    """The recurrence with weight alpha, started with the mean of the first n valid values; nothing before.  first: the places where
    series begin, if there are several."""
    first = np.array([0]) if first is None else first
    begun, valid = np.full(len(x), np.nan), ~np.isnan(x)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(x)], strict=True):
        if valid[a:b].sum() < n:
            continue
        begin = a + int(valid[a:b].argmax())
        begun[begin + n - 1] = x[begin : begin + n].mean()
        begun[begin + n : b] = x[begin + n : b]
    series = np.repeat(np.arange(len(first)), np.diff([*first, len(x)]))
    return smoothed(pd.Series(begun), alpha, series).to_numpy()


def panel_indicators(panel: DataFrame) -> DataFrame:
    """Adds ema20, ema50, ema200, rsi14, rvol20, atr14, plus_di, minus_di, adx14, bars, atr14_pct, ret_1d_pct to
    exchange, symbol, date, high, low, close, volume."""
    lag = lambda c: F.lag(c).over(series())
    before = series().rowsBetween(-20, -1)
    base = F.when(F.count("volume").over(before) == 20, F.avg("volume").over(before))
    df = panel.withColumns({
        "bars": F.row_number().over(series()), "_change": F.col("close") - lag("close"), "_up": F.col("high") - lag("high"), "_down": lag("low") - F.col("low"),
        "_tr": F.when(lag("close").isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close")))),
        "rvol20": F.try_divide(F.col("volume").cast("double"), F.nullif(base, F.lit(0.0))), "ret_1d_pct": (F.try_divide("close", lag("close")) - 1) * 100,
    })
    df = df.withColumns({
        "_plus": F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).when(F.col("_up").isNotNull(), 0.0),
        "_minus": F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).when(F.col("_up").isNotNull(), 0.0),
    }).drop("_up", "_down")

    added = ["ema20", "ema50", "ema200", "rsi14", "atr14", "plus_di", "minus_di", "adx14"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_series(batches):
            first = np.flatnonzero(table.column("_nth").to_numpy() == 1)
            pdf = table.select(["close", "_change", "_tr", "_plus", "_minus"]).to_pandas()
            change = pdf["_change"].to_numpy(float)
            for n in (20, 50, 200):
                pdf[f"ema{n}"] = seeded(pdf["close"].to_numpy(float), n, 2 / (n + 1), first)
            gain, loss = seeded(np.maximum(change, 0), 14, 1 / 14, first), seeded(np.maximum(-change, 0), 14, 1 / 14, first)
            atr, plus, minus = (seeded(pdf[k].to_numpy(float), 14, 1 / 14, first) for k in ("_tr", "_plus", "_minus"))
            with np.errstate(divide="ignore", invalid="ignore"):
                rsi = np.where(loss == 0, np.where(gain == 0, np.nan, 100.0), 100 - 100 / (1 + gain / loss))
                pdf["rsi14"], pdf["atr14"], pdf["plus_di"], pdf["minus_di"] = rsi, atr, 100 * plus / atr, 100 * minus / atr
                both = pdf["plus_di"] + pdf["minus_di"]
                dx = (100 * (pdf["plus_di"] - pdf["minus_di"]).abs() / both.where(both != 0)).to_numpy()
            pdf["adx14"] = seeded(dx, 14, 1 / 14, first)
            yield from with_columns(table.drop_columns(["_change", "_tr", "_plus", "_minus"]), pdf, added).combine_chunks().to_batches()

    kept = ", ".join([f"{n} {t}" for n, t in df.dtypes if n[0] != "_"] + [f"{n} double" for n in added])
    out = sorted_series(df, ["exchange", "symbol"], "date").mapInArrow(work, kept)
    return out.withColumn("atr14_pct", F.try_divide("atr14", "close") * 100)


def screen(panel: DataFrame, turnover: float = 5e7) -> DataFrame:
    """Rising, strong, liquid and busy, the busiest first."""
    need = ["ema50", "ema200", "adx14", "plus_di", "minus_di", "rsi14", "rvol20"]
    rule = "turnover > {} and close > ema50 and ema50 > ema200 and adx14 > 25 and plus_di > minus_di and rsi14 between 50 and 70 and rvol20 > 1.5"
    return panel.dropna(subset=need).where(rule.format(turnover)).orderBy(F.col("rvol20").desc(), "exchange", "symbol")


def without_entitlements(panel: DataFrame) -> DataFrame:
    """P13."""
    return panel.where(~F.col("symbol").rlike(r"-RE\d*$"))


def with_history(panel: DataFrame, least: int = 60) -> DataFrame:
    """Rows of series with at least `least` bars."""
    enough = panel.groupBy("exchange", "symbol").count().where(F.col("count") >= least)
    return panel.join(enough, ["exchange", "symbol"], "left_semi")


def on_both(panel: DataFrame) -> DataFrame:
    """ISINs on both exchanges."""
    return panel.groupBy("isin").agg(F.countDistinct("exchange").alias("n")).where("n = 2").select("isin")


def deduplicated(panel: DataFrame) -> DataFrame:
    """Of rows with one exchange, symbol and date the one with the highest turnover."""
    best = Window.partitionBy("exchange", "symbol", "date").orderBy(F.col("turnover").desc_nulls_last(), "series")
    return panel.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def size_table(panel: DataFrame, series: list[str]) -> DataFrame:
    """Rows by exchange and series, 0 where there are none."""
    return panel.groupBy("exchange").pivot("series", series).count().na.fill(0)


def describe(panel: DataFrame, column: str) -> DataFrame:
    """Count, mean, min, exact median, max of a column by exchange; the median in a few passes, which are run here."""
    rest = panel.groupBy("exchange").agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.min(column).alias("least"), F.max(column).alias("most"))
    return rest.join(exact_quantile(panel, ["exchange"], column, 0.5, kept, "median"), "exchange")


def panel_checks(panel: DataFrame) -> DataFrame:
    """Duplicated keys, days out of order or repeated, prices that are not positive, and number of dates by exchange."""
    keys = panel.groupBy("exchange", "symbol", "date").agg(F.count("*").alias("n"), F.min(F.least("open", "high", "low", "close")).alias("low"))
    return keys.groupBy("exchange").agg(F.count_if(F.col("n") > 1).alias("duplicated"), F.countDistinct("date").alias("n_dates"), F.count_if(F.col("low") <= 0).alias("not_positive"), F.bool_and(F.col("n") == 1).alias("sound"))


def quantiles(panel: DataFrame, column: str, shares: list[float], keys: list[str]) -> DataFrame:
    """Keys, share, value: exact quantiles of groups of any size."""
    return reduce(DataFrame.unionByName, (exact_quantile(panel, keys, column, q, kept, "value").withColumn("share", F.lit(q)) for q in shares))


def median_turnover(panel: DataFrame, rows: int = 60, least: int = 40) -> DataFrame:
    """Exact median turnover of each symbol's last rows, for symbols with enough of them."""
    last = Window.partitionBy("exchange", "symbol").orderBy(F.col("date").desc())
    recent = panel.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= rows)
    return recent.groupBy("exchange", "symbol").agg(F.count("*").alias("n"), F.percentile("turnover", 0.5).alias("median_turnover")).where(F.col("n") >= least).drop("n")


def spread_sample(ranked: DataFrame, n: int, forced: list[str] = []) -> DataFrame:  # noqa: B006
    """N symbols evenly spaced by median turnover; doubles are filled up from the top, forced symbols take the last places.

    ranked has a row for each symbol: one task ranks them."""
    df = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.col("median_turnover").desc(), "symbol")) - 1).withColumn("of", F.count("*").over(Window.partitionBy()))
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * (F.col("of") - 1) / F.lit(max(n - 1, 1))).cast("int"))
    df = df.withColumn("class", F.when(F.col("symbol").isin(forced), 0).when(F.array_contains(spots, F.col("rank").cast("int")), 1).otherwise(2))
    return df.orderBy("class", "rank").limit(n).select("symbol", "median_turnover", "rank")
