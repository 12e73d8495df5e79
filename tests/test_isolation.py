"""One bad series or position is reported; the others come out as if it were not there."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from candlewick.operators import indicators, isolation, signals
from candlewick.sources import tables
from tests.test_streaming import BARS, walk


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def bars_of(spark, bad=True):
    rows = [r for s in (1, 2, 3, 4) for r in walk(120, s, s)]
    if bad:
        rows += [(8, *rows[0][1:]), (8, *rows[0][1:])] + [(9, *r[1:6], None, *r[7:]) for r in rows[:30]]
    return spark.createDataFrame(rows, BARS).withColumn("ts", F.to_date("ts"))


def test_bad_series_are_reported_and_the_others_unchanged(spark):
    frame, bad = isolation.indicator_frame(bars_of(spark), tables.kept)
    assert rows_of(frame) == rows_of(indicators.indicator_frame(bars_of(spark, bad=False)))
    assert {r.symbol_id: r.error for r in bad.collect()} == {8: "ValueError: 1 times have more than one bar, the first 2026-01-01 00:00", 9: "ValueError: a price is missing or not positive"}


def test_another_check_judges_each_series(spark):
    def check(series):
        if series["symbol_id"].iloc[0] == 2:
            raise LookupError("not this one")

    frame, bad = isolation.indicator_frame(bars_of(spark, bad=False), check=check)
    assert {r.symbol_id for r in frame.collect()} == {1, 3, 4} and [(r.symbol_id, r.error) for r in bad.collect()] == [(2, "LookupError: not this one")]


def test_run_with_own_strategy_that_raises(spark):
    def mine(series: pd.DataFrame) -> pd.DataFrame:
        if series["symbol_id"].iloc[0] == 3:
            raise KeyError("no such column")
        hit = series.tail(1)
        return hit.assign(entry=hit["close"], stop_loss=hit["low"], target_1=1.0, target_2=2.0, risk_pct=0.5)

    held = spark.createDataFrame([(2, "1d")], "symbol_id int, timeframe string")
    run = isolation.run_signals(bars_of(spark), ["S1_ST_Flip", "Confluence"], {"Mine": isolation.by_series("Mine", mine, tables.kept)}, held, tables.kept)
    assert sorted((r.symbol_id, r.strategy) for r in run.signals.where("strategy = 'Mine'").collect()) == [(1, "Mine"), (4, "Mine")]
    plain = signals.run(indicators.indicator_frame(bars_of(spark, bad=False)).where("symbol_id <> 2"), ["S1_ST_Flip", "Confluence"]).drop("details")
    assert rows_of(run.signals.where("strategy <> 'Mine'").select(*plain.columns)) == rows_of(plain)
    assert sorted((r.symbol_id, r.strategy or "") for r in run.bad_rows.collect()) == [(3, "Mine"), (8, ""), (9, "")]
    assert sorted((r.symbol_id, r.strategy) for r in run.attempted.collect()) == sorted((s, n) for s in (1, 3, 4) for n in ("S1_ST_Flip", "Confluence", "Mine") if (s, n) != (3, "Mine"))
    # what a failed or held series had stays in the table
    old = spark.createDataFrame([(s, "1d", dt.date(2020, 1, 1), n, 1.0, 1.0, 1.0, 1.0, 1.0) for s in (1, 2, 3, 8) for n in ("S1_ST_Flip", "Mine")], isolation.SIGNALS)
    left = signals.regenerated(old, run.signals.select(*old.columns), run.attempted).where("ts = date '2020-01-01'")
    assert sorted((r.symbol_id, r.strategy) for r in left.collect()) == [(2, "Mine"), (2, "S1_ST_Flip"), (3, "Mine"), (8, "Mine"), (8, "S1_ST_Flip")]
    log = isolation.run_log("signals", dt.datetime(2026, 1, 1, 10), dt.datetime(2026, 1, 1, 11), run.signals, run.bad_rows, ["symbol_id", "timeframe"]).first()
    assert (log.kind, log.status, log.groups, log.failures) == ("signals", "completed", 3, 3) and log.message.startswith("3 1d KeyError: 'no such column'; 8 1d ValueError")


def test_positions_that_cannot_be_judged(spark):
    kind = "position_id int, account_id int, symbol_id int, opened_on date, qty_total long, qty_open long, avg_entry_price double"
    d = dt.date(2026, 1, 1)
    rows = [(1, 1, 1, d, 5, 5, 10.0), (2, 1, None, d, 5, 5, 10.0), (3, 1, 1, None, 5, 5, 10.0), (4, 1, 1, d, 5, 6, 10.0), (5, 1, 1, d, 5, 5, 0.0), (6, 1, 8, d, 5, 5, 10.0)]
    bad = spark.createDataFrame([(8, "1d", "ValueError: x"), (1, "1h", "other")], "symbol_id int, timeframe string, error string")
    good, wrong = isolation.checked_positions(spark.createDataFrame(rows, kind), bad)
    assert [r.position_id for r in good.collect()] == [1]
    assert {r.position_id: r.error for r in wrong.collect()} == {2: "no symbol_id", 3: "no opened_on", 4: "more open than bought", 5: "entry price is not positive", 6: "ValueError: x"}
