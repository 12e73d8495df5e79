"""Symbols with so many announcements that products leave the range of a double, and days with many texts."""

import datetime as dt
import math

from pyspark.sql import functions as F

from candlewick.operators import adjust

D = dt.date


def test_logarithms_of_many_factors_stay_in_range(spark):
    day = D(2026, 1, 1)
    splits = spark.createDataFrame([(1, "split", D(2026, 2, 1), 0.1, None)] * 400, "symbol_id int, action_type string, ex_date date, price_factor double, value double")
    fills = spark.createDataFrame([(1, day), (1, D(2026, 2, 1)), (2, day)], "symbol_id int, trade_date date")
    got = {(r.symbol_id, r.trade_date): r.f for r in adjust.factor_after(fills, splits, "trade_date", name="f", log=True).collect()}
    assert math.isclose(got[1, day], 400 * math.log(0.1)) and got[1, D(2026, 2, 1)] == got[2, day] == 0.0
    bars = spark.createDataFrame([(s, "1d", d, 100.0, 100.0) for s in (1, 2) for d in (day, D(2026, 3, 1))], "symbol_id int, timeframe string, ts date, open double, close double")
    got = {(r.symbol_id, r.ts): r.volume_factor for r in adjust.volume_factors(bars, splits, "unadjusted", log=True).collect()}
    assert math.isclose(got[1, day], 400 * math.log(10)) and got[1, D(2026, 3, 1)] == got[2, day] == 0.0
    dividends = splits.withColumns({"action_type": F.lit("dividend"), "value": F.lit(99.0)})
    got = {(r.symbol_id, r.ts): r.adjustment for r in adjust.total_return(bars, dividends, log=True).collect()}
    assert math.isclose(got[1, day], 400 * math.log(0.01)) and got[1, D(2026, 3, 1)] == got[2, day] == 0.0
    assert {r.adjustment for r in adjust.total_return(bars, dividends, "unadjusted", log=True).collect()} == {0.0}


def test_the_number_of_texts_is_that_of_all_though_the_subject_is_cut(spark):
    rows = [("AA", "Interim Dividend - Rs 10 Per Share", "2026-01-05", n) for n in range(100)] + [("AA", "Bonus 1:1", "2026-01-05", n) for n in (200, 201)]
    feed, known = spark.createDataFrame(rows, "symbol string, subject string, ex_date string, nth int"), spark.createDataFrame([("AA", 7)], "symbol string, symbol_id int")
    got = {r.action_type: r for r in adjust.load_actions(feed, known)[0].collect()}
    assert (got["dividend"].n_texts, got["dividend"].value, len(got["dividend"].subject)) == (100, 1000.0, 512)
    assert got["bonus"].n_texts == 1


def test_a_quantity_beyond_a_long_does_not_stop_the_others(spark):
    from candlewick.operators import book, ledger

    actions = spark.createDataFrame([(1, "split", D(2026, 2, 1), 0.1, None)] * 30 + [(2, "split", D(2026, 2, 1), 0.5, None)] * 57 + [(4, "split", D(2026, 2, 1), 0.1, None)] * 400, "symbol_id int, action_type string, ex_date date, price_factor double, value double")
    rows = [(n, 1, s, side, 40, 10.0, dt.datetime(2026, 1, n), D(2026, 1, n)) for n, s, side in ((1, 1, "BUY"), (2, 2, "BUY"), (3, 2, "BUY"), (4, 3, "BUY"), (5, 3, "SELL"), (6, 1, "SELL"), (7, 4, "BUY"))]
    rows += [(8, 1, 1, "BUY", 5, 10.0, dt.datetime(2026, 3, 1), D(2026, 3, 1)), (9, 1, 1, "SELL", 2, 11.0, dt.datetime(2026, 3, 2), D(2026, 3, 2))]
    fills = spark.createDataFrame(rows, "trade_id long, account_id int, symbol_id int, side string, quantity long, price double, trade_ts timestamp_ntz, trade_date date")
    until = F.lit("2026-04-01").cast("date")
    stored = ledger.in_stored_terms(fills, actions, until)
    assert {r.trade_id: r.quantity for r in stored.collect()} == {1: None, 2: 40 * 2**57, 3: 40 * 2**57, 4: 40, 5: 40, 6: None, 7: None, 8: 5, 9: 2}
    held = ledger.positions(stored.withColumn("quantity", F.col("quantity").cast("decimal(20,0)")))
    assert {r.position_id: (r.qty_open, r.status) for r in held.collect()} == {1: (None, "open"), 2: (40 * 2**57, "open"), 3: (40 * 2**57, "open"), 4: (0, "closed"), 7: (None, "open"), 8: (3, "open")}
    after, report = book.apply_fills(book.empty(spark), fills.where("symbol_id <> 2"), actions, until, 0)
    assert {r.trade_id: r.error for r in report.errors.collect()} == {1: "quantity out of range", 6: "quantity out of range", 7: "no factor"}
    assert {r.position_id: r.qty_open for r in after.positions.collect()} == {4: 0, 8: 3}


def test_a_factor_out_of_range_is_for_review(spark):
    from candlewick.operators import evaluate

    position = spark.createDataFrame([(1, 1, D(2026, 1, 1), 10, 10, 100.0, None, 1.0)], "position_id long, symbol_id int, opened_on date, qty_open long, qty_total long, avg_entry_price double, last_restated date, structural_factor_applied double")
    splits = spark.createDataFrame([(1, "split", D(2026, 2, 1), 0.1, None)] * 400, "symbol_id int, action_type string, ex_date date, price_factor double, value double")
    held = adjust.restate_for_actions(position, splits, F.lit("2026-03-01").cast("date"), "double").withColumnRenamed("structural_factor_applied", "qty_factor")
    none = {c: F.lit(None).cast("double") for c in ("stop_loss", "target_1", "target_2", "trail")} | {c: F.lit(False) for c in ("matched", "demerger", "divergence", "upcoming")}
    rows = held.withColumns(none | {"close": F.lit(90.0), "low": F.lit(90.0), "supertrend_dir": F.lit(1), "broker_qty": F.lit(10), "qty_sum": F.col("qty_open"), "days_held": F.lit(5), "bar_date": F.lit(D(2026, 3, 1)), "as_of": F.lit(D(2026, 3, 1))})
    r = evaluate.decide(rows).first()
    assert (r.verdict, r.reasons, r.warnings, r.pnl_pct) == ("REVIEW", ["QTY_MISMATCH"], ["QTY_DIFFERS_FROM_BROKER"], math.inf)
