"""Market operators: registered queries against their oracles, and the cases that the data does not have."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick import queries, schemas
from candlewick.functions import calendar
from candlewick.operators import adjust, bars, evaluate, indicators, ledger, listing, matching, quality, research, signals
from candlewick.operators.recurrence import smoothed
from candlewick.plans import jobs
from candlewick.sources import readers, sinks

SF = "/root/testdata/sf0.001"
D = dt.date


def canonical(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = [None if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else str(pd.Timestamp(v)) if hasattr(v, "year") else str(float(v) + 0.0) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v) for v in frame[c]]
    return sorted(map(tuple, frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in queries.oracle_sql() if not n.startswith("signal_") or n in ("signal_confluence", "signal_pipeline_relaxed")])
def test_oracle(spark, duck, name):
    got = queries.queries()[name](spark, SF).toPandas()
    want = duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def series(spark, closes, volume=1000, symbol=1):
    rows = [(symbol, "1d", D(2026, 1, 1) + dt.timedelta(i), c - 0.5, c + 1.0, c - 1.0, float(c), volume) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol_id int, timeframe string, ts date, open double, high double, low double, close double, volume long")


def test_averages_over_gaps():
    x = pd.Series([np.nan, 1, np.nan, np.nan, 3, 2])
    assert smoothed(x, 0.5).round(6).tolist()[1:] == [1, 1, 1, 2.6, 2.3]


def test_flat_series_has_no_direction(spark):
    frame = indicators.indicator_frame(series(spark, [100.0] * 30)).orderBy("ts").toPandas()
    assert frame["supertrend_dir"].eq(1).all() and frame["supertrend_10_3"].iloc[0] == 0.0 and frame["adx_14"].isna().all()
    assert frame["bb_middle"].isna().sum() == 19 and frame["rvol_20"].iloc[-1] == 1.0 and not frame["ttm_squeeze_off"].any()


def test_trailing_stop_never_falls(spark):
    tent = [100.0 + i for i in range(20)] + [119.0 - i for i in range(20)]
    frame = indicators.trailing_stop(indicators.indicator_frame(series(spark, tent))).orderBy("ts").toPandas()
    assert frame["trailing_stop"].is_monotonic_increasing
    assert frame["atr_10"].iloc[0] == 2.0


def test_volume_labels(spark):
    rows = spark.createDataFrame([(2.0,), (1.5,), (1.49,), (None,)], "rvol_20 double")
    assert [r[0] for r in rows.select(indicators.volume_label()).collect()] == ["STRONG (>=2x avg)", "CONFIRMED (>=1.5x avg)", "WEAK (<1.5x avg)", "WEAK (<1.5x avg)"]
    assert [r[0] for r in rows.select(indicators.volume_confirmed()).collect()] == [True, True, False, False]


def test_registry_and_holds(spark):
    frame = indicators.indicator_frame(series(spark, [100.0 + i % 7 for i in range(60)]))
    assert set(signals.STRATEGIES) == {"PIPELINE", "S1_ST_Flip", "S2_MACD_Zero", "S3_BB_Squeeze", "Confluence", "TTM_Squeeze"}
    assert signals.run(frame, held=spark.createDataFrame([(1, "1d")], "symbol_id int, timeframe string")).count() == 0


def test_regeneration_replaces_attempts(spark):
    kind = "symbol_id int, timeframe string, strategy string, n int"
    old = spark.createDataFrame([(1, "1d", "A", 0), (1, "1d", "B", 0), (2, "1d", "A", 0)], kind)
    out = signals.regenerated(old, spark.createDataFrame([(1, "1d", "B", 1)], kind), spark.createDataFrame([(1, "1d", "A"), (1, "1d", "B")], "symbol_id int, timeframe string, strategy string"))
    assert sorted(map(tuple, out.collect())) == [(1, "1d", "B", 1), (2, "1d", "A", 0)]


CASES = [
    ("Interim Dividend - Rs 9 Per Share Special Dividend - Rs 18 Per Share", "dividend", 27.0, None, True),
    ("Special Dividend Rs -10 Per Share", "dividend", 10.0, None, True),
    ("Dividend Rs 3.50 Per Sh", "dividend", 3.5, None, False),
    ("Distribution Rs 5.1 Per Unit Consisting Dividend Rs 2 Per Unit Interest Rs 2.28 Per Unit", "dividend", 5.1, None, False),
    ("Face Value Split (Sub-Division) - From Rs 10/- Per Share To Rs 2/- Per Share", "split", None, 0.2, True),
    ("Bonus 1:1", "bonus", None, 0.5, True),
    ("Rights 3:25 @ Premium Rs 1800/-", "rights", 1800.0, None, True),
    ("Scheme Of Arrangement", "demerger", None, None, True),
    ("Annual General Meeting", None, None, None, None),
    ("Dividend", None, None, None, None),
]


def test_subjects(spark):
    got = adjust.parse_subjects(spark.createDataFrame([(c[0],) for c in CASES], "subject string")).collect()
    assert [(r.subject, r.action_type, r.value, r.price_factor, r.is_extraordinary) for r in got] == CASES


def test_load_actions(spark):
    rows = [("AA", "Dividend Rs 27 Per Share", "05-Oct-2026", 0), ("AA", "Special Dividend Rs 75 Per Share", "05-10-2026", 1), ("AA", "Bonus 1:1", "-", 2), ("ZZ", "Bonus 1:1", "05-Oct-2026", 3), ("AA", "AGM", "05-Oct-2026", 4), ("AA", "Bonus", "05-Oct-2026", 5)]
    good, counts = adjust.load_actions(spark.createDataFrame(rows, "symbol string, subject string, ex_date string, nth int"), spark.createDataFrame([("AA", 7)], "symbol string, symbol_id int"))
    (row,) = good.collect()
    assert (row.value, row.is_extraordinary, row.subject, row.ex_date) == (102.0, True, "Dividend Rs 27 Per Share + Special Dividend Rs 75 Per Share", D(2026, 10, 5))
    assert {r.disposition: r["count"] for r in counts.collect()} == {"loaded": 2, "bad_date": 1, "unknown_symbol": 1, "not_price": 1, "unparsed": 1}


def test_restate(spark):
    kind = "position_id int, symbol_id int, opened_on date, last_restated date, qty_open long, qty_total long, avg_entry_price double, stop_loss double, structural_factor_applied double"
    p = spark.createDataFrame([(1, 1, D(2026, 6, 1), None, 1, 3, 100.0, 90.0, 1.0), (2, 1, D(2026, 7, 1), None, 5, 5, 50.0, 45.0, 1.0)], kind)
    a = spark.createDataFrame([(1, "bonus", D(2026, 6, 24), 0.4), (1, "dividend", D(2026, 6, 24), None)], "symbol_id int, action_type string, ex_date date, price_factor double")
    got = {r.position_id: r for r in adjust.restate_for_actions(p, a, F.lit(D(2026, 10, 1))).collect()}
    assert (got[1].qty_open, got[1].qty_total, got[1].avg_entry_price, got[1].last_restated) == (2, 8, 40.0, D(2026, 10, 1))
    assert (got[2].qty_open, got[2].last_restated, got[2].structural_factor_applied) == (5, None, 1.0)


def test_redownload(spark):
    kind = "symbol_id int, ts date, open double, high double, low double, close double"
    day = lambda n, c: (1, D(2026, 10, n), c, c + 1, c - 1, c)
    stored = spark.createDataFrame([day(1, 101.0), day(5, 102.0)], kind)
    for change, want in ((0.10, True), (0.03, False)):
        got = adjust.needs_redownload(stored, spark.createDataFrame([day(1, 101.0 + change), day(6, 500.0)], kind), F.lit(D(2026, 10, 6))).first()
        assert got.redownload is want


def test_sessions(spark):
    cal = calendar.sessions(spark, "2026-09-01", "2026-11-30")
    days = calendar.days(cal)
    asked = spark.createDataFrame([(dt.datetime(2026, 10, 1, 15, 29),), (dt.datetime(2026, 10, 1, 15, 30),), (dt.datetime(2026, 10, 4, 12, 0),), (dt.datetime(2026, 10, 5, 9, 0),)], "now timestamp_ntz")
    got = [r.last_closed for r in calendar.last_closed_session(asked, "now", days).orderBy("now").collect()]
    assert got == [D(2026, 9, 30), D(2026, 10, 1), D(2026, 10, 1), D(2026, 10, 1)]  # 2 October is a holiday
    pairs = spark.createDataFrame([(D(2026, 10, 1), D(2026, 10, 7)), (D(2026, 10, 7), D(2026, 10, 1))], "a date, b date")
    assert sorted(r.sessions_between for r in calendar.sessions_between(pairs, "a", "b", days).collect()) == [0, 3]
    assert calendar.shift_sessions(pairs, "a", -2, days, cal).where("a = '2026-10-01'").first().shifted == D(2026, 9, 29)
    assert [r[0] for r in calendar.recent_sessions(cal, F.lit("2026-10-05 12:00:00").cast("timestamp_ntz"), 2).collect()] == [D(2026, 10, 1), D(2026, 9, 30)]
    assert calendar.refetched_days(cal, F.lit(D(2026, 10, 5))).count() == 4
    assert spark.range(1).select(calendar.weekdays_until(F.lit(D(2026, 10, 2)), F.lit(D(2026, 10, 7)))).first()[0] == 3


def test_bars_clean_and_forming(spark):
    at = lambda h, m=15: dt.datetime(2026, 10, 1, h, m)
    rows = [("A", at(8), 1.0, 0), ("A", at(9), 2.0, 1), ("A", at(9), 999.0, 2), ("A", at(10), 3.0, 3), ("A", at(11), None, 4)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, nth int").selectExpr("*", "close open", "close high", "close low", "1L volume")
    clean = bars.clean(df, hourly=True)
    assert sorted((r.ts.hour, r.close) for r in clean.collect()) == [(9, 999.0), (10, 3.0)]
    assert bars.drop_forming(clean, F.lit("2026-10-01 10:30:00").cast("timestamp_ntz"), "1h").count() == 1
    assert spark.range(1).select(bars.period_start("5y", F.lit(D(2026, 10, 5))), bars.period_start(" 6MO", F.lit(D(2026, 10, 5)))).first()[:] == (D(2021, 10, 5), D(2026, 4, 5))
    with pytest.raises(ValueError):
        bars.period_start("week", F.current_date())


def test_ledger_against_a_loop(spark):
    draw = np.random.default_rng(4)
    rows = [(i, int(draw.integers(2)), 1, ["BUY", "SELL"][int(draw.integers(2))], int(draw.integers(1, 60)), float(draw.integers(90, 110)), dt.datetime(2026, 1, 1) + dt.timedelta(hours=i), D(2026, 1, 1)) for i in range(300)]
    fills = spark.createDataFrame(rows, "trade_id long, account_id int, symbol_id int, side string, quantity long, price double, trade_ts timestamp_ntz, trade_date date")
    lots, want = {0: [], 1: []}, set()
    for i, account, _, side, quantity, price, *_ in rows:
        if side == "BUY":
            lots[account].append([i, quantity])
            continue
        for lot in lots[account]:
            take = min(lot[1], quantity)
            if take:
                want.add((i, lot[0], take))
                lot[1] -= take
                quantity -= take
    allocated = ledger.allocations(fills)
    assert sorted((r.sell_id, r.position_id, r.qty) for r in allocated.collect()) == sorted(want)
    left = {r.position_id: r.qty_open for r in ledger.positions(fills, allocated).collect()}
    assert left == {i: q for a in lots.values() for i, q in a}
    sell, lot, qty = max(want, key=lambda w: w[2])
    whole = sum(q for s, _, q in want if s == sell)
    account = rows[sell][1]
    given = spark.createDataFrame([(sell, lot, whole, account, 1, 1.0), (-1, 0, 1, 0, 1, 1.0)], "sell_id long, position_id long, qty long, account_id int, symbol_id int, avg_entry_price double")
    now, errors = ledger.reattribute(allocated, given)
    assert [(r.position_id, r.qty) for r in now.where("is_manual").collect()] == [(lot, whole)] and errors.first().error == "unknown sale"


def test_matching(spark):
    days = calendar.days(calendar.sessions(spark, "2026-09-01", "2026-10-30"))
    fill = spark.createDataFrame([(1, 7, D(2026, 9, 22), 101.2)], "trade_id int, symbol_id int, trade_date date, price double")
    kind = "symbol_id int, ts timestamp_ntz, strategy string, entry double, stop_loss double, target_1 double, target_2 double"
    sig = lambda day, name, entry: (7, dt.datetime(2026, 9, day, 9, 15), name, entry, 95.0, 105.0, 110.0)
    best = matching.match(matching.candidates(fill, spark.createDataFrame([sig(18, "S1_ST_Flip", 100.0), sig(21, "Confluence", 100.0), sig(23, "S1_ST_Flip", 101.2), sig(18, "S1_ST_Flip", 50.0)], kind), days)).first()
    assert (best.strategy, best.sessions, best.confidence, best.reason) == ("S1_ST_Flip", 2, 0.8, "S1_ST_Flip @2026-09-18, fill 1.2% from entry")


def test_evaluation_restates(spark):
    """Positions that a split or bonus met before as_of are judged in today's terms; a fraction of a share is a mismatch."""
    days = calendar.days(calendar.sessions(spark, "2026-09-01", "2026-10-30"))
    at = [D(2026, 9, 21) + dt.timedelta(i) for i in range(5)]
    bars_ = [(s, dt.datetime(d.year, d.month, d.day), 51.0, 49.0, 50.0, 1.0, 1) for s in (1, 2, 3) for d in at]
    f = spark.createDataFrame(bars_, "symbol_id int, ts timestamp_ntz, high double, low double, close double, atr_10 double, supertrend_dir int")
    f = f.withColumns({"timeframe": F.lit("1d"), "open": F.col("close"), "volume": F.lit(1000).cast("long")})
    kind = "position_id int, account_id int, symbol_id int, opened_on date, qty_total long, qty_open long, avg_entry_price double, matched boolean, stop_loss double, target_1 double, target_2 double"
    p = spark.createDataFrame([(s, 1, s, D(2026, 9, 21), q, q, 100.0, True, 80.0, 120.0, 140.0) for s, q in ((1, 10), (2, 10), (3, 3))], kind)
    a = spark.createDataFrame([(1, "split", D(2026, 9, 23), 0.5), (3, "bonus", D(2026, 9, 23), 0.4), (2, "split", D(2026, 9, 28), 0.5)], "symbol_id int, action_type string, ex_date date, price_factor double")
    h = spark.createDataFrame([(1, 1, D(2026, 9, 24), 20)], "account_id int, symbol_id int, as_of date, quantity long")
    done = {r.position_id: r for r in evaluate.evaluate(p, f, a, h, days, F.lit(D(2026, 9, 25))).collect()}
    assert (done[1].avg_entry_price, done[1].stop_loss, done[1].target_1, done[1].qty_total, done[1].qty_sum, done[1].qty_factor) == (50.0, 40.0, 60.0, 20, 20, 0.5)
    assert done[1].pnl_pct == 0 and "STOP_HIT" not in done[1].reasons and "QTY_DIFFERS_FROM_BROKER" not in done[1].warnings
    assert done[2].avg_entry_price == 100.0 and "STOP_HIT" in done[2].reasons  # the split is still to come
    assert "QTY_MISMATCH" in done[3].reasons and done[3].qty_total == 8  # 7.5 shares


def decided(spark, **change):
    base = {
        "close": 100.0, "low": 99.0, "avg_entry_price": 95.0, "stop_loss": 90.0, "target_1": 110.0, "target_2": 120.0, "trail": 80.0, "supertrend_dir": 1, "qty_total": 10, "qty_factor": 1.0, "matched": True,
        "demerger": False, "divergence": False, "upcoming": False, "broker_qty": 10, "qty_sum": 10, "days_held": 5, "bar_date": D(2026, 10, 1), "as_of": D(2026, 10, 1),
    } | change
    kinds = {"supertrend_dir": "int", "qty_total": "long", "matched": "boolean", "demerger": "boolean", "divergence": "boolean", "upcoming": "boolean", "broker_qty": "long", "qty_sum": "long", "days_held": "int", "bar_date": "date", "as_of": "date"}
    r = evaluate.decide(spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {kinds.get(k, 'double')}" for k in base))).first()
    return r.verdict, r.reasons, r.warnings


def test_verdicts(spark):
    assert decided(spark) == ("HOLD", [], [])
    assert decided(spark, close=None) == ("REVIEW", ["NO_DATA"], [])
    assert decided(spark, close=89.0, supertrend_dir=-1)[:2] == ("EXIT", ["STOP_HIT", "SUPERTREND_FLIP"])
    assert decided(spark, close=112.0)[:2] == ("PARTIAL", ["T1_HIT"])
    assert decided(spark, close=121.0)[:2] == ("EXIT", ["T2_HIT", "T1_HIT"])
    assert decided(spark, demerger=True, close=121.0)[0] == "REVIEW"
    assert decided(spark, qty_factor=0.33)[1] == ["QTY_MISMATCH"]
    assert decided(spark, low=89.0, days_held=31, broker_qty=9, upcoming=True, divergence=True, bar_date=D(2026, 9, 30))[2] == ["LOW_BREACH", "VOLUME_DIVERGENCE", "UPCOMING_ACTION", "QTY_DIFFERS_FROM_BROKER", "HORIZON", "STALE_BAR"]
    assert decided(spark, matched=False, trail=101.0)[1] == ["STOP_HIT"]
    # a close at a level has not broken it; a low below it is a warning only then
    assert decided(spark, close=90.0, low=89.0) == ("HOLD", [], ["LOW_BREACH"]) and decided(spark, close=90.0, low=90.0) == ("HOLD", [], [])
    assert decided(spark, close=80.0, stop_loss=75.0, low=80.0) == ("HOLD", [], []) and decided(spark, close=79.0, stop_loss=75.0, low=79.0)[1] == ["TRAIL_HIT"]
    assert decided(spark, close=110.0)[:2] == ("PARTIAL", ["T1_HIT"]) and decided(spark, close=120.0)[:2] == ("EXIT", ["T2_HIT", "T1_HIT"])
    # targets are those of a matched signal, and 0 is none
    assert decided(spark, matched=False, close=121.0)[1] == [] and decided(spark, close=121.0, target_1=0.0, target_2=None)[1] == []
    assert decided(spark, close=None, days_held=99, upcoming=True, demerger=True, supertrend_dir=-1) == ("REVIEW", ["NO_DATA"], [])


def test_daily_check(spark):
    cols = "close double, open double, high double, low double, volume long, file_open double, file_high double, file_low double, file_close double, file_volume long, in_file boolean"
    rows = [(105.0, 100.0, 110.0, 90.0, 10, 100.0, 110.05, 90.0, 105.0, 10, True), (105.0, 100.0, 110.0, 90.0, 10, 100.0, 110.1, 90.0, 105.0, 11, True), (105.0, 1.0, 1.0, 1.0, 1, None, None, None, None, None, False), (None, None, None, None, None, 1.0, 1.0, 1.0, 1.0, 1, True)]
    got = [(r.status, r.note) for r in quality.check_daily(spark.createDataFrame(rows, cols)).collect()]
    assert got == [("pass", None), ("fail", "high; volume 10 != 11"), ("fail", "not in bhavcopy"), ("fail", "no stored fyers bar")]


def test_transitions_and_holds(spark):
    kind = "symbol_id int, day date, timeframe string, status string, note string"
    new = spark.createDataFrame([(1, D(2026, 10, 1), "1h", "pass", None), (2, D(2026, 10, 1), "1h", "fail", "x"), (3, D(2026, 10, 1), "1d", "pass", None)], kind)
    old = spark.createDataFrame([(1, D(2026, 10, 1), "1h", "fail", "y"), (3, D(2026, 10, 1), "1d", "pass", "close patched")], kind)
    got = {r.symbol_id: (r.resolved, r.changed, r.note) for r in quality.transitions(new, old).collect()}
    assert got == {1: (True, True, None), 2: (False, False, "x"), 3: (False, False, "close patched")}
    assert sorted(map(tuple, quality.held(new, F.lit(D(2026, 9, 1)), F.lit(D(2026, 10, 1))).collect())) == [(2, "1h"), (2, "4h")]


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, name string, v double")
    new = spark.createDataFrame([(2, "c", 3.0), (3, "d", 4.0)], "k int, name string, v double")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [(1, "a", 1.0), (2, "c", 3.0), (3, "d", 4.0)]
    assert sorted(map(tuple, sinks.upsert_columns(old, new, ["k"], ["v"]).collect())) == [(1, "a", 1.0), (2, "b", 3.0), (3, "d", 4.0)]
    kind = "symbol_id int, timeframe string, v int"
    fresh = spark.createDataFrame([(1, "1d", 9), (1, "1h", 9), (2, "1d", 9)], kind)
    assert sorted(map(tuple, sinks.rebuild(spark.createDataFrame([(1, "1d", 0), (2, "1d", 0)], kind), fresh).collect())) == [(1, "1d", 9), (1, "1h", 9), (2, "1d", 0)]


def test_readers(spark, tmp_path):
    body = '{"s": "ok", "candles": [[1788921900, 1, 2, 0.5, 1.5, 10], [1788925500, 1, 2, 0.5, 1.5, 10]]}'
    got = readers.history_pages(spark.createDataFrame([("A", body)], "symbol string, body string")).collect()
    assert [(r.ts.hour, r.ts.minute, r.volume) for r in got] == [(8, 15, 10.0), (9, 15, 10.0)]
    text = [("2026-10-01T10:00:00", 10), ("2026-10-01T04:30:00Z", 10), ("1790829000000", 10), (None, 15), ("junk", 15)]
    day = F.lit(D(2026, 10, 1))
    assert [r[0].hour for r in spark.createDataFrame(text, "t string, want int").select(readers.wall_time(F.col("t"), day)).collect()] == [w for _, w in text]
    raw = spark.createDataFrame([("2024-10-15", "reliance", "BUY", "10", "2688.00", 0), ("06-11-2024", "RELIANCE", "sell", "20.0", "1325.35", 1), ("x", "A", "BUY", "1", "1", 2), ("2024-10-15", "A", "HOLD", "1", "1", 3)], " `Date` string, Symbol string, trade_type string, Quantity string, Price string, row int")
    good, bad = readers.tradebook(raw)
    rows = good.orderBy("row").collect()
    assert [(r.symbol, r.side, r.quantity, r.trade_ts.hour, r.exchange) for r in rows] == [("RELIANCE", "BUY", 10, 15, "NSE"), ("RELIANCE", "SELL", 20, 15, "NSE")]
    assert all(len(r.trade_id) == 20 for r in rows) and sorted(map(tuple, bad.collect())) == [(2, "bad date"), (3, "bad side")]
    ranges = readers.chunks(spark.createDataFrame([(D(2026, 1, 1), D(2026, 1, 25))], "a date, b date"), "a", "b", 10).collect()
    assert [(r.lo.day, r.hi.day) for r in ranges] == [(1, 10), (11, 20), (21, 25)]
    daily = spark.createDataFrame([("X", "BE", 1, D(2026, 10, 1)), ("X", "EQ", 2, D(2026, 10, 1))], "TckrSymb string, SctySrs string, FinInstrmId long, TradDt date")
    assert readers.preferred_rows(daily).first().SctySrs == "EQ"
    assert readers.universe(spark, None).count() == 12
    with pytest.raises(ValueError):
        schemas.assert_schema(daily, "nothing int")


def test_jobs(spark):
    days = calendar.days(calendar.sessions(spark, "2026-09-01", "2026-10-30"))
    kind = "at string, enabled boolean, last_run timestamp_ntz, now timestamp_ntz"
    t = lambda d, h: dt.datetime(2026, 10, d, h)
    rows = [("09:00", True, t(1, 1).replace(month=9), t(1, 10)), ("11:00", True, None, t(1, 10)), ("09:00", True, t(1, 9), t(1, 10)), ("09:00", True, None, t(2, 10)), ("09:00", False, None, t(1, 10))]
    assert sorted(r.due for r in jobs.is_due(spark.createDataFrame(rows, kind), "now", days).collect()) == [False] * 4 + [True]
    assert jobs.parse_steps("signals, ingest,signals") == ["ingest", "signals"] and jobs.request_estimate(500)[0] == 6500
    with pytest.raises(ValueError):
        jobs.parse_steps("nothing")
    runs = spark.createDataFrame([("running", t(1, 1), "m"), ("running", t(1, 9), "m")], "status string, started_at timestamp_ntz, message string")
    assert sorted(r.status for r in jobs.reap(runs, F.lit(t(1, 10)).cast("timestamp_ntz")).collect()) == ["failed", "running"]
    kind = "symbol string, name string, industry string, isin string, active boolean"
    got = {r.symbol: (r.name, r.active, r.change) for r in jobs.merge_universe(spark.createDataFrame([("A", "old", None, None, False), ("B", "b", None, None, True)], kind), spark.createDataFrame([("A", " ", None, None), ("C", "c", None, None)], "symbol string, name string, industry string, isin string")).collect()}
    assert got == {"A": ("old", True, "updated"), "B": ("b", True, "kept"), "C": ("c", True, "created")}


def test_research(spark):
    rows = [("NSE", "A", D(2026, 1, 1) + dt.timedelta(i), 10.0 + i, 11.0 + i, 9.0 + i, 10.0 + i, 100) for i in range(40)]
    panel = spark.createDataFrame(rows, "exchange string, symbol string, date date, open double, high double, low double, close double, volume long")
    got = research.panel_indicators(panel).orderBy("date").toPandas()
    assert got["rsi14"].iloc[-1] == 100.0 and got["ema20"].isna().sum() == 19 and got["rvol20"].iloc[-1] == 1.0 and got["adx14"].iloc[-1] == 100.0
    assert research.without_entitlements(spark.createDataFrame([("A-RE",), ("A-RE2",), ("RELIANCE",)], "symbol string")).count() == 1
    sample = research.spread_sample(spark.createDataFrame([(f"s{i}", float(100 - i)) for i in range(11)], "symbol string, median_turnover double"), 3, ["s7"])
    assert {r.symbol for r in sample.collect()} == {"s7", "s0", "s5"}


def test_gaps(spark):
    rows = [("NSE", s, D(2026, 1, 5 + i), c, p, 100) for s in ("A", *(f"x{k}" for k in range(60))) for i, (c, p) in enumerate([(100.0, None), (50.0 if s == "A" else 101.0, 100.0), (51.0 if s == "A" else 140.0, 50.0)])]
    panel = spark.createDataFrame(rows, "exchange string, symbol string, date date, close double, prev_close double, volume long").selectExpr("*", "close open", "close high", "close low")
    got = {(r.symbol, r.date.day): r for r in adjust.detect_gaps(panel).collect()}
    assert (got[("A", 5)].adj_close, got[("A", 5)].adj_volume, got[("A", 6)].flag, got[("x0", 7)].flag) == (50.0, 200.0, "adjusted", "review")


def test_indian_digits(spark):
    rows = spark.createDataFrame([(1234567.0,), (999.0,), (-100000.0,), (1000.4,)], "x double")
    assert [r[0] for r in rows.select(listing.indian_digits(F.col("x"))).collect()] == ["12,34,567", "999", "-1,00,000", "1,000"]


def test_stream_equals_batch(spark, tmp_path):
    from candlewick.plans import views
    from candlewick.streaming.bars import stream_bars, tick_stream, write_stream

    ticks = views.ticks(spark, "/root/testdata/sf0.01").select("symbol", F.col("ts").cast("timestamp").alias("ts"), "price", F.col("volume").cast("long").alias("volume"))
    last = ticks.agg(F.max("ts")).first()[0]
    # a tick far ahead closes all windows
    ahead = spark.createDataFrame([("end", last.replace(hour=10) + dt.timedelta(days=9), 1.0, 1)], ticks.schema)
    ticks.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    ahead.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = tick_stream(spark, f"{tmp_path}/in", "symbol string, ts timestamp, price double, volume bigint", files=10)
    write_stream(stream_bars(stream), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").where("symbol <> 'end'")
    want = bars.from_ticks(ticks)
    assert got.count() == want.count() and got.join(want, ["symbol", "ts", "open", "high", "low", "close", "volume"]).count() == want.count()


def test_panel_skips_files_that_are_no_daily_file(spark, tmp_path):
    head = "TradDt,ISIN,TckrSymb,SctySrs,FinInstrmNm,OpnPric,HghPric,LwPric,ClsPric,LastPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal,TtlNbOfTxsExctd,FinInstrmTp"
    (tmp_path / "a.csv").write_text("<html><body>not yet</body></html>\n")
    (tmp_path / "b.csv").write_text("\ufeff" + head + "\n2026-10-01,I1,AAA,EQ,A,1,2,1,2,2,1,10,20,3,STK\n2026-10-01,I2,BBB,GS,B,1,2,1,2,2,1,10,20,3,STK\n")
    assert [(r.symbol, r.close, str(r.date)) for r in readers.panel(spark, str(tmp_path), "NSE").collect()] == [("AAA", 2.0, "2026-10-01")]


def test_independent_slow_averages(spark):
    """The last bar of the research panel by literal loops."""
    rng = np.random.default_rng(4)
    close = 100 + np.cumsum(rng.normal(size=120))
    high, low = close + rng.random(120), close - rng.random(120)
    rows = [("NSE", "A", D(2026, 1, 1) + dt.timedelta(i), float(h), float(lo), float(c), 100) for i, (h, lo, c) in enumerate(zip(high, low, close))]
    last = research.panel_indicators(spark.createDataFrame(rows, "exchange string, symbol string, date date, high double, low double, close double, volume long")).orderBy("date").collect()[-1]

    def slow(x, n, alpha):
        value = sum(x[:n]) / n
        for v in x[n:]:
            value = (1 - alpha) * value + alpha * v
        return value

    moves = [close[i] - close[i - 1] for i in range(1, 120)]
    ranges = [max(high[i] - low[i], abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])) for i in range(1, 120)]
    up, down = slow([max(m, 0) for m in moves], 14, 1 / 14), slow([max(-m, 0) for m in moves], 14, 1 / 14)
    assert abs(last.ema20 - slow(list(close), 20, 2 / 21)) < 1e-9 and abs(last.atr14 - slow(ranges, 14, 1 / 14)) < 1e-9
    assert abs(last.rsi14 - (100 - 100 / (1 + up / down))) < 1e-9
