"""The stored ledger against a loop over fills, day by day, with splits between the batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from candlewick.operators import adjust, book
from candlewick.sources.tables import Store

FILLS = "trade_id long, account_id int, symbol_id int, side string, quantity long, price double, trade_ts timestamp_ntz, trade_date date"
ACTIONS = "symbol_id int, action_type string, ex_date date, price_factor double"
START = dt.datetime(2026, 1, 1, 9, 15)


def random_fills(draw, n, late):
    """(batch, fill): fills of three batches by time; with `late`, some of an earlier time come in a later batch."""
    rows = []
    for i in range(n):
        ts = START + dt.timedelta(days=draw.randrange(90), minutes=draw.randrange(300))
        batch = (ts - START).days // 30
        if late and draw.random() < 0.25:
            batch = min(2, batch + 1)
        rows.append((batch, (i, draw.randrange(2), draw.randrange(3), draw.choice(["BUY", "BUY", "SELL"]), draw.randrange(1, 30), float(draw.randrange(90, 120)), ts, ts.date())))
    return rows


def factor(actions, symbol, since, until):
    out = 1.0
    for s, kind, ex, f in sorted(actions, key=lambda a: a[2]):
        if s == symbol and kind in ("split", "bonus") and f is not None and since < ex <= until:
            out *= f
    return out


def loop(batches, actions):
    """Fill by fill; batches: [(day, fills)]."""
    positions, allocations, orphans = {}, [], []
    for nth, (day, fills) in enumerate(batches):
        for tid, acc, sym, side, qty, price, _ts, date in sorted(fills, key=lambda f: (f[6], f[0])):
            if sym is None:
                continue
            f = factor(actions, sym, date, day)
            q, p = round(qty / f), price * f
            if side == "BUY":
                positions[tid] = {"acc": acc, "sym": sym, "opened": date, "order": len(positions), "total": q, "open": q, "avg": p, "applied": f, "since": day, "status": "open", "closed": None, "exit": None, "sum": 0.0}
                continue
            for pid, pos in sorted(positions.items(), key=lambda x: (x[1]["opened"], x[1]["order"])):
                take = min(pos["open"], q)
                if pos["status"] != "open" or (pos["acc"], pos["sym"]) != (acc, sym) or take <= 0:
                    continue
                allocations.append((tid, pid, take, round((p - pos["avg"]) * take, 6)))
                pos["sum"] += (p - pos["avg"]) * take
                pos["open"] -= take
                q -= take
                if not pos["open"]:
                    pos |= {"status": "closed", "closed": date, "exit": tid}
            if q:
                orphans.append((nth, tid, q))
        for pos in positions.values():
            f = factor(actions, pos["sym"], pos["since"], day)
            if pos["status"] == "open" and f != 1:
                pos |= {"avg": pos["avg"] * f, "open": round(pos["open"] / f), "total": round(pos["total"] / f), "applied": pos["applied"] * f, "since": day}
    return positions, allocations, orphans


@pytest.mark.parametrize("late", [False, True])
def test_batches_equal_the_loop(spark, late, tmp_path):
    draw = random.Random(11 + late)
    rows = random_fills(draw, 260, late)
    actions = [(s, kind, START.date() + dt.timedelta(days=d), f) for s, kind, d, f in ((0, "split", 20, 0.5), (0, "bonus", 45, 2 / 3), (1, "bonus", 31, 0.4), (1, "split", 75, 0.1), (2, "dividend", 40, None), (0, "split", 200, 0.5))]
    days = [START.date() + dt.timedelta(days=d) for d in (29, 59, 92)]
    batches = [(day, [f for b, f in rows if b == nth]) for nth, day in enumerate(days)]
    positions, allocations, orphans = loop(batches, actions)
    acts = spark.createDataFrame(actions, ACTIONS)
    store, left = Store(spark, str(tmp_path / "ledger")), []
    for nth, (day, fills) in enumerate(batches):
        before = book.load(store)
        sent = fills + (batches[nth - 1][1] if nth else [])  # the batch before is sent again
        after, report = book.apply_fills(before, spark.createDataFrame(sent, FILLS), acts, F.lit(day), nth)
        left += [(nth, r.trade_id, r.leftover) for r in report.orphans.collect()]
        book.save(store, book.restate_open(after, acts, F.lit(day)))
    done = book.load(store)
    assert sorted(left) == sorted(orphans)
    assert sorted((r.sell_id, r.position_id, r.qty, round(r.realized_pnl, 6)) for r in done.allocations.collect()) == sorted(allocations)
    got = {r.position_id: (r.status, r.qty_open, r.qty_total, round(r.avg_entry_price, 9), round(r.structural_factor_applied, 12), r.closed_on, r.exit_trade_id, r.realized_pnl is None) for r in done.positions.collect()}
    assert got == {i: (p["status"], p["open"], p["total"], round(p["avg"], 9), round(p["applied"], 12), p["closed"], p["exit"], p["status"] == "open") for i, p in positions.items()}
    for r in done.positions.where("status = 'closed'").collect():
        p = positions[r.position_id]
        assert abs(r.realized_pnl - p["sum"]) < 1e-6 and abs(r.pnl_pct - p["sum"] / (p["avg"] * p["total"])) < 1e-9
    assert sorted(r.trade_id for r in done.applied.collect()) == sorted(f[0] for _, f in rows)


def test_bad_fills_are_reported_and_wait(spark):
    at = START
    rows = [(1, 1, 1, "BUY", 10, 100.0, at, at.date()), (2, 1, None, "BUY", 5, 1.0, at, at.date()), (3, 1, 1, "SELL", None, 1.0, at, at.date()), (4, 1, 9, "BUY", 5, 50.0, at, at.date()), (5, 1, 1, "SELL", 4, 110.0, at + dt.timedelta(hours=1), at.date()), (6, 1, 1, "BUY", 5, None, at, at.date()), (7, 1, 1, "GIFT", 5, 1.0, at, at.date())]
    acts = spark.createDataFrame([(9, "split", at.date() + dt.timedelta(days=1), 0.0)], ACTIONS)
    before = book.empty(spark)
    after, report = book.apply_fills(before, spark.createDataFrame(rows, FILLS), acts, F.lit(at.date() + dt.timedelta(days=5)), 0)
    assert {(r.trade_id, r.error) for r in report.errors.collect()} == {(3, "no quantity"), (4, "no factor"), (6, "no price"), (7, "no side")}
    assert [r.trade_id for r in report.unmapped.collect()] == [2]
    assert [(r.trade_id, r.position_id) for r in after.applied.orderBy("trade_id").collect()] == [(1, 1), (5, 1)]
    assert tuple(report.counts(before, after).first()) == (1, 1, 0, 1, 4)
    # what was wrong is put right and sent again with all the rest
    fixed = [(*r[:4], r[4] or 3, r[5] or 99.0, *r[6:]) if r[0] in (3, 6) else r for r in rows]
    again, report = book.apply_fills(after, spark.createDataFrame(fixed, FILLS), acts, F.lit(at.date()), 1)
    assert {(r.position_id, r.qty_open) for r in again.positions.collect()} == {(1, 3), (4, 5), (6, 5)} and report.errors.count() == 1


def test_reattribution_opens_and_closes(spark):
    at = [START + dt.timedelta(days=i) for i in range(4)]
    rows = [(1, 1, 1, "BUY", 10, 100.0, at[0], at[0].date()), (2, 1, 1, "BUY", 10, 200.0, at[1], at[1].date()), (3, 1, 1, "SELL", 10, 150.0, at[2], at[2].date()), (4, 1, 2, "BUY", 10, 1.0, at[0], at[0].date())]
    acts = spark.createDataFrame([], ACTIONS)
    b, _ = book.apply_fills(book.empty(spark), spark.createDataFrame(rows, FILLS), acts, F.lit(at[3].date()), 0)
    over = lambda *o: spark.createDataFrame(o, "sell_id long, position_id long, qty long")
    state = lambda x: {r.position_id: (r.status, r.qty_open, r.exit_trade_id, r.realized_pnl) for r in x.positions.collect()}
    assert state(b)[1] == ("closed", 0, 3, 500.0)
    moved, errors = book.reattribute(b, over((3, 2, 10)))
    assert state(moved)[1] == ("open", 10, None, None) and state(moved)[2] == ("closed", 0, 3, -500.0) and errors.count() == 0
    part, _ = book.reattribute(b, over((3, 1, 4), (3, 2, 6)))
    assert state(part)[1] == ("open", 6, None, None) and state(part)[2] == ("open", 4, None, None)
    assert {(r.position_id, r.qty, r.realized_pnl) for r in part.allocations.collect()} == {(1, 4, 200.0), (2, 6, -300.0)}
    for given, error in (((3, 1, 9),), "quantity differs"), (((3, 4, 10),), "another book"), (((8, 1, 1),), "unknown sale"):
        same, errors = book.reattribute(b, over(*given))
        assert [r.error for r in errors.collect()] == [error] and state(same) == state(b)


def test_factors_equal_the_loop_and_need_no_range_join(spark):
    draw = random.Random(5)
    day = lambda n: START.date() + dt.timedelta(days=n)
    actions = [(draw.randrange(4), draw.choice(["split", "bonus", "dividend"]), day(draw.randrange(60)), draw.choice([0.5, 0.1, 2 / 3, 0.4, None])) for _ in range(60)]
    rows = [(i, draw.randrange(5), day(draw.randrange(-5, 65)), day(draw.randrange(-5, 65))) for i in range(200)] + [(200, None, day(3), day(9)), (201, 1, None, day(9))]
    df, acts = spark.createDataFrame(rows, "i int, symbol_id int, a date, b date"), spark.createDataFrame(actions, ACTIONS)
    want = lambda s, a, b: 1.0 if s is None or a is None else factor(actions, s, a, b)
    plans = {"after": (adjust.factor_after(df, acts, "a"), lambda r: day(999)), "until": (adjust.factor_after(df, acts, "a", F.lit(day(30))), lambda r: day(30)), "between": (adjust.factor_between(df, acts, "a", "b"), lambda r: r[3])}
    for got, until in plans.values():
        found = {r.i: r.factor for r in got.collect()}
        assert len(found) == len(rows)
        for r in rows:
            assert found[r[0]] == pytest.approx(want(r[1], r[2], until(r)), rel=1e-12)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
