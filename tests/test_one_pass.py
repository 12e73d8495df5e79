"""The indicator frame is made once in a query, and many series at a time."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from candlewick import queries
from candlewick.operators import recurrence, research

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["signal_confluence", "signals_not_held", "list_session_summary", "list_confluence_badge"])
def test_the_frame_is_made_once(spark, name):
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroups" not in plan


@pytest.mark.parametrize("name", ["evaluate_positions", "evaluate_restated"])
def test_what_is_judged_reads_a_stored_frame(spark, name):
    """Signals, last bars and trails come from one frame, and the matched positions that all joins read are made once."""
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "get_json_object" not in plan and "to_json" not in plan and "S1_ST_Flip" not in plan


def test_the_stored_frame_has_the_traded_symbols(spark):
    fills = queries.near_fills(spark, SF).where("symbol_id < 5")
    got, want = queries.traded_frame(spark, SF, fills), queries.frame(spark, SF).where("symbol_id in (1, 2, 3, 4)")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count()


def test_looks_back_are_taken_in_the_pass(spark):
    """Windows of 20 rows cost Spark more than all recurrences; one window is left, which numbers the rows."""
    plan = queries.queries()["indicators"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("+- Window") == 1 and "stddev" not in plan


def test_broken_series_are_sifted_in_the_same_pass(spark):
    plan = queries.queries()["signals_bad_rows"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroups" not in plan and plan.count("Relation [") == 1


def test_looks_back_of_many_series():
    rng = np.random.default_rng(2)
    sizes = [1, 19, 20, 45, 3, 60]
    each = [pd.DataFrame({"close": (c := 100 + rng.normal(0, 1, n).cumsum()), "high": c + rng.uniform(0, 1, n), "low": c - rng.uniform(0, 1, n), "volume": rng.integers(1, 99, n)}) for n in sizes]
    each[3].loc[7, "close"] = np.nan
    got = recurrence.looks_back(pd.concat(each, ignore_index=True), np.concatenate([np.arange(1, n + 1) for n in sizes]))
    for b in each:
        prev, up, down = b.close.shift(), b.high.diff().clip(lower=0).fillna(0), (-b.low.diff()).clip(lower=0).fillna(0)
        b["true_range"] = pd.concat([b.high - b.low, (b.high - prev).abs(), (b.low - prev).abs()], axis=1).max(axis=1)
        b["plus_dm"], b["minus_dm"] = up.where(up >= down, 0).where(prev.notna()), down.where(down >= up, 0).where(prev.notna())
        b["range_mid"] = (b.high.rolling(20).max() + b.low.rolling(20).min()) / 2
        b["bb_middle"], b["spread"], b["volume_ma_20"] = b.close.rolling(20).mean(), b.close.rolling(20).std(), b.volume.rolling(20).mean()
    want = pd.concat(each, ignore_index=True)
    pd.testing.assert_frame_equal(got[want.columns], want, rtol=1e-9)


def test_the_panel_takes_many_series_at_once(spark):
    plan = queries.queries()["research_panel_frame"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroups" not in plan


def test_seeded_of_many_series():
    rng = np.random.default_rng(3)
    each = [np.where(rng.uniform(size=n) < 0.1, np.nan, rng.uniform(size=n)) for n in (1, 13, 14, 40, 2, 300)] + [np.full(20, np.nan), np.arange(30.0)]
    got = research.seeded(np.concatenate(each), 14, 1 / 14, np.cumsum([0, *map(len, each[:-1])]))
    np.testing.assert_array_equal(got, np.concatenate([research.seeded(x, 14, 1 / 14) for x in each]))
    x, begin = each[-1], 14
    want = [np.nan] * 13 + [x[:14].mean()]
    for v in x[begin:]:
        want.append(want[-1] * 13 / 14 + v / 14)
    np.testing.assert_allclose(research.seeded(x, 14, 1 / 14), want)


def bars(rng, n):
    close = 100 + rng.normal(0, 1, n).cumsum()
    frame = pd.DataFrame({"ts": pd.date_range("2026-01-01", periods=n), "high": close + 1, "low": close - 1, "close": close, "spread": rng.uniform(0, 2, n), "bb_middle": close + 0.1})
    gaps = lambda: np.where(rng.uniform(size=n) < 0.1, np.nan, rng.uniform(0, 2, n))
    return frame.assign(true_range=rng.uniform(0, 2, n), plus_dm=gaps(), minus_dm=gaps(), range_mid=gaps() + 99)


def test_many_series_at_once_give_what_each_gives():
    rng = np.random.default_rng(1)
    each = [bars(rng, n) for n in (1, 2, 40, 1, 300)]
    first = np.concatenate([np.arange(len(b)) == 0 for b in each])
    got = recurrence._added(pd.concat(each, ignore_index=True), 3.0, first)
    want = pd.concat([recurrence.recurrences(b) for b in each], ignore_index=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_exact=True)


def test_series_are_not_cut_at_batches():
    sizes = [3, 1, 50, 2, 2, 7]
    nth = np.concatenate([np.arange(1, n + 1) for n in sizes]).astype("int32")
    for size in (1, 4, 9, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(nth[i : i + size])], ["_nth"]) for i in range(0, len(nth), size)]
        got = [t.column("_nth").to_pylist() for t in recurrence.whole_series(iter(batches), 6)]
        assert sum(got, []) == nth.tolist() and all(t[0] == 1 for t in got)
    assert list(recurrence.whole_series(iter([]))) == []
