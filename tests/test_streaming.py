"""Streams against the batch operators on the same rows: indicators with a restart, late ticks and replayed batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from candlewick.operators import bars, indicators
from candlewick.sources.tables import Store
from candlewick.streaming import merge
from candlewick.streaming.indicators import COLUMNS, step, fresh, write_indicators

BARS = "symbol_id int, timeframe string, ts timestamp, open double, high double, low double, close double, volume long"


def walk(n, symbol, seed):
    draw, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        price = max(5.0, price * (1 + draw.gauss(0.0005, 0.02)))
        a, b = price * (1 + draw.gauss(0, 0.004)), price
        out.append((symbol, "1d", dt.datetime(2026, 1, 1) + dt.timedelta(days=i), a, max(a, b) * 1.004, min(a, b) * 0.996, b, draw.randrange(1000, 9000)))
    flat = out[-1]
    return out + [(symbol, "1d", flat[2] + dt.timedelta(days=i), 50.0, 50.0, 50.0, 50.0, 100) for i in range(1, 40)]  # no range at all


def compare(got, want):
    assert set(got) == set(want)
    for key, row in want.items():
        for c in COLUMNS:
            a, b = got[key][c], row[c]
            assert (a is None) == (b is None), (key, c, a, b)
            assert a is None or abs(a - b) <= 1e-7 * max(1, abs(b)), (key, c, a, b)


def test_indicators_of_micro_batches_with_a_restart(spark, tmp_path):
    rows = [r for s in range(3) for r in walk(260, s, s)]
    rows += walk(7, 9, 9)[:7]  # a series that is shorter than every window
    first = rows[0][2]
    cuts = [0, 10, 25, 150, 400]

    def put(a, b):
        part = [r for r in rows if a <= (r[2] - first).days < b]
        spark.createDataFrame(part, BARS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        write_indicators(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()

    put(*cuts[:2]), put(*cuts[1:3]), run()
    put(*cuts[2:4]), put(*cuts[3:5]), run()  # goes on from the checkpoint
    run()  # nothing new
    spark.createDataFrame(rows[:3], BARS).write.mode("append").parquet(str(tmp_path / "in"))
    run()  # bars that the state has passed
    key = lambda r: (r.symbol_id, r.ts)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == len(rows)
    want = indicators.indicator_frame(spark.createDataFrame(rows, BARS)).collect()
    compare({key(r): r for r in out}, {key(r): r for r in want})


def test_a_bar_costs_the_same_however_long_the_series(spark):
    state = fresh()
    for r in walk(500, 1, 4):
        step(state, dict(zip(("open", "high", "low", "close", "volume"), r[3:], strict=True)))
    assert len(state["bars"]) == 20


TICKS = "symbol string, ts timestamp_ntz, price double, volume long"


def ticks(n, seed, days=4):
    draw = random.Random(seed)
    return [(draw.choice("AB"), dt.datetime(2026, 10, 1 + draw.randrange(days), 9 + draw.randrange(6), draw.randrange(60), draw.randrange(60)), float(draw.randrange(90, 110)), draw.randrange(1, 9)) for _ in range(n)]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("symbol", "ts", "open", "high", "low", "close", "volume").collect())


def test_late_ticks_change_a_stored_bar_once(spark, tmp_path):
    every = ticks(900, 3)
    draw = random.Random(7)
    parts = [[], [], [], []]
    for t in every:
        parts[min(3, t[1].day - 1 + draw.choice([0, 0, 0, 1, 3]))].append(t)  # some days late, beyond any watermark
    store = Store(spark, str(tmp_path / "store"))
    for p in parts:
        spark.createDataFrame(p, TICKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    merge.merge_stream(stream(), store, "bars", "ticks", str(tmp_path / "check")).awaitTermination()
    want = rows_of(merge.parts(spark.createDataFrame(every, TICKS)))
    assert rows_of(merge.stored_bars(store, "bars")) == want and store.version().number == 4
    # a replay of the whole stream, as after a lost checkpoint, and of single batches
    merge.merge_stream(stream(), store, "bars", "ticks", str(tmp_path / "other")).awaitTermination()
    assert not merge.merge(store, "bars", merge.parts(spark.createDataFrame(parts[1], TICKS)), "ticks", 1)
    assert rows_of(merge.stored_bars(store, "bars")) == want and store.version().number == 4
    # another stream's batch of the same number counts; only its day is written anew
    before = store.version()
    late = [("A", dt.datetime(2026, 10, 2, 9, 15), 500.0, 1)]
    assert merge.merge(store, "bars", merge.parts(spark.createDataFrame(late, TICKS)), "corrections", 0)
    now = store.version()
    assert [n for n in now.folders if now.folders[n] != before.folders.get(n)] == ["bars/2026-10-02"]
    assert rows_of(merge.stored_bars(store, "bars")) == rows_of(merge.parts(spark.createDataFrame(every + late, TICKS)))
    assert store.vacuum(keep=1, age=0) and rows_of(merge.stored_bars(store, "bars")) == rows_of(merge.parts(spark.createDataFrame(every + late, TICKS)))


def test_a_batch_that_dies_before_its_entry_is_merged_when_sent_again(spark, tmp_path, monkeypatch):
    store, some = Store(spark, str(tmp_path / "store")), spark.createDataFrame(ticks(50, 5), TICKS)
    monkeypatch.setattr(Store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    try:
        merge.merge(store, "bars", merge.parts(some), "ticks", 0)
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert store.version().number == 0
    assert merge.merge(store, "bars", merge.parts(some), "ticks", 0)
    assert rows_of(merge.stored_bars(store, "bars")) == rows_of(merge.parts(some))


def test_parts_equal_the_batch_bars(spark):
    some = spark.createDataFrame(sorted({(t[0], t[1]): t for t in ticks(400, 8)}.values()), TICKS)
    got = rows_of(merge.parts(some))
    want = bars.from_ticks(some.withColumn("event_id", F.lit(1)))
    assert [(r[0], r[1], *r[2:]) for r in got] == rows_of(want.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
