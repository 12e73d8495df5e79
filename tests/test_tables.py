"""Versions of tables: whole or not at all, from themselves, with races and left-overs."""

import pytest
from pyspark.sql import functions as F

from candlewick.sources import sinks, tables


def rows(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v string")


@pytest.fixture
def store(spark, tmp_path):
    return tables.Store(spark, str(tmp_path / "store"))


def test_versions_and_the_table_as_its_own_input(spark, store):
    assert store.version() == tables.Version(0, {}, {})
    with pytest.raises(KeyError):
        store.read("t")
    one = store.publish({"t": frame(spark, "a", "b"), "u": frame(spark, "x")}, {"day": 1})
    old = store.read("t")
    two = store.update("t", lambda t: t.withColumn("v", F.upper("v")).unionByName(t))
    assert (one.number, two.number) == (1, 2) and two.folders["u"] == one.folders["u"]
    assert rows(store.read("t")) == [(0, "A"), (0, "a"), (1, "B"), (1, "b")]
    assert rows(old) == rows(store.read("t", one)) == [(0, "a"), (1, "b")]  # earlier plans read on
    assert store.version(1).note == {"day": 1}


def test_a_writer_killed_half_way_changes_nothing(spark, store, monkeypatch):
    store.publish({"t": frame(spark, "a"), "u": frame(spark, "x")})
    bad = frame(spark, "b").withColumn("v", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        store.publish({"t": frame(spark, "c"), "u": bad})  # t is written, u is not
    monkeypatch.setattr(tables.Files, "move", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        store.publish({"t": frame(spark, "d")})  # all is written but the entry
    monkeypatch.undo()
    assert store.version().number == 1 and rows(store.read("t")) == [(0, "a")]
    assert len(store.vacuum(age=0)) == 2 and rows(store.read("t")) == [(0, "a")]
    assert store.publish({"t": frame(spark, "e")}).number == 2


def test_the_slower_of_two_writers_gets_a_conflict(spark, store):
    base = store.publish({"t": frame(spark, "a")})
    store.publish({"t": frame(spark, "b")})
    with pytest.raises(tables.Conflict):
        store.publish({"t": frame(spark, "c")}, base=base)
    assert rows(store.read("t")) == [(0, "b")]
    tried = []

    def change(t):
        if not tried:
            store.publish({"t": frame(spark, "between")})
        tried.append(1)
        return t.withColumn("v", F.concat("v", F.lit("!")))

    store.update("t", change)
    assert len(tried) == 2 and rows(store.read("t")) == [(0, "between!")]


def test_vacuum_keeps_what_versions_name(spark, store):
    for v in "abcd":
        store.publish({"t": frame(spark, v)})
    store.publish({"u": frame(spark, "x")})
    assert len(store.vacuum(keep=2, age=0)) == 3
    assert rows(store.read("t")) == rows(store.read("t", store.version(4))) == [(0, "d")]
    assert store.vacuum(age=0) == [] and store.numbers() == [4, 5]


def test_plain_folder_from_itself(spark, tmp_path):
    path = str(tmp_path / "plain")
    sinks.write(frame(spark, "a", "b"), path)
    sinks.write(spark.read.parquet(path).withColumn("v", F.upper("v")), path)
    assert rows(spark.read.parquet(path)) == [(0, "A"), (1, "B")]
    with pytest.raises(Exception, match="stop"):
        sinks.write(spark.read.parquet(path).withColumn("v", F.raise_error(F.lit("stop")).cast("string")), path)
    assert rows(spark.read.parquet(path)) == [(0, "A"), (1, "B")] and [p.name for p in tmp_path.iterdir()] == ["plain"]


def test_partitions_from_themselves(spark, tmp_path):
    path = str(tmp_path / "parts")
    sinks.write(spark.createDataFrame([(1, "1d", 5), (2, "1d", 6), (2, "1h", 7)], "symbol long, timeframe string, v long"), path, ("symbol", "timeframe"))
    t = spark.read.parquet(path)
    sinks.write(t.where("symbol = 2 and timeframe = '1d'").withColumn("v", F.col("v") * 10), path, ("symbol", "timeframe"))
    assert sorted((r.symbol, r.timeframe, r.v) for r in spark.read.parquet(path).collect()) == [(1, "1d", 5), (2, "1d", 60), (2, "1h", 7)]


def test_csv_files_by_exchange_and_latest(spark, tmp_path):
    panel = spark.createDataFrame([("NSE", "A", "2026-10-01", 1.0), ("NSE", "A", "2026-10-05", 2.0), ("BSE", "B", "2026-10-01", 3.0)], "exchange string, symbol string, date string, close double")
    path = str(tmp_path / "csv")
    for _ in range(2):
        sinks.write_csv_by_exchange(panel, f"{path}/each")
        sinks.write_latest_csv(panel, path)
    read = lambda p: sorted((r.symbol, r.date, r.close) for r in spark.read.option("header", True).option("inferSchema", True).csv(p).withColumn("date", F.col("date").cast("string")).collect())
    assert read(f"{path}/each") == read(f"{path}/combined") == [("A", "2026-10-01", 1.0), ("A", "2026-10-05", 2.0), ("B", "2026-10-01", 3.0)]
    assert read(f"{path}/latest") == [("A", "2026-10-05", 2.0), ("B", "2026-10-01", 3.0)]
    assert sorted(p.name for p in (tmp_path / "csv" / "each").iterdir() if p.is_dir()) == ["exchange=BSE", "exchange=NSE"]
