"""Bars read from their buckets: no shuffle below the indicators, folders pruned, results as from any other table."""

from pyspark.sql import functions as F

from candlewick.operators import indicators, ledger, signals
from candlewick.sources import bar_store
from tests.test_streaming import BARS, walk


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_indicators_without_a_shuffle(spark, tmp_path):
    rows = [r for s in range(12) for r in walk(60, s, s)]
    bars = spark.createDataFrame(rows + [(r[0], "1h", *r[2:]) for r in rows[:300]], BARS)
    table = bar_store.write(bars, "bars_test", str(tmp_path / "bars"), 4)
    daily = bar_store.series(table, "1d")
    frame = indicators.indicator_frame(daily)
    assert "Exchange" not in plan_of(frame)
    assert plan_of(indicators.indicator_frame(bars)).count("Exchange") == 1
    assert plan_of(signals.run(frame).drop("details")).count("Exchange") == 1  # a grouped map's output counts as not partitioned
    scan = plan_of(daily)
    assert "PartitionFilters: [isnotnull(timeframe" in scan and "Bucketed: " in plan_of(frame)
    assert len(bar_store.files_of(spark, str(tmp_path / "bars"), "1d")) <= 4
    columns = frame.columns
    assert rows_of(frame.select(*columns)) == rows_of(indicators.indicator_frame(bars.where("timeframe = '1d'")).select(*columns))
    since = bar_store.series(table, "1d", "2026-02-01")
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan_of(since) and since.count() == bars.where("timeframe = '1d' and ts >= '2026-02-01'").count()
    # a session that does not know the table
    spark.sql("DROP TABLE bars_test")
    kinds = dict(table.dtypes)
    again = bar_store.attach(spark, "bars_again", str(tmp_path / "bars"), ", ".join(f"{c} {t}" for c, t in kinds.items()), 4)
    assert again.count() == bars.count() and "Exchange" not in plan_of(indicators.indicator_frame(bar_store.series(again, "1d")))
    spark.sql("DROP TABLE bars_again")


def test_ledger_has_one_shuffle_by_book(spark):
    fills = spark.range(50).select(F.col("id").alias("trade_id"), F.lit(1).alias("account_id"), (F.col("id") % 3).cast("int").alias("symbol_id"), F.when(F.col("id") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.lit(5).cast("long").alias("quantity"), F.lit(1.0).alias("price"), F.current_timestamp().alias("trade_ts"), F.current_date().alias("trade_date"))
    assert plan_of(ledger.allocations(fills)).count("Exchange hashpartitioning") == 1
