"""Rows that their order leaves open: the first in the file counts."""

import duckdb
import pytest
from pyspark.sql import functions as F

from candlewick.plans import views


@pytest.mark.parametrize("prices", [(100.0, 120.0, 90.0), (90.0, 120.0, 100.0)])
def test_of_rows_with_one_number_the_first_opens_and_closes(spark, tmp_path, prices):
    rows = ", ".join(f"(1::BIGINT, 7::BIGINT, 2, 1.0::DOUBLE, {p * 100}::DOUBLE, TIMESTAMP '1996-01-02')" for p in prices)
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM (VALUES {rows}) t(l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = con.execute(views.daily_bars_sql()).fetchall()
    got = views.daily_bars(spark, str(tmp_path)).select("symbol_id", "timeframe", F.col("ts"), "open", "high", "low", "close", "volume").collect()
    assert list(map(tuple, got)) == want and got[0].open == got[0].close
