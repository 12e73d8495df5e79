"""Market datasets derived from the generic test tables, in Spark and (for oracles) in SQL.

Daily bars: symbol = supplier, day = ship date, price from the unit price.  View "flat" moves little; view "wave" adds a
slow wave, so that trends occur.  Prices are rounded to 4 digits in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SER = ["symbol_id", "timeframe"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, digits: int = 4) -> Column:
    """Half-even at the digit, as both engines compute it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.rint(c * 10**digits) / 10**digits


def ohlcv(df: DataFrame, keys: list[str], price: str, order: str, volume: str, back: str | None = None) -> DataFrame:
    """G1: first, highest, lowest, last price and summed volume of each group, first and last by `order` (the last by `back`, if
    named)."""
    return df.groupBy(*keys).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, back or order).alias("close"), F.sum(volume).cast("long").alias("volume"),
    )


def daily_bars(spark: SparkSession, sf_dir: str, view: str = "flat") -> DataFrame:
    """symbol_id, timeframe, ts (the day), open, high, low, close, volume.  Of rows with one number the first in the file counts, for
    the open and for the close; a decimal holds number and place, as an aggregate by hash takes no struct.  Rows are dealt by symbol
    once, for the bars and for windows over a series; there is hardly more than one row a bar, so adding up before gains nothing."""
    lines = table(spark, sf_dir, "lineitem")
    nth, place = (F.col("l_orderkey") * 16 + F.col("l_linenumber")).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)"), F.col("_metadata.row_index").cast("decimal(18,0)")
    level = F.lit(100.0) if view == "flat" else 100 * (1 + 0.25 * F.sin(F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")) / F.lit(150.0)))
    price = rounded(level * (1 + 0.004 * (F.ln(F.col("l_extendedprice") / F.col("l_quantity")) - 9)))
    rows = lines.select(
        F.col("l_suppkey").cast("int").alias("symbol_id"), F.lit("1d").alias("timeframe"), F.to_date("l_shipdate").alias("ts"),
        price.alias("price"), (nth + place).alias("nth"), (nth - place).alias("back"), F.col("l_quantity").alias("quantity"),
    )
    return ohlcv(rows.repartition("symbol_id"), [*SER, "ts"], "price", "nth", "quantity", "back")


def daily_bars_sql(view: str = "flat") -> str:
    level = "100.0" if view == "flat" else "100*(1+0.25*sin(datediff('day', DATE '1995-01-01', l_shipdate::DATE)/150.0))"
    return f"""SELECT symbol_id, '1d' AS timeframe, ts, arg_min(price, nth) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, nth) AS close, sum(quantity)::BIGINT AS volume
FROM (SELECT l_suppkey::INT AS symbol_id, l_shipdate::DATE AS ts, l_orderkey*16+l_linenumber AS nth, l_quantity AS quantity,
  round_even({level}*(1+0.004*(ln(l_extendedprice/l_quantity)-9))*1e4, 0)/1e4 AS price FROM lineitem) GROUP BY symbol_id, ts"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts (exchange wall time), price, volume: the events that fall in a session's hours."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    return table(spark, sf_dir, "events").where((minute >= 555) & (minute < 930)).select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), F.lit(1).alias("volume"), "event_id")


TICKS_SQL = "SELECT event_type AS symbol, ts, value AS price, 1 AS volume, event_id FROM events WHERE hour(ts)*60+minute(ts) >= 555 AND hour(ts)*60+minute(ts) < 930"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol_id, symbol, industry, active."""
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    named = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select(F.col("s_suppkey").cast("int").alias("symbol_id"), F.col("s_name").alias("symbol"), F.col("n_name").alias("industry"), (F.col("s_acctbal") >= 0).alias("active"))


SYMBOLS_SQL = "SELECT s_suppkey::INT AS symbol_id, s_name AS symbol, n_name AS industry, s_acctbal >= 0 AS active FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_id, account_id, symbol_id, side, quantity, price, trade_ts, trade_date."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("trade_id"), (F.col("o_custkey") % 7).cast("int").alias("account_id"), (F.col("o_custkey") % 20 + 1).cast("int").alias("symbol_id"),
        F.when(key % 3 == 0, "SELL").otherwise("BUY").alias("side"), (1 + key % 40).alias("quantity"), rounded(F.col("o_totalprice") / 1000, 2).alias("price"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("trade_ts"), F.to_date("o_orderdate").alias("trade_date"),
    )


FILLS_SQL = """SELECT o_orderkey AS trade_id, (o_custkey % 7)::INT AS account_id, (o_custkey % 20 + 1)::INT AS symbol_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, 1 + o_orderkey % 40 AS quantity,
  round_even(o_totalprice/1000*100, 0)/100 AS price, o_orderdate AS trade_ts, o_orderdate::DATE AS trade_date FROM orders"""


def action_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_id, symbol_id, ex_date, subject: announcements as free text, of all kinds that occur."""
    n = F.col("p_partkey")
    kind = (n % 8).cast("int")
    size, price = F.col("p_size").cast("string"), F.format_string("%.2f", F.col("p_retailprice"))
    text = F.element_at(F.array(
        F.concat(F.lit("Interim Dividend - Rs "), size, F.lit(" Per Share")),
        F.concat(F.lit("Dividend - Re 1 Per Share Special Dividend - Rs "), size, F.lit(" Per Share")),
        F.concat(F.lit("Face Value Split (Sub-Division) - From Rs 10/- Per Share To Re 1/- Per Share")),
        F.concat(F.lit("Bonus "), size, F.lit(":1")),
        F.concat(F.lit("Rights 1:"), size, F.lit(" @ Premium Rs "), price, F.lit("/-")),
        F.lit("Demerger"),
        F.concat(F.lit("Distribution - Rs "), size, F.lit(".5 Per Unit Consisting Dividend Rs 2 Per Unit Interest Rs 2.28 Per Unit")),
        F.lit("Annual General Meeting"),
    ), kind + 1)
    return table(spark, sf_dir, "part").select(n.alias("part_id"), (n % 100 + 1).cast("int").alias("symbol_id"), F.date_add(F.lit("1995-01-01").cast("date"), (n * 37 % 1000).cast("int")).alias("ex_date"), text.alias("subject"))


SUBJECTS_SQL = """SELECT p_partkey AS part_id, (p_partkey % 100 + 1)::INT AS symbol_id, DATE '1995-01-01' + (p_partkey*37 % 1000)::INT AS ex_date,
  CASE p_partkey % 8 WHEN 0 THEN 'Interim Dividend - Rs ' || p_size || ' Per Share'
  WHEN 1 THEN 'Dividend - Re 1 Per Share Special Dividend - Rs ' || p_size || ' Per Share'
  WHEN 2 THEN 'Face Value Split (Sub-Division) - From Rs 10/- Per Share To Re 1/- Per Share' WHEN 3 THEN 'Bonus ' || p_size || ':1'
  WHEN 4 THEN 'Rights 1:' || p_size || ' @ Premium Rs ' || format('{:.2f}', p_retailprice) || '/-' WHEN 5 THEN 'Demerger'
  WHEN 6 THEN 'Distribution - Rs ' || p_size || '.5 Per Unit Consisting Dividend Rs 2 Per Unit Interest Rs 2.28 Per Unit'
  ELSE 'Annual General Meeting' END AS subject FROM part"""


def plain_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_id, symbol_id, ex_date, subject: some twenty announcements a symbol at any scale, of all kinds; splits halve, bonuses are one
    share for four, so products of factors are the same in any order and stay in range."""
    parts, n = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))  # one row
    kind = F.col("p_partkey") % 8
    text = F.when(kind == 2, "Face Value Split (Sub-Division) - From Rs 10/- Per Share To Rs 5/- Per Share").when(kind == 3, "Bonus 1:4").when(kind == 4, F.concat(F.lit("Rights 1:"), F.col("p_size").cast("string"), F.lit(" @ Premium Rs 10/-"))).when(kind == 5, "Demerger").when(kind == 7, "Annual General Meeting")
    dividend = F.concat(F.lit("Dividend - Rs "), F.col("p_size").cast("string"), F.lit(" Per Share"))
    return parts.crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("part_id"), (F.col("p_partkey") % F.col("n") + 1).cast("int").alias("symbol_id"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") * 37 % 1000).cast("int")).alias("ex_date"), F.coalesce(text, dividend).alias("subject"))


PLAIN_KINDS_SQL = """SELECT p_partkey AS part_id, (p_partkey % (SELECT count(*) FROM supplier) + 1)::INT AS symbol_id, DATE '1995-01-01' + (p_partkey*37 % 1000)::INT AS ex_date,
  CASE p_partkey % 8 WHEN 2 THEN 'split' WHEN 3 THEN 'bonus' WHEN 4 THEN 'rights' WHEN 5 THEN 'demerger' WHEN 7 THEN NULL ELSE 'dividend' END AS kind, CASE p_partkey % 8 WHEN 2 THEN 0.5 WHEN 3 THEN 0.8 END::DOUBLE AS f FROM part"""
