"""Sources (S1-S19): files and landed API pages to typed DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick import schemas
from candlewick.sources.daily_files import by_name

# Series, column names and symbols that results depend on.
SERIES = ("EQ", "BE", "BZ")
#: Series that the panel keeps, by exchange.
PANEL_SERIES = {"NSE": ("EQ", "BE", "BZ", "SM", "ST"), "BSE": ("A", "B", "T", "M", "MT", "MS", "X", "XT")}
#: Columns of the daily file under the panel's names.
PANEL = {
    "TradDt": "date", "ISIN": "isin", "TckrSymb": "symbol", "SctySrs": "series", "FinInstrmNm": "name", "OpnPric": "open", "HghPric": "high", "LwPric": "low", "ClsPric": "close",
    "LastPric": "last", "PrvsClsgPric": "prev_close", "TtlTradgVol": "volume", "TtlTrfVal": "turnover", "TtlNbOfTxsExctd": "trades", "FinInstrmTp": "kind",
}
#: The symbols that stand in for the universe list if that is not there.
FALLBACK = ("RELIANCE", "TCS", "HDFCBANK", "INFY", "ICICIBANK", "HINDUNILVR", "ITC", "SBIN", "BHARTIARTL", "BAJFINANCE", "HINDZINC", "TATASTEEL")


def daily_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the series EQ, BE and BZ of official daily files (one path or a folder of days, zipped or not), with the columns
    of schemas.DAILY_FILE found by name; text that is no number or date is null."""
    kinds = dict(c.split() for c in schemas.DAILY_FILE.split(", "))
    rows = by_name(spark, path, list(kinds))
    return rows.select(*(F.expr(f"try_cast({c} as {kind})").alias(c) for c, kind in kinds.items())).where(F.col("SctySrs").isin(*SERIES))


def preferred_rows(rows: DataFrame) -> DataFrame:
    """One row a day and ticker: series EQ before BE before BZ."""
    rank = F.array_position(F.array(*map(F.lit, SERIES)), F.col("SctySrs"))
    best = Window.partitionBy("TradDt", "TckrSymb").orderBy(rank, "FinInstrmId")
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def panel(spark: SparkSession, path: str, exchange: str) -> DataFrame:
    """Stocks of an exchange's daily files (zipped or not, of any order of columns) as a panel; text that is no number is null; a
    file that is not the daily file gives no rows."""
    numbers = {"open", "high", "low", "close", "last", "prev_close", "turnover"}
    cast = lambda c, n: F.expr(f"try_cast({c} as {'date' if n == 'date' else 'double' if n in numbers else 'bigint' if n in ('volume', 'trades') else 'string'})")
    df = by_name(spark, path, list(PANEL)).select(*(cast(c, n).alias(n) for c, n in PANEL.items()))
    return df.where((F.col("kind") == "STK") & F.col("series").isin(*PANEL_SERIES[exchange])).withColumn("exchange", F.lit(exchange))


def published_before(manifest: DataFrame, start: Column, back: int = 10) -> DataFrame:
    """The last published day on or before start, at most `back` days back.  manifest: day, published."""
    near = manifest.where(F.col("published") & (F.col("day") <= start) & (F.col("day") > F.date_sub(start, back)))
    return near.agg(F.max("day").alias("day"))


def backfill_plan(spark: SparkSession, exchanges: list[str], end: str, days_back: int, cached: DataFrame, missing: DataFrame) -> DataFrame:
    """(exchange, day) to fetch: all days, weekends too, without those cached or known to be missing."""
    grid = spark.sql(f"SELECT explode(sequence(date_sub(DATE '{end}', {days_back}), DATE '{end}')) AS day").select(F.explode(F.array(*map(F.lit, exchanges))).alias("exchange"), "day")
    return grid.join(cached, ["exchange", "day"], "left_anti").join(missing, ["exchange", "day"], "left_anti")


def history_pages(pages: DataFrame, column: str = "body") -> DataFrame:
    """Bars of pages {"s": ..., "candles": [[epoch, o, h, l, c, v], ...]}; ts is exchange wall time, nth the order of arrival."""
    parsed = pages.select("symbol", F.from_json(column, "s string, candles array<array<double>>").alias("p"))
    rows = parsed.select("symbol", F.posexplode("p.candles").alias("nth", "c"))
    wall = F.from_utc_timestamp(F.timestamp_seconds(F.col("c")[0].cast("long")), "Asia/Kolkata").cast("timestamp_ntz")
    return rows.select("symbol", "nth", wall.alias("ts"), *(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)))


def chunks(df: DataFrame, first: str, last: str, days: int) -> DataFrame:
    """Adds lo and hi: consecutive ranges of at most `days` days that cover [first, last]."""
    starts = F.sequence(F.col(first), F.col(last), F.make_dt_interval(days=F.lit(days)))
    return df.withColumn("lo", F.explode(starts)).withColumn("lo", F.to_date("lo")).withColumn("hi", F.least(F.date_add("lo", days - 1), F.col(last)))


def universe(spark: SparkSession, path: str | None) -> DataFrame:
    """Symbol, name, industry, isin of a list with a header; without a list, the fallback symbols."""
    if path is None:
        return spark.createDataFrame([(s, None, None, None) for s in FALLBACK], "symbol string, name string, industry string, isin string")
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.trim("Symbol").alias("symbol"), F.trim("Company Name").alias("name"), F.trim("Industry").alias("industry"), F.trim("ISIN Code").alias("isin"))


def action_feed(spark: SparkSession, path: str) -> DataFrame:
    """Symbol, subject, ex_date and record_date (text) of a JSON feed, nth its order."""
    raw = spark.read.schema("symbol string, subject string, exDate string, recDate string").option("multiLine", True).json(path)
    return raw.select("symbol", "subject", F.col("exDate").alias("ex_date"), F.col("recDate").alias("record_date"), F.monotonically_increasing_id().alias("nth"))


def tradebook(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fills, rejects) of a tradebook whose columns are all text and that has `row` (order in the file).

    Columns may be named trade_date or date, side or trade_type; missing exchange, segment, product and time become NSE, CASH,
    CNC and 15:29.  A fill without an id gets one from a hash of its content and row."""
    raw = raw.select(*(F.col(c).alias(c.strip().lstrip("﻿").lower()) for c in raw.columns))

    def any_of(*names: str, default: str | None = None) -> Column:
        have = [F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in raw.columns]
        return F.coalesce(*have, F.lit(default).cast("string"))

    day = any_of("trade_date", "date")
    date = F.coalesce(F.to_date(F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(day, F.lit("dd-MM-yyyy"))))
    df = raw.select(
        "row", day.alias("day"), date.alias("trade_date"), F.upper(F.coalesce(any_of("symbol", "tradingsymbol"), any_of("isin"))).alias("symbol"), F.upper(any_of("side", "trade_type")).alias("side"), any_of("quantity").alias("q"),
        any_of("price").alias("p"), F.upper(any_of("isin")).alias("isin"), any_of("exchange", default="NSE").alias("exchange"), any_of("segment", default="CASH").alias("segment"),
        any_of("product", default="CNC").alias("product"), any_of("time", default="15:29").alias("time"), any_of("trade_id").alias("given"),
    )
    df = df.withColumns({"quantity": F.expr("cast(try_cast(q as double) as bigint)"), "price": F.expr("try_cast(p as double)")})
    made = F.concat(F.lit("csv:"), F.substring(F.sha1(F.concat_ws("|", F.col("trade_date").cast("string"), "symbol", "side", F.col("quantity").cast("string"), F.col("price").cast("string"), F.col("row").cast("string"))), 1, 16))
    error = F.when(F.col("trade_date").isNull(), "bad date").when(F.col("symbol").isNull(), "no symbol").when(~F.coalesce(F.col("side").isin("BUY", "SELL"), F.lit(False)), "bad side").when(F.col("quantity").isNull(), "bad quantity").when(F.col("price").isNull(), "bad price")
    df = df.withColumns({"trade_id": F.coalesce("given", made), "error": error})
    ts = F.try_to_timestamp(F.concat_ws(" ", F.col("trade_date").cast("string"), "time"), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    good = df.where("error is null").select("row", "trade_id", "trade_date", ts.alias("trade_ts"), "symbol", "isin", "side", "quantity", "price", "exchange", "segment", "product")
    return good, df.where("error is not null").select("row", "error")


def order_fills(orders: DataFrame, trades: DataFrame, day: Column) -> DataFrame:
    """The day's fills: filled orders of the products CNC and MTF with their executed trades.

    orders: order_id, symbol, product, side, filled_quantity, exchange, segment.  trades: order_id, nth, trade_id, exchange_trade_id,
    status, quantity, price, ts (text)."""
    good = orders.where((F.col("filled_quantity") > 0) & F.col("product").isin("CNC", "MTF"))
    done = trades.where(F.upper(F.coalesce("status", F.lit(""))).isin("EXECUTED", "")).withColumn("trade_ts", wall_time(F.col("ts"), day))
    named = F.coalesce("trade_id", "exchange_trade_id", F.concat("order_id", F.lit(":"), F.col("nth").cast("string")))
    return done.join(good.drop("quantity", "status"), "order_id").where(F.to_date("trade_ts") == day).withColumn("trade_id", named).drop("exchange_trade_id", "ts")


def wall_time(value: Column, day: Column) -> Column:
    """Exchange wall time of a text: ISO without a zone as it is, with a zone converted, epoch milliseconds from UTC; else the
    day at 15:29."""
    zone = "Asia/Kolkata"
    number = F.when(value.rlike(r"^\d{10,}(\.\d+)?$"), F.from_utc_timestamp(F.timestamp_millis(value.cast("double").cast("long")), zone))
    aware = F.when(value.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & value.contains(":"), F.from_utc_timestamp(F.try_to_timestamp(value), zone))
    naive = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.try_to_timestamp(value))
    fallback = F.make_timestamp_ntz(F.year(day), F.month(day), F.day(day), F.lit(15), F.lit(29), F.lit(0))
    return F.coalesce(number.cast("timestamp_ntz"), aware.cast("timestamp_ntz"), naive.cast("timestamp_ntz"), fallback)


def holdings(pages: DataFrame, as_of: Column) -> DataFrame:
    """Isin, symbol, quantity, average_price, t1_quantity of landed JSON pages, which hold the list under `holdings` or `data`."""
    item = "array<struct<isin:string,trading_symbol:string,quantity:double,average_price:double,t1_quantity:double,last_price:double>>"
    parsed = F.from_json("body", f"holdings {item}, data {item}, payload struct<holdings:{item}>")
    rows = pages.select(F.explode(F.coalesce(parsed["holdings"], parsed["payload"]["holdings"], parsed["data"])).alias("h"))
    return rows.select(as_of.alias("as_of"), "h.isin", F.col("h.trading_symbol").alias("symbol"), F.col("h.quantity").cast("long").alias("quantity"), F.col("h.average_price").alias("average_price"), F.coalesce(F.col("h.t1_quantity"), F.lit(0.0)).cast("long").alias("t1_quantity"), F.col("h.last_price").alias("last_price"))
