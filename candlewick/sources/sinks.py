"""Sinks (S20-S25): merges by key, regeneration, and files.  Each merge returns the new table; write() puts it in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.sources import tables


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows win over old ones with their key.  One shuffle by the key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def upsert_columns(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of rows that are there, only `columns` are replaced; new rows come whole."""
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")

    def pick(c: str):
        if c in keys:
            return F.coalesce(f"a.{c}", f"b.{c}")
        return F.when(F.col("_new") if c in columns else F.col("_old").isNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))

    return both.select(*(pick(c).alias(c) for c in old.columns))


def rebuild(old: DataFrame, fresh: DataFrame, required: tuple[str, ...] = ("1d", "1h")) -> DataFrame:
    """A symbol's rows are replaced by fresh ones if those have all required timeframes; else the old ones stay."""
    have = fresh.groupBy("symbol_id").agg(F.collect_set("timeframe").alias("t")).where(" and ".join(f"array_contains(t, '{t}')" for t in required)).select("symbol_id")
    return old.join(have, "symbol_id", "left_anti").unionByName(fresh.join(have, "symbol_id", "left_semi").select(*old.columns))


def write(df: DataFrame, path: str, partitions: tuple[str, ...] = (), form: str = "parquet") -> None:
    """Replaces the partitions that df has (all of it, without partitions); df may be made from the table itself."""
    tables.replace(df, path, partitions, form)


def write_csv_by_exchange(panel: DataFrame, path: str) -> None:
    """CSV files in a folder for each exchange, written beside the old ones and then put in their place."""
    tables.replace(panel, path, ("exchange",), "csv")


def write_latest_csv(panel: DataFrame, path: str) -> None:
    """All exchanges in one folder, and the rows of the last date of each exchange in another."""
    last = panel.groupBy("exchange").agg(F.max("date").alias("date"))
    tables.replace(panel.join(last, ["exchange", "date"], "left_semi").select(*panel.columns), f"{path}/latest", (), "csv")
    tables.replace(panel, f"{path}/combined", (), "csv")


def with_isins(symbols: DataFrame, fills: DataFrame) -> DataFrame:
    """Symbols with the ISIN that their newest fill names, if any."""
    said = fills.where("isin is not null and symbol_id is not null").groupBy("symbol_id").agg(F.max_by("isin", "trade_ts").alias("_isin"))
    return symbols.join(said, "symbol_id", "left").withColumn("isin", F.coalesce("_isin", "isin")).drop("_isin")


def map_symbols(fills: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fills with symbol_id, symbols to create): by ISIN first, then by ticker; what neither knows is to be created."""
    by_isin = symbols.where("isin is not null").groupBy("isin").agg(F.min("symbol_id").alias("_i"))
    by_name = symbols.select("symbol", F.col("symbol_id").alias("_t"))
    df = fills.join(by_isin, "isin", "left").join(by_name, "symbol", "left").withColumn("symbol_id", F.coalesce("_i", "_t")).drop("_i", "_t")
    new = df.where("symbol_id is null").groupBy("symbol").agg(F.max("isin").alias("isin"))
    return df, new
