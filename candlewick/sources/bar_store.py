"""Stored bars (S1, §1.4): a table by timeframe, bucketed by symbol and sorted by time.

All windows and grouped maps of the library work on a series.  Read from this table, a series lies in one bucket, so none of them
shuffles; a filter on timeframe reads its folders only.  A bucket is one file for each timeframe, as a writer deals rows to tasks by
the bucket's own hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.sources.tables import Files


def write(bars: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """Stores bars (symbol_id, timeframe, ts, ...) under path as the table `name`; returns the table.  A table of that name is made
    anew."""
    spark = bars.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    dealt = bars.repartition(buckets, "symbol_id")
    dealt.write.partitionBy("timeframe").bucketBy(buckets, "symbol_id").sortBy("symbol_id", "ts").option("path", path).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def attach(spark: SparkSession, name: str, path: str, schema: str, buckets: int = 64) -> DataFrame:
    """The table again in a session whose catalog does not know it.  schema: its columns with timeframe."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet PARTITIONED BY (timeframe) CLUSTERED BY (symbol_id) SORTED BY (symbol_id, ts) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def files_of(spark: SparkSession, path: str, timeframe: str) -> list[str]:
    return sorted(n for n in Files(spark, path).names(f"{path}/timeframe={timeframe}") if n.startswith("part-"))


def series(table: DataFrame, timeframe: str, since: str | None = None) -> DataFrame:
    """Bars of one timeframe, from a day on: folders are pruned by the first, row groups by the second."""
    rows = table.where(F.col("timeframe") == timeframe)
    return rows if since is None else rows.where(F.col("ts") >= F.lit(since).cast(dict(table.dtypes)["ts"]))
