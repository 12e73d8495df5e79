"""Official daily files (S4, S6, S7, S9): CSV files and zipped ones, whose columns are found by name in each file.

Lines of plain files are Spark's text source; zip archives are read as binary files and unpacked member by member, where the size of
a read partition bounds what a task holds.  The header line of a file gives the place of each column, so files of several layouts
make one table.  A file without a header line (an error page, a broken archive) gives no rows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 64  # columns of a file that are looked at
SLICE = 1 << 20  # characters of lines that leave Python at once
MARK = "TradDt"  # a header line has this column


def unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, value): the lines of all members of the archives in (path, content); the member's name follows the path."""
    names: list[str] = []
    lines: list[str] = []
    size = 0
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            try:
                archive = zipfile.ZipFile(io.BytesIO(content.as_py()))
            except zipfile.BadZipFile:
                continue
            for member in archive.infolist():
                if member.is_dir():
                    continue
                with archive.open(member) as raw:
                    for line in io.TextIOWrapper(raw, "utf-8", "replace"):
                        names.append(f"{path}!{member.filename}")
                        lines.append(line.rstrip("\r\n"))
                        size += len(line)
                        if size >= SLICE:
                            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(lines)], ["file", "value"])
                            names, lines, size = [], [], 0
    if lines:
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(lines)], ["file", "value"])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, value: each line of the files of a path (a file, a folder, a pattern), archives unpacked."""
    plain = spark.read.option("pathGlobFilter", "*[!pP]").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").load(path).select("path", "content")
    return plain.unionByName(packed.mapInArrow(unzipped, "file string, value string"))


def fields(value: str) -> Column:
    """The fields of a line of comma-separated values as an array, quotes taken off; null beyond the last.

    Two things would make a line dear: a field taken from from_csv() itself is parsed alone, so that the line is parsed WIDTH times (the
    lambda takes all from one result), and a line of fewer fields raises within from_csv (so it is filled up, where its quotes close)."""
    line, schema = F.col(value), ", ".join(f"c{i} string" for i in range(WIDTH))
    bare = F.regexp_replace(line, '"[^"]*"', "")
    missing = WIDTH - 1 - (F.length(bare) - F.length(F.replace(bare, F.lit(","))))
    plain = ~F.contains(bare, F.lit('"')) & ~F.contains(line, F.lit("\\"))
    parsed = F.from_csv(F.when(plain, F.concat(line, F.repeat(F.lit(","), missing))).otherwise(line), schema)
    return F.transform(F.array(parsed), lambda row: F.array(*(row[f"c{i}"] for i in range(WIDTH))))[0]


def by_name(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """file and the named columns as text (null where a file has no such column), for each data line of the files."""
    every = lines(spark, path).withColumn("value", F.regexp_replace("value", "﻿", "")).where(F.trim("value") != "")
    is_header = F.col("value").rlike(rf'(^|,)\s*"?{MARK}"?\s*(,|$)')
    heads = every.where(is_header).groupBy("file").agg(F.min("value").alias("head")).withColumn("head", F.transform(fields("head"), F.trim))
    places = heads.select("file", *(F.array_position("head", c).alias(f"_{i}") for i, c in enumerate(columns)))  # a row a file
    rows = every.where(~is_header).withColumn("_f", fields("value")).join(places, "file")
    return rows.select("file", *(F.trim(F.when(F.col(f"_{i}") > 0, F.get("_f", (F.col(f"_{i}") - 1).cast("int")))).alias(c) for i, c in enumerate(columns)))
