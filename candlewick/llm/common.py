"""What the corpus operators share: reading, tables in the shared folder, Arrow batches in bounded slices."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes of text that one step of a Python stage holds at once; one longer text is a step of its own.
SLICE = 4 << 20
#: The bytes of an Arrow batch that goes to a Python stage, instead of Spark's default; another size that is set stays.
BATCH = 8 << 20
ARROW_BYTES, ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
#: Words are runs of characters other than these.
BLANK = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset an own one, if all run in one
    process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="candlewick-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


_open: list[list[str]] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read again: cuts the lineage and survives lost executors.

    Within scratch() the table goes with the block, else at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/candlewick/{label}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose stored tables are removed at its end, whether it succeeds or not.  It yields keep(df, label), which stores a
    table that outlives the block: what the block returns must come from there."""
    _open.append([])

    def keep(df: DataFrame, label: str) -> DataFrame:
        mine = _open.pop()
        try:
            return stored(df, label)
        finally:
            _open.append(mine)

    try:
        yield keep
    finally:
        for path in _open.pop():
            _remove(spark, path)


def unstore(df: DataFrame) -> None:
    """Removes the files of a table from stored() that no later plan reads."""
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, file)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # at exit the JVM may be gone; the folder is the cluster's scratch space
        return


def small(df: DataFrame, most: int) -> DataFrame:
    """A stored table, marked for broadcast if it has at most `most` rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: A key is hot if more than one in HOT of all rows have it, so there are fewer than HOT hot keys.
HOT = 10_000


def hot_join(rows: DataFrame, side: DataFrame, on: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to a stored side with one row a key; `size` is a column of side (dropped) with how many rows have the key, at
    least, and `total` the number of rows.  Rows of a hot key are dealt by their hash to parts, and its row of side is copied to
    each, so that a task gets about total / HOT rows of a key at most.  The parts of the fewer than HOT hot keys are broadcast,
    and the copies are fewer than 2 * HOT."""
    parts = side.withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col(size) * HOT / max(total, 1))).cast("int")).drop(size)
    hot = parts.where("_parts > 1").select(*on, "_parts")
    dealt = rows.join(F.broadcast(hot), on, "left")
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), "_parts")).cast("int")
    copies = parts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.withColumn("_part", part).drop("_parts").join(copies, [*on, "_part"], how).drop("_part")


def wide_hash(*columns: str) -> Column:
    """A 128-bit hash as 16 bytes."""
    half = lambda *c: F.lpad(F.hex(F.xxhash64(*c)), 16, "0")
    return F.unhex(F.concat(half(*columns), half(F.lit(1), *columns)))


def row_key() -> Column:
    """Stands for a document in joins: equal for repeated rows only, whatever doc_id holds (128 bits)."""
    return wide_hash("doc_id", "text")


def fold(i: int) -> Column:
    """Whether the document is in remainder i of crc32(doc_id as text) modulo 5; a null doc_id is in none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == i, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut into consecutive pieces of at most `limit` bytes of the column; one larger value is alone."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        first = total = 0
        for i, n in enumerate(sizes):
            if i > first and total + n > limit:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n
        if first < len(sizes):
            yield batch.slice(first)


def map_slices(df: DataFrame, column: str, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with `step` called for slices bounded by the bytes of `column`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, column):
            out = step(piece)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as bytes; null is empty."""
    return [t or b"" for t in batch.column(column).to_pylist()]


def bounded(df: DataFrame) -> DataFrame:
    """The same rows, for a Python stage: its session sends them in batches of BATCH bytes, a longer row alone.  Each task holds some
    copies of a batch on either side, and 10,000 texts are 30 MB and more."""
    if df.sparkSession.conf.get(ARROW_BYTES).removesuffix("b") == str(ARROW_DEFAULT):
        df.sparkSession.conf.set(ARROW_BYTES, BATCH)
    return df


def as_bytes(docs: DataFrame, *more: Column | str) -> DataFrame:
    """doc_id, text as UTF-8 bytes, and more columns, for a Python stage."""
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)


def repeated(df: DataFrame, copies: str = "copies") -> DataFrame:
    """One row for each of the `copies` equal rows that a row stands for."""
    return df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).drop("_i", copies)
