"""Approximate nearest neighbours (operator 9): cross-polytope hashing with multiprobe tables and exact reranking.

A table hashes a unit vector with a few axes.  An axis is a pseudo-rotation, three rounds of random signs and a fast Hadamard
transform; its code is the signed axis nearest to the rotated vector.  Every vector is in one bucket of each table; a query
looks in several buckets of each, those whose axes are nearest to it.

Vectors that share the bucket of the first table form cells (see in_cells): near copies meet in nearly all tables, and a cell
stands for its vectors in each bucket of one of them once.  The index is a table of (bucket, cell), the probes one of (bucket,
query number): their equi-join gives cells, each once a query, whose vectors are all reranked by exact distance, of which only
the best of a query stay.  Tables get more axes as vectors get more (see layout), so a bucket holds about as many vectors at any
size.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from candlewick.llm.bytehash import mix
from candlewick.llm.common import scratch, stored, wide_hash

ROWS = 256  # vectors that a task hashes at once
CELL = 128  # vectors of a cell, at most
LOAD = 40  # buckets of a table for each vector, at most
FLAT = 1 << 22  # components of query vectors that are broadcast at most (32 MB)


@functools.cache
def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths; the width is a power of 2.  Blocks of 64 are one
    small matrix product, which is quicker than six passes; the rest is butterflies."""
    n = x.shape[1]
    half = min(n, 64)
    x = (x.reshape(-1, half) @ _hadamard(half)).reshape(x.shape)
    while half < n:
        pairs = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), n)
        half *= 2
    return x / np.float32(np.sqrt(n))


@functools.cache
def signs(table: int, axis: int, width: int) -> np.ndarray:
    return np.random.default_rng((9, table, axis, width)).choice([-1.0, 1.0], (3, width)).astype(np.float32)


def width_of(dim: int) -> int:
    return 1 << max(1, dim - 1).bit_length()


def layout(n: int, width: int, most: int | None = None) -> tuple[int, ...]:
    """How many coordinates each axis of a table (`most` axes at most) looks at: all of them, and in the last axis so many that a
    table has at most LOAD * n buckets."""
    left, axes = max(LOAD * n, 2), []
    while left >= 2 and len(axes) != most:
        axes.append(min(width, 1 << ((left // 2).bit_length() - 1)))
        left //= 2 * axes[-1]
        if axes[-1] < width:
            break
    return tuple(axes)


def units(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length 1, filled up with zeros to a power of 2."""
    out = np.zeros((len(vectors), width_of(vectors.shape[1])))
    out[:, : vectors.shape[1]] = vectors / np.abs(vectors).max(1, keepdims=True)  # no overflow in the norm
    return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)


def rotated(unit: np.ndarray, table: int, axis: int, size: int) -> np.ndarray:
    y = unit
    for s in signs(table, axis, unit.shape[1]):
        y = hadamard(y * s)
    return y[:, :size]


def own_buckets(vectors: np.ndarray, tables: int, axes: tuple[int, ...]) -> np.ndarray:
    """The keys (rows x tables) of the bucket of each vector in each table."""
    unit, codes = units(vectors), np.zeros((len(vectors), tables), np.int64)
    every = np.arange(len(vectors))
    for t in range(tables):
        for a, size in enumerate(axes):
            y = rotated(unit, t, a, size)
            near = np.abs(y).argmax(1)
            codes[:, t] = codes[:, t] * (2 * size) + near + size * (y[every, near] < 0)
    return _keys(codes, np.arange(tables), vectors.shape[1], len(axes))


@functools.cache
def leading(n: int, m: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of places in two ascending lists whose sum can be among the `most` least: (i + 1) * (j + 1) pairs are no larger."""
    i, j = (x.ravel() for x in np.indices((n, m)))
    keep = (i + 1) * (j + 1) <= most
    return i[keep], j[keep]


def near_buckets(vectors: np.ndarray, tables: int, axes: tuple[int, ...], probes: int) -> np.ndarray:
    """The keys (rows x tables * probes) of the buckets nearest to each vector, of fewer if a table has no more."""
    unit, keys = units(vectors), []
    for t in range(tables):
        codes, costs = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
        for a, size in enumerate(axes):
            y = rotated(unit, t, a, size)
            ends = np.concatenate([y, -y], 1)  # signed axes: nearness is the coordinate
            near = np.argsort(-ends, axis=1, kind="stable")[:, :probes]
            value = np.take_along_axis(ends, near, 1)
            cost = (value[:, :1] - value) ** 2
            i, j = leading(codes.shape[1], near.shape[1], probes)
            sums = costs[:, i] + cost[:, j]
            best = np.argsort(sums, axis=1, kind="stable")[:, :probes]
            codes, costs = np.take_along_axis(codes[:, i] * (2 * size) + near[:, j], best, 1), np.take_along_axis(sums, best, 1)
        keys.append(_keys(codes, np.array([t]), vectors.shape[1], len(axes)))
    return np.concatenate(keys, 1)


def _keys(codes: np.ndarray, table: np.ndarray, dim: int, axes: int) -> np.ndarray:
    return mix(mix(codes.astype(np.uint64), dim) + table.astype(np.uint64), axes).view(np.int64)


def each_once(numbers: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a number and a key of its row, each once."""
    flat, owner = keys.ravel(), np.repeat(numbers, keys.shape[1])
    if len(np.unique(numbers)) < len(numbers):
        order = np.lexsort((flat, owner))
        flat, owner = flat[order], owner[order]
        new = np.append(True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1]))
        flat, owner = flat[new], owner[new]
    return owner, flat


def bucketed(rows: DataFrame, buckets: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """number, bucket: for each row (number, vec) the keys that `buckets` gives for a matrix of vectors of one length.  Neighbouring
    rows of one number give a bucket once."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                numbers, vectors = batch.column("number").to_numpy(), batch.column("vec").to_pylist()
                places: dict[int, list[int]] = {}
                for i, v in enumerate(vectors):
                    places.setdefault(len(v), []).append(i)
                for some in places.values():
                    keys = buckets(np.array([vectors[i] for i in some], float))
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, each_once(numbers[some], keys))), ["number", "bucket"])

    return rows.select("number", "vec").mapInArrow(run, "number long, bucket long")


def in_cells(rows: DataFrame, axes_of: Callable[[np.ndarray], tuple[int, ...]], most: int = CELL) -> DataFrame:
    """rows (number, vec, ...) with `cell`: the number of a row with the same length and bucket in the first table, `most` rows a cell
    at most.  Sorted by cell in each task; store them, as cells depend on how rows are dealt."""
    columns = rows.columns

    def run(batches):
        last, cell, left = None, 0, 0
        for batch in batches:
            cells = []
            for bucket, number in zip(batch.column("_first").to_pylist(), batch.column("number").to_pylist(), strict=True):
                if bucket != last or not left:
                    last, cell, left = bucket, number, most
                left -= 1
                cells.append(cell)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(cells, pa.int64())], [*columns, "cell"])

    first = bucketed(rows, lambda v: own_buckets(v, 1, axes_of(v))).withColumnRenamed("bucket", "_first")
    dealt = rows.join(first, "number").select(*columns, "_first").repartitionByRange("_first", "number").sortWithinPartitions("_first", "number")
    return dealt.mapInArrow(run, StructType([*rows.schema, StructField("cell", LongType())]))


def distance(a: str, b: str):
    """Euclidean, in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def searched(entries: DataFrame, queries: DataFrame, k: int, tables: int, axes: int | None, probes: int, total: int, drop: int) -> DataFrame:
    """query, number, n_ids, score: the best k entries (number, vec, n_ids, least, cell) found for each query (number, vec), with the
    last `drop` axes left out; the only axis of a table is searched whole."""

    def axes_of(vectors: np.ndarray) -> tuple[int, ...]:
        full = layout(total, width_of(vectors.shape[1]), axes)
        return full[: max(1, len(full) - drop)]

    def asked(vectors: np.ndarray) -> np.ndarray:
        sizes = axes_of(vectors)
        return near_buckets(vectors, tables, sizes, probes if len(sizes) > 1 else 2 * sizes[0])

    cells = entries.select(F.col("cell").alias("number"), "vec")
    index = bucketed(cells, lambda v: own_buckets(v, tables, axes_of(v))).withColumnRenamed("number", "cell")
    looked = bucketed(queries, asked).withColumnRenamed("number", "query")
    # Spark has no estimate of the probes' size and would broadcast them
    pairs = looked.hint("merge").join(index, "bucket").select("query", "cell").distinct()
    vectors = queries.select(F.col("number").alias("query"), F.col("vec").alias("asked"))
    held = queries.agg(F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()[0]
    scored = pairs.join(entries, "cell").join(F.broadcast(vectors) if held <= FLAT else vectors, "query")
    scored = scored.select("query", "number", "n_ids", "least", distance("vec", "asked").alias("score"))
    near = Window.partitionBy("query").orderBy("score", "least")
    return scored.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= k).select("query", "number", "n_ids", "score")


def nearest(rows: DataFrame, k: int = 10, every: int = 100, tables: int = 128, axes: int | None = None, probes: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose vec_id is divisible by `every`.

    rows: vec_id, embedding (array of numbers).  axes: how many a table has at most (default: as many as the rows ask for).  Null vec_ids and vectors that are null, empty, zero or hold null or
    non-finite numbers take no part; exact repeats of a row count once.  Rows that share a vec_id with different vectors are
    searched each, and their answers share the ranks of that vec_id.  Vectors of different lengths are not compared.  Equal
    distances go to the smaller vec_id.  Other columns are ignored.

    Buckets see directions only: norms that differ much among near directions cost recall (README has figures).

    Equal vectors are one entry of the index with their k + 1 smallest ids, the only ones that can be among the nearest of
    anything.  A query for which the tables hold fewer than k rows is searched again with one axis less, at last with one
    axis and all of its buckets, that is among all vectors of its length.
    """
    vec = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    sound = "vec_id is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)"
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where("vec is not null").where(sound).withColumn("vkey", wide_hash("vec"))
    with scratch(rows.sparkSession) as keep:
        ids = good.groupBy("vkey", "vec_id").agg(F.first("vec").alias("vec"))
        # a top-k filter on a window: Spark keeps k + 1 rows a vector in each task before it shuffles
        first = ids.withColumn("nth", F.row_number().over(Window.partitionBy("vkey").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
        grouped = first.groupBy("vkey").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
        grouped = grouped.withColumns({"number": F.monotonically_increasing_id(), "least": F.col("ids")[0], "n_ids": F.size("ids")})
        table = stored(grouped, "vectors")
        total = table.count()
        entries = stored(in_cells(table.select("number", "vec", "least", "n_ids"), lambda v: layout(total, width_of(v.shape[1]), axes)), "cells")
        asking = stored(ids.where(F.col("vec_id") % every == 0).select("vec_id", "vkey").join(table.select("vkey", "number"), "vkey").select(F.col("vec_id").alias("query_id"), F.col("number").alias("query")), "queries")
        open_ = stored(entries.join(asking.select(F.col("query").alias("number")).distinct(), "number", "left_semi").select("number", "vec"), "asked")
        found = None
        for drop in itertools.count():
            got = stored(searched(entries, open_, k + 1, tables, axes, probes, total, drop), "found")
            full = got.groupBy("query").agg(F.sum("n_ids").alias("n")).where(F.col("n") > k).select(F.col("query").alias("number"))
            last = drop >= most_axes(open_, total, axes) - 1
            done = got if last else got.join(full.withColumnRenamed("number", "query"), "query", "left_semi")
            found = done if found is None else found.union(done)
            if last:
                break
            open_ = stored(open_.join(full, "number", "left_anti"), "asked")
            if open_.isEmpty():
                break
        named = found.join(table.select("number", F.explode("ids").alias("vec_id")), "number").select("query", "vec_id", "score")
        answers = asking.join(named, "query").where("query_id <> vec_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return keep(answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")


def most_axes(queries: DataFrame, total: int, axes: int | None) -> int:
    """The most axes that a table has for vectors of a length that is asked for: short vectors have the most."""
    least = queries.agg(F.min(F.size("vec"))).first()[0]
    return 1 if least is None else len(layout(total, width_of(least), axes))
