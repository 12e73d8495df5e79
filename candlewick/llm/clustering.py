"""Centroid clustering (operator 13): Lloyd's rounds on whole-number vectors with the equal-average equal-variance search.

Centroids stand in order of their component sums.  A vector looks first at the centroid whose sum is nearest to its own and goes
outward on both sides.  With S the sum and U the root of d * (sum of squares) - S**2,

    d * distance >= (Sx - Sc)**2 + (Ux - Uc)**2

so a side is left as soon as the first term alone exceeds the best distance, a centroid is passed over if both do, and only the
others are measured.  All of it is in whole numbers, U rounded down and the difference of two made smaller by one, so nothing is
rejected that could win or tie.  Rounds send centroids to the tasks (k of them) and sums back, one row a task, centroid and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import scratch, stored

ROWS = 4096  # vectors that a task assigns at once
LIMB = 60  # bits of a sum that go in one row
LONG = (1 << 63) - 1


def kept(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id, vec (array<double>) of the vectors with exactly dim components, none null or not finite."""
    vec = F.col("embedding").cast("array<double>")
    ok = (F.size(vec) == dim) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))


def plain(dim: int) -> int:
    """Components below this are computed in 64 bits, where all products then fit.  Others take Python's whole numbers."""
    return (1 << 30) // dim


def whole(flat: np.ndarray, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, one row a vector: int64 where all are small, else Python's numbers."""
    if not len(flat) or np.abs(flat).max() * scale < plain(dim):
        return np.floor(flat * scale).astype(np.int64).reshape(-1, dim)
    # beyond 2**53 a double is a whole number, so the product is made of whole numbers
    exact = [int(x) * scale if abs(x) >= 1 << 53 else int(np.floor(x * scale)) for x in flat.tolist()]
    return np.array(exact, object).reshape(-1, dim)


def root(x: np.ndarray) -> np.ndarray:
    """U rounded down, of each row."""
    if x.dtype == object:
        d = x.shape[1]
        return np.array([isqrt(d * sum(v * v for v in row) - sum(row) ** 2) for row in x.tolist()], object)
    spread = x.shape[1] * (x * x).sum(1) - x.sum(1) ** 2
    u = np.sqrt(spread.astype(np.float64)).astype(np.int64)
    u -= u * u > spread
    return u + ((u + 1) * (u + 1) <= spread)


def search(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (the smaller number at ties), the squared distance, and how many distances were measured."""
    if len(x) and object not in (x.dtype, centroids.dtype) and np.abs(centroids).max() >= plain(x.shape[1]):
        centroids = centroids.astype(object)
    if object in (x.dtype, centroids.dtype):
        x, centroids = x.astype(object), centroids.astype(object)
    d, k = x.shape[1], len(centroids)
    sums = centroids.sum(1)
    order = np.array(sorted(range(k), key=lambda c: (sums[c], c)))
    c, s, u = centroids[order], sums[order], root(centroids)[order]
    sx, ux = x.sum(1), root(x)
    at = np.searchsorted(s, sx)
    # the nearer of the two neighbours in the order of sums
    left = np.maximum(at - 1, 0)
    right = np.minimum(at, k - 1)
    start = np.where(abs(s[left] - sx) <= abs(s[right] - sx), left, right)
    best = ((x - c[start]) ** 2).sum(1)
    name = order[start]
    measured = len(x)
    for step in (-1, 1):
        rows, place = np.arange(len(x)), start + step
        while len(rows):
            inside = (place >= 0) & (place < k)
            rows, place = rows[inside], place[inside]
            gap = (s[place] - sx[rows]) ** 2
            near = (gap <= d * best[rows]).astype(bool)  # no centroid farther out on this side can be nearer
            rows, place, gap = rows[near], place[near], gap[near]
            spread = np.maximum(abs(u[place] - ux[rows]) - 1, 0)
            look = (gap + spread * spread <= d * best[rows]).astype(bool)
            r, p = rows[look], place[look]
            far = ((x[r] - c[p]) ** 2).sum(1)
            measured += len(r)
            wins = ((far < best[r]) | ((far == best[r]) & (order[p] < name[r]))).astype(bool)
            best[r[wins]], name[r[wins]] = far[wins], order[p[wins]]
            place = place + step
    return name, best, measured


def blocks(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part, whole(np.asarray(part.column("vec").flatten(), np.float64), dim, scale)


def centers(found: list[list[int]]) -> np.ndarray:
    small = all(abs(v) < plain(len(c)) for c in found for v in c)
    return np.array(found, np.int64 if small else object)


def first(vectors: DataFrame, dim: int, scale: int, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:vec_id`; equal ones by their components, a null vec_id last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "vec").limit(k).collect()
    return [whole(np.array(r.vec), dim, scale)[0].tolist() for r in rows]


def moved(vectors: DataFrame, found: list[list[int]], dim: int, scale: int) -> list[list[int]]:
    """The centroids after one round: the floor of the mean of their vectors; those without vectors stay."""
    now = centers(found)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [0] * len(now), [[0] * dim for _ in now]
        for _, x in blocks(batches, dim, scale):
            name = search(x, now)[0]
            for c in set(name.tolist()):
                mine = x[name == c]
                n[c] += len(mine)
                total[c] = [a + int(b) for a, b in zip(total[c], mine.sum(0), strict=True)]
        out = []
        for c, count in enumerate(n):
            if count:
                out.append((c, -1, 0, count))
                for i, value in enumerate(total[c]):
                    limb, sign = 0, -1 if value < 0 else 1
                    value = abs(value)
                    while value or not limb:
                        out.append((c, i, limb, sign * (value & ((1 << LIMB) - 1))))
                        value >>= LIMB
                        limb += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(col, pa.int64()) for col in zip(*out, strict=True)], ["c", "i", "limb", "v"])

    # at most k * (dim + 1) rows of each limb come back
    rows = vectors.mapInArrow(sums, "c long, i long, limb long, v long").groupBy("c", "i", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    total: dict[tuple[int, int], int] = {}
    for r in rows:
        total[r.c, r.i] = total.get((r.c, r.i), 0) + (int(r.v) << (LIMB * r.limb))
    return [[total[c, i] // total[c, -1] for i in range(dim)] if (c, -1) in total else old for c, old in enumerate(found)]


def assigned(vectors: DataFrame, found: list[list[int]], dim: int, scale: int) -> DataFrame:
    """vec_id, cluster, distance (null where it is no long) of kept vectors."""
    now = centers(found)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in blocks(batches, dim, scale):
            name, best, _ = search(x, now)
            far = [b if b <= LONG else None for b in map(int, best)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(name, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(nearest, "vec_id long, cluster int, distance long")


def sha(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clusters(vectors: DataFrame, dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, a row for each kept row of vectors (vec_id, embedding).

    Kept are vectors with exactly dim components, none null or not finite; each component x is floor(scale * x).  The k centroids
    start as the kept vectors with the smallest sha256 of `seed:vec_id` (as many as there are, if fewer; equal ids by their
    components; a null vec_id last).  Each round assigns all vectors and replaces centroids by the floor of their mean; empty ones
    stay; ties go to the smaller number.  Repeated rows each take part and get their row, other columns are ignored, an empty
    table gives an empty one.  Components may be as large as a double is; a distance or inertia that no long can hold is null.
    """
    rows = kept(vectors, dim)
    found = first(rows, dim, scale, k, seed)
    for _ in range(rounds if found else 0):
        found = moved(rows, found, dim, scale)
    if not found:
        return rows.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(None).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    with scratch(vectors.sparkSession) as keep:
        done = keep(assigned(rows, found, dim, scale), "clusters")
    whole_sum = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    each = {r.cluster: r.s for r in done.groupBy("cluster").agg(whole_sum.alias("s")).collect()}  # k rows at most
    every = None if None in each.values() else sum(each.values())
    long_ = lambda s: None if s is None or s > LONG else int(s)
    table = done.sparkSession.createDataFrame([(c, long_(s), long_(every), sha(found[c])) for c, s in each.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: str = "1") -> str:
    """The same by all distances: each round is a common table expression."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dim})""",
        "parts AS MATERIALIZED (SELECT r, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM kept)",
        f"""c0 AS MATERIALIZED (
  SELECT c, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS y
  FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c FROM kept) WHERE c < {k})""",
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (
  SELECT r, c, d FROM (SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS nth FROM (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM parts JOIN c{n} USING (i) GROUP BY r, c)) WHERE nth = 1)""")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c, i, coalesce(m, y) AS y FROM c{n} LEFT JOIN (
    SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN parts USING (r) GROUP BY c, i)) USING (c, i))""")
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN h USING (c)"""
