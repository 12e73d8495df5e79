"""Quantiles by narrowing against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.operators.quantiles import exact_quantile
from candlewick.sources.tables import kept


def values(kind, draw, n):
    if kind == "even":
        return [draw.random() for _ in range(n)]
    if kind == "outliers":
        return [draw.random() ** 9 * 1e300 * draw.choice([-1, 1]) for _ in range(n)]
    if kind == "ties":
        return [float(draw.choice([1, 2, 2, 2, 7])) for _ in range(n)]
    if kind == "halves":  # two values that meet at the middle rank
        return [1.0] * (n // 2) + [2.0] * (n - n // 2)
    if kind == "equal":
        return [3.0] * n
    return [float(i) for i in range(n)]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_equals_sorting(spark, q):
    draw = random.Random(int(q * 100))
    groups = {"even": 20_000, "outliers": 20_001, "ties": 15_000, "equal": 9_000, "halves": 8_000, "range": 12_001, "few": 3, "one": 1}
    rows = [(g, v) for g, n in groups.items() for v in values(g, draw, n)] + [("even", None), ("none", None), (None, 4.0), (None, 8.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    passes = []

    def keep(part, name):
        passes.append(name)
        return kept(part, name)

    got = {r.g: r.x for r in exact_quantile(df, ["g"], "v", q, keep, "x", limit=200).collect()}
    assert set(got) == {g for g, _ in rows} and got["none"] is None
    for g in got:
        mine = [v for k, v in rows if k == g and v is not None]
        if mine:
            assert got[g] == pytest.approx(np.quantile(mine, q), rel=1e-12), (g, q)
    assert 1 < len(passes) < 8


def test_one_group_and_empty(spark):
    df = spark.range(5001).select(F.col("id").alias("v"))
    assert exact_quantile(df, [], "v", 0.5, kept, limit=50).first()[0] == 2500.0
    assert exact_quantile(df.limit(0).withColumn("g", F.lit(1)), ["g"], "v", 0.5, kept).count() == 0
