"""Cells of near copies in the index of the nearest-neighbour search."""

import numpy as np
from pyspark.sql import functions as F

from candlewick.llm import ann


def test_pairs_come_once():
    owner, keys = ann.each_once(np.array([7, 7, 3]), np.array([[1, 2], [2, 9], [2, 1]]))
    assert sorted(zip(owner.tolist(), keys.tolist())) == [(3, 1), (3, 2), (7, 1), (7, 2), (7, 9)]


def test_near_copies_share_cells(spark):
    """Cells hold every vector once and CELL at most, and near copies are a fraction of the index that they would be one by one."""
    draw = np.random.default_rng(4)
    near = draw.normal(size=64) + 0.01 * draw.normal(size=(1000, 64))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([near, draw.normal(size=(500, 64))]))], "number long, vec array<double>")
    axes = ann.layout(1500, 64)
    cells = ann.in_cells(rows, lambda v: axes).cache()
    assert sorted(r.number for r in cells.collect()) == list(range(1500))
    assert cells.groupBy("cell").count().agg(F.max("count")).first()[0] <= ann.CELL
    index = ann.bucketed(cells.where("number < 1000").select(F.col("cell").alias("number"), "vec"), lambda v: ann.own_buckets(v, 128, axes))
    assert index.count() < 1000 * 128 / 4
