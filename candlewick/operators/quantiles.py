"""Exact quantiles of groups of any size (G9, G21), by narrowing instead of sorting or gathering.

A quantile sketch of bounded size gives, for each group, two values between which the wanted rank lies.  Rows below are counted, rows
between go on to the next pass, a few thousandths each time (of a value at either end that many rows share, two go on).  When no group has more than `limit` rows left, these
are ranked.  A group whose rows left are all equal is settled at once, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rank error of a sketch as a share of its rows, and how far around the rank the two values are taken.
ERROR = 1e-3
AROUND = 3 * ERROR
CARRIED = ("_low", "_high", "_part", "_skip")


def exact_quantile(df: DataFrame, keys: list[str], column: str, q: float, keep: Callable[[DataFrame, str], DataFrame], name: str = "quantile", limit: int = 100_000) -> DataFrame:
    """keys, name: the q-quantile of the non-null values of each group, between two ranks by linear interpolation; null for a group
    without values.  keep(df, name) stores the rows of each pass.  Null keys are a group."""
    every = df.select(*keys, F.col(column).cast("double").alias("_v"))
    rows = every.where("_v is not null")
    total = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    at = total.withColumn("_at", (F.col("_n") - 1) * F.lit(q)).select(*keys, F.floor("_at").alias("_low"), F.ceil("_at").alias("_high"), (F.col("_at") - F.floor("_at")).alias("_part"))
    same = lambda a, b: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] or [F.lit(True)]

    def met(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        out = a.alias("a").join(b.alias("b"), same(a, b), how)
        return out.select(*(F.col(f"a.{c}") for c in a.columns), *(F.col(f"b.{c}") for c in b.columns if c not in keys))

    # _skip: rows of the group below all that are left
    left = keep(met(rows, at).withColumn("_skip", F.lit(0).cast("long")), "quantile-rows")
    while True:
        most = left.groupBy(*keys).agg(F.count("*").alias("n"), (F.min("_v") < F.max("_v")).alias("open")).where("open").agg(F.max("n")).first()[0]
        if most is None or most <= limit:
            break
        left = keep(_narrowed(left, keys, met), "quantile-rows")
    order = Window.partitionBy(*keys).orderBy("_v")
    # of equal values left over, many as they may be, any one is both ranks
    shape = left.groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.count("*").alias("_left"))
    flat = shape.where("_a = _b").select(*keys, F.col("_a").alias(name))
    ranked = met(left, shape.where("_a < _b").select(*keys, "_left")).withColumn("_rank", F.row_number().over(order) - 1 + F.col("_skip"))
    # a rank beyond the rows left is that of a value equal to the first or last of them
    within = lambda c: F.least(F.greatest(F.col(c), F.col("_skip")), F.col("_skip") + F.col("_left") - 1)
    pick = lambda c: F.max(F.when(F.col("_rank") == within(c), F.col("_v")))
    ends = ranked.groupBy(*keys).agg(pick("_low").alias("_a"), pick("_high").alias("_b"), F.first("_part").alias("_p"))
    found = flat.unionByName(ends.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_p")).alias(name)))
    return met(every.select(*keys).distinct(), found, "left")


def _narrowed(left: DataFrame, keys: list[str], met: Callable[..., DataFrame]) -> DataFrame:
    """The rows that lie between the two values around the ranks."""
    share = lambda c: (F.first(c) - F.first("_skip")) / F.count("*")
    sketch = left.groupBy(*keys).agg(F.percentile_approx("_v", [i / 1000 for i in range(1001)], int(1 / ERROR)).alias("_s"), share("_low").alias("_l"), share("_high").alias("_h"))
    place = lambda c, by: F.least(F.lit(1000), F.greatest(F.lit(0), F.floor((F.col(c) + by) * 1000))).cast("int")
    # at the ends of the sketch the smallest and largest values themselves
    edges = sketch.select(*keys, F.when(F.col("_l") - AROUND <= 0, float("-inf")).otherwise(F.get("_s", place("_l", -AROUND))).alias("_from"), F.when(F.col("_h") + AROUND >= 1, float("inf")).otherwise(F.get("_s", place("_h", AROUND) + 1)).alias("_to"))
    edges = edges.withColumn("_to", F.coalesce("_to", F.lit(float("inf"))))
    marked = met(left, edges)
    lower, upper = F.col("_v") == F.col("_from"), (F.col("_v") == F.col("_to")) & (F.col("_to") > F.col("_from"))
    ends = marked.groupBy(*keys).agg(F.count_if(F.col("_v") < F.col("_from")).alias("_below"), F.count_if(lower).alias("_equal"), F.count_if(upper).alias("_top"), *(F.first(c).alias(c) for c in ("_from", "_to", *CARRIED)))
    # of values equal to an end, however many, two stay: the last ones of the lower, the first ones of the upper
    ends = ends.withColumn("_skip", F.col("_skip") + F.col("_below") + F.greatest(F.col("_equal") - 2, F.lit(0)))
    two = lambda v, n: ends.withColumn("_v", F.explode(F.array_repeat(F.col(v), F.least(F.col(n), F.lit(2)).cast("int")))).select(*keys, "_v", *CARRIED)
    inside = met(left.where("_v is not null").select(*keys, "_v"), ends).where("_v > _from and _v < _to").select(*keys, "_v", *CARRIED)
    return inside.unionByName(two("_from", "_equal")).unionByName(two("_to", "_top"))
