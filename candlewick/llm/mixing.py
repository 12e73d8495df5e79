"""Mixing sources to target weights (operator 8): a low-discrepancy schedule over shuffled equal-token blocks.

* Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words; no source may give
  more than twice its size, and what is cut off is shared again by weight.  The result has a closed form: with sources
  in the order of (cap / weight) a first stretch is capped and the others get weight times one common level.
* Blocks: a source's documents are shuffled by hash and laid end to end; block b holds its words from b * block on.
* Schedule: each source owns an interval of slots as wide as the blocks it needs.  The golden-ratio sequence, in whole numbers
  modulo 2**64 so that it stays even at any length, maps each slot number to a point, the point to the source whose interval holds it, and the slot's rank within the source to the
  next block, starting over at the end.  Intervals are hit evenly, so any stretch of the schedule has the mix's weights.
  Three points for each block suffice (any gap between n golden-ratio points is below 2/n); the surplus is dropped.  That
  every source got all its blocks is checked before the schedule is used.

Running sums never sort a whole source in one task: rows are cut to cells, cells are summed first.  Only the windows that
set targets run in one task; they have a row for each source.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.common import as_bytes, hot_join, map_slices, repeated, row_key, scratch, stored, texts_of

GOLDEN = 0x9E3779B97F4A7C15  # 2**64 divided by the golden ratio, an odd number


def sizes(docs: DataFrame, key: Column) -> DataFrame:
    """doc_id, source, key, size (words) for each row."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [len(t.split()) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "key")), pa.array(n, pa.int64())], ["doc_id", "source", "key", "size"])

    return map_slices(as_bytes(docs, F.col("source").cast("string").alias("source"), key.alias("key")), "text", step, "doc_id long, source string, key binary, size long")


def targets(totals: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """source, nth, source_size, target; totals has a row for each source with its size."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    named = totals.withColumn("nth", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("double")
    named = named.withColumn("w", weight).withColumn("cap", (most * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "nth")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rest = F.sum("source_size").over(whole) * percent / 100.0 - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = named.withColumn("level", rest / open_weight).withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    # the level of the first source that is not capped holds for all after it
    common = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("cap") / F.col("w"))).over(whole)
    target = F.least(F.col("cap"), F.coalesce(common * F.col("w"), F.col("cap")))
    return levels.select("source", "nth", "source_size", target.alias("target"))


def running(df: DataFrame, key: str, cell: str, order: list[str], amount: Column, name: str) -> DataFrame:
    """Adds the sum of `amount` over the rows of the same key before this one, in the order (cell, *order)."""
    df = df.withColumn("_amount", amount)
    cells = df.groupBy(key, cell).agg(F.sum("_amount").alias("_total"))
    ahead = Window.partitionBy(key).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_total").over(ahead), F.lit(0))).drop("_total")
    inside = Window.partitionBy(key, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    return df.join(cells, [key, cell]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_amount", "_inside", "_before")


def schedule(goals: DataFrame, block: int) -> DataFrame:
    """slot, nth (the source), rank (from 0), block, first, words: which block each slot takes, and how many of its words.

    goals: nth, source_size, target.  Slots are in the order in which a reader takes them.
    """
    want = F.round("target").cast("long")
    per_pass = F.ceil(F.col("source_size") / block)
    goals = goals.where("source_size > 0").withColumn("want", want).withColumn("blocks", per_pass)
    whole = F.floor(F.col("want") / F.col("source_size"))
    goals = goals.withColumn("need", whole * F.col("blocks") + F.ceil((F.col("want") - whole * F.col("source_size")) / block)).where("need > 0")
    up_to = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    goals = goals.withColumn("low", F.coalesce(F.sum("need").over(up_to), F.lit(0)))
    total = goals.agg(F.sum("need")).first()[0] or 0
    spark = goals.sparkSession
    wide = max(1, -(-total // 1024))
    grid = goals.withColumn("grid", F.explode(F.sequence(F.floor(F.col("low") / wide), F.floor((F.col("low") + F.col("need") - 1) / wide))))
    # products stay below 2**126, which decimals of 38 digits hold
    golden, whole_turn = (F.lit(str(x)).cast("decimal(20,0)") for x in (GOLDEN, 1 << 64))
    turn = (F.col("id").cast("decimal(18,0)") * golden) % whole_turn
    point = F.floor(turn.cast("decimal(20,0)") * F.lit(total).cast("decimal(18,0)") / whole_turn).cast("long")
    slots = spark.range(3 * total).select(F.col("id").alias("slot"), point.alias("point")).withColumn("grid", F.floor(F.col("point") / wide))
    hit = slots.join(grid, "grid").where("point >= low and point < low + need").withColumn("part", F.floor(F.col("slot") / 65536))
    ranked = running(hit.drop("grid"), "nth", "part", ["slot"], F.lit(1), "rank").where("rank < need")
    done = F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size")
    ranked = ranked.withColumn("block", F.col("rank") % F.col("blocks")).withColumn("first", F.col("block") * block)
    length = F.least(F.lit(block), F.col("source_size") - F.col("first"), F.col("want") - done - F.col("first"))
    return ranked.select("slot", "nth", "rank", "block", "first", length.alias("words"))


def mix(docs: DataFrame, block: int = 2048, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, a row for each row of docs.

    size is the number of words (null text: 0).  Null is a source of its own, the last.  A source without words has target
    0.  taken is the number of words that the schedule reads from the document, repeats counted; each source's sum is
    its target rounded, and no document gives more than `most` times its size.  The shuffle is a hash of doc_id, so
    reruns agree; rows with one doc_id and size are interchangeable.  Other columns are ignored.
    """
    with scratch(docs.sparkSession) as keep:
        each = _mix(docs, F.when(F.col("doc_id").isNull(), row_key()), block, weights, percent, most)
        return keep(repeated(each).select("doc_id", "source", "size", "source_size", "target", "taken"), "mix")


def _mix(docs: DataFrame, key: Column, block: int, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """taken and how many `copies` have it, for rows of one doc_id, source, size and key.  Rows without a doc_id spread by key."""
    rows = stored(sizes(docs, key), "sizes")
    goals = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, most), "targets")
    order = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(8), F.col("key"))).otherwise(F.xxhash64(F.lit(8), F.col("doc_id")))
    named = rows.join(goals, rows.source.eqNullSafe(goals.source)).drop(goals.source)
    named = named.withColumn("order", order).withColumn("cell", F.shiftrightunsigned("order", 52))
    laid = running(named, "nth", "cell", ["order", "doc_id", "size", "key"], F.col("size"), "start")
    number = F.when(F.col("size") == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    pieces = laid.select("doc_id", "key", "source", "size", "source_size", "target", "nth", "start", F.posexplode(number).alias("piece", "block"))
    low = F.greatest(F.col("start"), F.col("block") * block) - F.col("block") * block
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("block") * block
    # a block is read whole any number of times, and once in part at the schedule's end
    reads = stored(schedule(goals, block).groupBy("nth", "block", "words").agg(F.count("*").alias("times")), "reads")
    given = reads.groupBy("nth").agg(F.sum(F.col("words") * F.col("times")).alias("given"))
    if not goals.where("source_size > 0").join(given, "nth", "left").where(F.round("target").cast("long") != F.coalesce("given", F.lit(0))).isEmpty():
        raise RuntimeError("the schedule does not give every source its words")
    reads = reads.groupBy("nth", "block").agg(F.collect_list(F.struct("words", "times")).alias("reads"))
    joined = pieces.withColumn("low", low).withColumn("high", high).join(reads, ["nth", "block"], "left")
    taken = F.expr("aggregate(coalesce(reads, array()), 0L, (s, r) -> s + r.times * greatest(0L, least(r.words, high) - low))")
    each = joined.withColumn("got", F.when(F.col("size") > 0, taken).otherwise(0)).groupBy("doc_id", "key", "source", "size", "source_size", "target", "start")
    return each.agg(F.sum("got").alias("taken"), F.sum((F.col("piece") == 0).cast("int")).alias("copies"))


def mixed(docs: DataFrame, block: int = 2048, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """The rows of docs, each as often as the mix takes it: taken / size rounded half up, so 0, 1 or 2 times.  Documents
    without words go.  Rows are told apart by doc_id and text, so rows that share a doc_id come as often as each is taken; rows
    equal in both are interchangeable, and come as often as they are taken together.  Columns of docs may have any names."""
    times = F.floor(F.col("taken") / F.col("size") + 0.5) * F.col("copies")
    with scratch(docs.sparkSession) as keep:
        each = _mix(docs, row_key(), block, weights, percent, most).where("size > 0")
        of = each.groupBy("key").agg(F.sum(times).cast("long").alias("total"), F.sum("copies").cast("long").alias("rows"))
        split = {"all": F.floor(F.col("total") / F.col("rows")).cast("int"), "more": (F.col("total") % F.col("rows")).cast("int")}
        of = keep(of.where("total > 0").withColumns(split).select("key", "rows", "all", "more"), "times")
    n = of.agg(F.sum("rows")).first()[0] or 0
    kept = hot_join(docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("key")), of, ["key"], "rows", n)
    every = kept.where("all > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("all"))))
    # equal rows that are taken a number of times they do not divide: the rest are copies of one
    rest = kept.where("more > 0").dropDuplicates(["key"]).select("row", F.explode(F.sequence(F.lit(1), F.col("more"))))
    return every.union(rest).select(*(F.col("row")[c].alias(c) for c in docs.columns))
