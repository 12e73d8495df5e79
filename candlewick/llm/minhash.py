"""MinHash near-duplicates (operator 5): one-permutation hashing with optimal densification, bands, star-shaped candidates.

1. Each text becomes its set of hashed 5-word shingles.  The hash range is cut into bins; a bin's value is the smallest hash
   in it (one permutation).  An empty bin takes the value of the first filled bin in an order that is drawn for it once and
   is the same for all texts (optimal densification).
2. Texts with equal sets are one class from here on; only its smallest doc_id goes on.
3. Bins are grouped to bands; texts with an equal band share a bucket.  Each bucket links its members to one of them (a star: as
   many candidates as members), the one whose buckets are fullest, as the original of many near copies is; full sets
   confirm each candidate.  Components follow from confirmed links.
4. A star can miss a link between two members that both differ from that one.  Such a link matters only if the two
   are in different components by now, so the texts of buckets that still hold several components are compared by their
   rarest shingles: two sets of similarity t share one of the rarest |x| - ceil(t |x|) + 1 shingles of each.  That is
   exact, and texts that share only what is common to many do not meet.

Two texts at the threshold 0.80 have no equal band among 40 bands of 5 bins with probability (1 - 0.8^5)^40 = 1.3e-7; closer
texts far less.  At 0.85, 32 bands miss one with probability 7e-9.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.bytehash import batch_word_hashes, mix
from candlewick.llm.common import as_bytes, hot_join, map_slices, scratch, small, stored, texts_of
from candlewick.llm.components import components

IDS = 1_000_000  # ids of 8 bytes that are broadcast at most
SHARE = 1000  # pairs of one hub that a task confirms, about
MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The distinct shingles of a text given by its word hashes, sorted; a shorter text is one shingle, none has none."""
    n = len(words)
    if not n:
        return words
    take = min(n, size)
    total = np.full(n - take + 1, take, np.uint64)
    for i in range(take):
        total += mix(words[i : n - take + 1 + i]) * MULTIPLIERS[i]
    return np.unique(mix(total, take))


@functools.cache
def orders(bins: int) -> np.ndarray:
    """For each bin, the order in which it looks for a filled bin."""
    draw = np.random.default_rng(85)
    return np.stack([draw.permutation(bins) for _ in range(bins)])


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of a text's sorted shingle hashes."""
    bins = bands * rows
    at = np.searchsorted(hashes, _edges(bins))
    filled = at < np.append(at[1:], len(hashes))
    value = np.zeros(bins, np.uint64)
    value[filled] = hashes[at[filled]]
    if not filled.all():
        empty = np.flatnonzero(~filled)
        order = orders(bins)[empty]
        value[empty] = value[order[np.arange(len(empty)), filled[order].argmax(1)]]
    mixed = mix(value.reshape(bands, rows)) * MULTIPLIERS[:rows]
    return mix(mixed.sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * MULTIPLIERS[rows])


@functools.cache
def _edges(bins: int) -> np.ndarray:
    return np.array([(i << 64) // bins for i in range(bins)], np.uint64)


def sketches(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """doc_id, n_shingles, set_hi and set_lo (128-bit hash of the set), bands."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, hi, lo, keys = [], [], [], []
        for words in batch_word_hashes(texts_of(batch)):
            found = shingles(words, size)
            digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
            n.append(len(found))
            hi.append(digest[0])
            lo.append(digest[1])
            keys.append(band_keys(found, bands, rows).view(np.int64) if len(found) else np.empty(0, np.int64))
        flat = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)]), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), flat.cast(pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_hi", "set_lo", "bands"])

    return map_slices(as_bytes(docs), "text", step, "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and its shingles."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(w, size).view(np.int64) for w in batch_word_hashes(texts_of(batch))]
        flat = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]), pa.array(np.concatenate(sets)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), flat.cast(pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return map_slices(as_bytes(docs), "text", step, "doc_id long, shingles array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """The shingle sets of the documents with these ids (a stored table), stored: only their texts are cut again."""
    return stored(shingle_sets(docs.select("doc_id", "text").join(small(ids, IDS), "doc_id", "left_semi"), size), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a stored table whose full shingle sets reach the threshold.  b is the hub where there is one: its set
    is copied once for each SHARE of its pairs and meets their sets there, so neither a task nor a pair has it many times."""
    degrees = stored(pairs.groupBy("b").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / SHARE)), "degrees")
    total = degrees.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = hot_join(pairs, degrees, ["b"], "n", total).withColumn("salt", F.pmod(F.xxhash64("a"), "salts")).drop("salts")
    hubs = degrees.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    met = dealt.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(hubs, ["b", "salt"])
    return met.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def alike(x: str, y: str, percent: int) -> Column:
    """Whether sizes alone allow the similarity."""
    return F.expr(f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})")


def across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (rep, component) of different components that can reach the threshold: those that share one of
    their rarest shingles.  A shingle that one member has matches nothing, so it only shortens what is left to look at."""
    tokens = sets.join(members, sets.doc_id == members.rep).select("rep", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("component").alias("main"), F.max("component").alias("other")).where("df > 1")
    rows = tokens.join(common, "token")
    mine = Window.partitionBy("rep")
    rows = rows.withColumns({"nth": F.row_number().over(mine.orderBy("df", "token")), "shared": F.count("*").over(mine)})
    look = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1 - (F.col("n") - F.col("shared"))
    rare = rows.where(F.col("nth") <= look).where("main < other").select("token", "rep", "n", "component", "main", (F.col("n") - F.col("shared") + F.col("nth")).alias("place"))
    one, two = rare.where("component <> main").alias("x"), rare.alias("y")
    met = one.join(two, F.col("x.token") == F.col("y.token")).where("x.component <> y.component and (y.component = y.main or x.rep < y.rep)").where(alike("x.n", "y.n", percent))
    # at the first common shingle, all that can be common is it and what follows in both
    most = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    met = met.where((100 + percent) * most >= percent * (F.col("x.n") + F.col("y.n")))
    return met.select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, bands: int = 40, rows: int = 5, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    Texts are linked if 100 * |intersection| >= percent * |union| of their shingle sets.  A null, empty or blank text has
    an empty set and no links.  A row without a doc_id takes no part: its component is null and it is kept.  Repeated
    rows each get their row, with the same result; rows that share a doc_id are one document, linked through any of its
    texts.  Other columns are ignored.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_near_duplicates(docs, percent, bands, rows, size), "near-duplicates")


def _near_duplicates(docs: DataFrame, percent: int, bands: int, rows: int, size: int) -> DataFrame:
    drawn = stored(sketches(docs, bands, rows, size), "sketches")
    named = drawn.where("doc_id is not null and n_shingles > 0")
    # one row for each distinct set
    sets = named.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    members = sets.select("rep", "n", F.explode("bands").alias("bucket"))
    full = stored(members.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").withColumn("size", F.col("m")), "full")
    total = full.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    shared = stored(hot_join(members, full, ["bucket"], "size", total), "buckets")
    crowd = shared.groupBy("rep").agg(F.sum("m").alias("crowd"))
    hubs = shared.join(crowd, "rep").groupBy("bucket").agg(F.max_by(F.struct("rep", "n"), F.struct("crowd", -F.col("rep"))).alias("hub"), F.count("*").alias("size"))
    pairs = hot_join(shared, stored(hubs, "hubs"), ["bucket"], "size", total).where("rep <> hub.rep").where(alike("n", "hub.n", percent))
    stars = stored(pairs.select(F.col("rep").alias("a"), F.col("hub.rep").alias("b")).distinct(), "stars")
    ends = stored(stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).distinct(), "ids")
    links = stored(confirmed(stars, sets_of(docs, ends, size), percent), "links")
    # texts of one document, and what the stars found
    groups = stored(components(links), "groups")

    open_ = stored(shared.join(groups, shared.rep == groups.node, "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component")), "placed")
    several = open_.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high").select("bucket", "size")
    left = stored(hot_join(open_, stored(several, "several"), ["bucket"], "size", total).select("rep", "component").distinct(), "open")
    rest_sets = sets_of(docs, left.select(F.col("rep").alias("doc_id")), size)
    tried = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = stored(across(left, rest_sets, percent).join(tried, ["a", "b"], "left_anti"), "rest")
    more = stored(confirmed(rest, rest_sets, percent), "links")
    last = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)) if not more.isEmpty() else groups
    found = sets.select("set_hi", "set_lo", "rep", "copies").join(last, F.col("rep") == F.col("node"), "left").select("set_hi", "set_lo", "copies", F.coalesce("component", "rep").alias("found"))
    filled, number = drawn.drop("bands").where("n_shingles > 0"), drawn.count()
    rows_ = hot_join(filled, stored(found, "classes"), ["set_hi", "set_lo"], "copies", number, "left")
    placed = rows_.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("found")).alias("component_id"))
    every = placed.union(drawn.where("n_shingles = 0").select("doc_id", "n_shingles", "doc_id"))
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def representatives(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, with all their columns, that are kept: one document of each group.  Of rows that share a doc_id one
    stays; all rows without a doc_id stay."""
    kept = near_duplicates(docs, **how).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).union(docs.where("doc_id is null"))
