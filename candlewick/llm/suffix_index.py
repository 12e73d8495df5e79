"""Suffix-array dedup (operator 6): repeated byte windows, found with a logarithmic family of sparse suffix indexes.

The index holds the suffixes that start at anchors (see anchors.py), about one in 70 bytes, as the sorted distinct hashes of
their first ``gram`` bytes with a count: all that tells whether a long match can start there.  Documents arrive in batches.
A new batch gets an index of its own, which is merge-scanned against each level (a sort-merge join on the gram); grams that
are in both, or twice in the batch, are matches.  The batch then becomes a level, and two levels of equal size are merged to
one of the next, so n batches leave at most log n levels and each entry is rewritten log n times.

Matches are settled exactly afterwards, on full windows:

* runs of windows whose bytes are the same in two places are repeated as a whole;
* of the other runs at a matching gram, every window is compared with all windows at that gram.

A gram with more than ``crowd`` different runs is compared by a shuffle on window hashes, so no group lands in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.anchors import runs, window_hashes
from candlewick.llm.common import as_bytes, hot_join, map_slices, row_key, scratch, slices, stored, texts_of, unstore

CROWD = 4096


def suffixes(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """doc_key, gram, region, first, last: the runs of windows of each text (doc_key, text as bytes)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = list(runs(texts_of(batch), width, gram))
        if not found:
            return None
        text, first, last, grams, region = (np.concatenate([getattr(r, f) for r in found]) for f in ("text", "first", "last", "gram", "region"))
        return pa.RecordBatch.from_arrays([batch.column("doc_key").take(pa.array(text)), pa.array(grams.view(np.int64)), pa.array(region.view(np.int64)), pa.array(first.astype(np.int64)), pa.array(last.astype(np.int64))], ["doc_key", "gram", "region", "first", "last"])

    return map_slices(docs, "text", step, "doc_key binary, gram long, region long, first long, last long")


class SuffixIndex:
    """Levels of sorted distinct grams with counts; add() merge-scans a batch against them.  Batches can be added at any time, and
    the levels stay until close()."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, grams: DataFrame) -> DataFrame:
        """grams: the grams of a batch's suffixes.  Returns the distinct grams that the batch has twice or shares with an
        earlier batch, and takes the batch into the index."""
        new = stored(grams.groupBy("gram").agg(F.count("*").alias("n")).sortWithinPartitions("gram"), "level")
        met = new.where("n > 1").select("gram")
        for _, level in self.levels:
            met = met.union(new.join(level.select("gram"), "gram", "left_semi").select("gram"))
        met = stored(met.distinct(), "matches")
        order = 0
        while self.levels and self.levels[-1][0] == order:
            _, old = self.levels.pop()
            both = stored(old.union(new).groupBy("gram").agg(F.sum("n").alias("n")).sortWithinPartitions("gram"), "level")
            unstore(old)
            unstore(new)
            new, order = both, order + 1
        self.levels.append((order, new))
        return met

    def counts(self) -> DataFrame:
        """gram, n: how many suffixes of all batches start with each gram."""
        every = reduce(DataFrame.union, [level for _, level in self.levels])
        return every if len(self.levels) == 1 else every.groupBy("gram").agg(F.sum("n").alias("n"))

    def close(self) -> None:
        for _, level in self.levels:
            unstore(level)


def ranges(hits: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers in a sorted array, as (first, last)."""
    cut = np.flatnonzero(np.diff(hits) > 1)
    return list(zip(hits[np.append(0, cut + 1)].tolist(), hits[np.append(cut, len(hits) - 1)].tolist(), strict=True))


def _settle(rows: list[tuple], width: int) -> list[tuple]:
    """rows: (gram, region, n, body) with all regions of their grams.  (gram, region, ranges of repeated windows)."""
    hashes = [window_hashes(r[3], width) for r in rows]
    size = np.array([len(h) for h in hashes])
    number = np.repeat(np.arange(len(rows)), size)
    flat = np.concatenate(hashes) ^ np.repeat(np.array([r[0] for r in rows], np.int64).view(np.uint64), size)
    _, inverse = np.unique(flat, return_inverse=True)
    weight = np.bincount(inverse, np.array([r[2] for r in rows], float)[number])
    again = weight[inverse] > 1
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out = []
    for i, hit in enumerate(np.split(np.flatnonzero(again), np.searchsorted(number[again], np.arange(1, len(rows))))):
        if len(hit):
            out.append((rows[i][0], rows[i][1], [{"first": a, "last": b} for a, b in ranges(place[hit])]))
    return out


def repeated_windows(bodies: DataFrame, width: int, crowd: int) -> DataFrame:
    """gram, region, ranges: the windows of each region that occur in another, or in one that stands in two places.
    bodies: gram, regions (how many the gram has), region, n (places), body."""
    kind = "gram long, region long, ranges array<struct<first long, last long>>"
    arrow = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("gram", "region", "n", "body")), strict=True)
            done = len(held)
            while done and held[done - 1][0] == held[-1][0]:  # the last gram may go on in the next batch
                done -= 1
            if done:
                yield pack(_settle(held[:done], width))
                held = held[done:]
        if held:
            yield pack(_settle(held, width))

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        g, r, x = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(r, pa.int64()), pa.array(x, arrow)], ["gram", "region", "ranges"])

    few = bodies.where(F.col("regions") <= crowd).select("gram", "region", "n", "body")
    parted = few.repartition("gram").sortWithinPartitions("gram").mapInArrow(settle, kind)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", 1 << 18):
            for g, r, n, body in zip(*(batch.column(c).to_pylist() for c in ("gram", "region", "n", "body")), strict=True):
                h = window_hashes(body, width).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), g)), pa.array(np.full(len(h), r)), pa.array(np.full(len(h), n)), pa.array(h), pa.array(np.arange(len(h)))], ["gram", "region", "n", "window", "place"])

    many = bodies.where(F.col("regions") > crowd).select("gram", "region", "n", "body").mapInArrow(explode, "gram long, region long, n long, window long, place long")
    twice = many.groupBy("gram", "window").agg(F.sum("n").alias("n")).where("n > 1").select("gram", "window")
    spread = many.join(twice, ["gram", "window"], "left_semi").groupBy("gram", "region").agg(F.sort_array(F.collect_list("place")).alias("places"))
    single = F.transform("places", lambda p: F.struct(p.alias("first"), p.alias("last")))
    return parted.union(spread.select("gram", "region", single.alias("ranges")))


def spans(docs: DataFrame, width: int = 200, gram: int = 64, batches: int = 4, crowd: int = CROWD) -> DataFrame:
    """doc_key, spans (array of start and end, in bytes): windows of `width` bytes that start elsewhere too.  Spans may
    overlap.  docs: doc_key, text (as bytes)."""
    index, matches = SuffixIndex(), []
    for i in range(batches):
        batch = docs.where(F.pmod(F.xxhash64("doc_key"), F.lit(batches)) == i)
        matches.append(index.add(suffixes(batch, width, gram).select("gram")))
    met = stored(index.counts().join(reduce(DataFrame.union, matches).distinct(), "gram", "left_semi"), "met")
    number = index.counts().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    index.close()
    hits = stored(hot_join(suffixes(docs, width, gram), met, ["gram"], "n", number), "hits")
    regions = stored(hits.groupBy("gram", "region").agg(F.count("*").alias("n"), F.min(F.struct("doc_key", "first", "last")).alias("at")), "regions")
    open_ = regions.groupBy("gram").agg(F.count("*").alias("regions"), F.min("n").alias("least")).where("regions > 1 and least = 1").drop("least")
    open_ = stored(open_.withColumn("size", F.col("regions")), "open")
    asked = hot_join(regions, open_, ["gram"], "size", number).select("at.*", "gram", "regions", "region", "n")
    by_text = asked.groupBy("doc_key").agg(F.collect_list(F.struct("first", "last", "gram", "regions", "region", "n")).alias("asked"))

    def bodies(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source, "text"):
            rows = [(a["gram"], a["regions"], a["region"], a["n"], t[a["first"] : a["last"] + width]) for t, asked_ in zip(texts_of(batch), batch.column("asked").to_pylist(), strict=True) for a in asked_]
            g, k, r, n, body = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(k), pa.array(r), pa.array(n), pa.array(body, pa.binary())], ["gram", "regions", "region", "n", "body"])

    cut = docs.join(by_text, "doc_key").select("text", "asked").mapInArrow(bodies, "gram long, regions long, region long, n long, body binary")
    cut = stored(cut.dropDuplicates(["gram", "region"]), "bodies")
    partly = repeated_windows(cut, width, crowd)
    verdict = stored(regions.select("gram", "region", "n").join(partly, ["gram", "region"], "left").where("n > 1 or ranges is not null"), "verdicts")
    whole = F.array(F.struct(F.col("first").alias("start"), (F.col("last") + width).alias("end")))
    part = F.transform("ranges", lambda r: F.struct((F.col("first") + r["first"]).alias("start"), (F.col("first") + r["last"] + width).alias("end")))
    judged = hot_join(hits, verdict.withColumn("size", F.col("n")), ["gram", "region"], "size", number)
    judged = judged.select("doc_key", F.when(F.col("n") > 1, whole).otherwise(part).alias("spans"))
    return judged.groupBy("doc_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(found: list[dict]) -> list[tuple[int, int]]:
    """Sorted maximal spans; touching ones are joined."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, width: int = 200, gram: int = 64, batches: int = 4, crowd: int = CROWD) -> DataFrame:
    """doc_id, text (as bytes, without repeated ones), n_bytes, n_removed, removed (maximal spans), a row for each row of docs.

    Removed is each byte covered by a `width`-byte string that starts anywhere else too, in any row, judged on the texts
    as given.  Null counts as empty; texts below `width` bytes stay.  Repeated rows repeat each other.  A null doc_id is
    kept.  Other columns are ignored.
    """
    texts = as_bytes(docs, row_key().alias("doc_key")).withColumn("text", F.coalesce("text", F.lit(b"")))
    with scratch(docs.sparkSession) as keep:
        found = keep(spans(texts.select("doc_key", "text"), width, gram, batches, crowd), "spans")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source, "text"):
            left, n, gone, cuts = [], [], [], []
            for text, some in zip(texts_of(batch), batch.column("spans").to_pylist(), strict=True):
                cut = merged(some or [])
                edges = [0, *(x for span in cut for x in span), len(text)]
                left.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                n.append(len(text))
                gone.append(len(text) - len(left[-1]))
                cuts.append([{"start": a, "end": b} for a, b in cut])
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip((left, n, gone, cuts), kinds, strict=True))], ["doc_id", "text", "n_bytes", "n_removed", "removed"])

    joined = texts.join(found, "doc_key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, text binary, n_bytes long, n_removed long, removed array<struct<start long, end long>>")


def digest(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], width: int = 200) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 of each text by counting all windows: what tests compare with."""
    count: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - width + 1):
            w = t[i : i + width]
            count[w] = count.get(w, 0) + 1
    out = []
    for t in texts:
        cut = merged([{"start": i, "end": i + width} for i in range(len(t) - width + 1) if count[t[i : i + width]] > 1])
        edges = [0, *(x for span in cut for x in span), len(t)]
        left = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        out.append((len(t), len(t) - len(left), len(cut), hashlib.sha256(left).hexdigest()))
    return out
