"""Sums over the words of each document of values that are computed once for each distinct word.

The frequent words (at most ``hot``, so what is sent to tasks has a fixed size) are looked up where the text is read; the
other words of a document, few and mostly rare, are joined by a shuffle.  Both ways use the same table of distinct words,
so the sums are those of the full join of all (document, word) pairs at a fraction of its shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import as_bytes, map_slices, repeated, row_key, texts_of

#: Words sent to the tasks with their values: a fixed bound, some 10 MB.
HOT = 1 << 16
#: Classes of counts in an octave, and classes in all (counts are below 2**63).
STEPS, CLASSES = 8, 8 * 63
Words = Callable[[bytes], list[bytes]]


def word_counts(docs: DataFrame, words: Words, learned: F.Column | None = None) -> DataFrame:
    """word, n (occurrences), n_learned (those in documents where `learned` holds).  Counted within each slice of texts
    before anything is shuffled."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        every: Counter = Counter()
        of: Counter = Counter()
        for text, chosen in zip(texts_of(batch), batch.column("learned").to_pylist(), strict=True):
            (of if chosen else every).update(words(text))
        names = list(every.keys() | of.keys())
        n = [every[w] + of[w] for w in names]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(n, pa.int64()), pa.array([of[w] for w in names], pa.int64())], ["word", "n", "n_learned"])

    flag = F.lit(False) if learned is None else learned
    parts = map_slices(as_bytes(docs, flag.alias("learned")), "text", step, "word binary, n long, n_learned long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_learned").alias("n_learned"))


def frequent(table: DataFrame, hot: int) -> DataFrame:
    """The words of table (word, n, ...) that occur most: all from a count on, and at most `hot`.  The count comes from a histogram
    of at most CLASSES rows, so no task sends more words than are taken."""
    step = F.floor(F.log2("n") * STEPS).cast("int")
    sizes = dict(table.where("n > 0").groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect())
    least, total = CLASSES, 0
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > hot:
            break
        least = at
    return table.where((F.col("n") > 0) & (step >= least))


def document_sums(docs: DataFrame, words: Words, table: DataFrame, values: list[str], hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_words and the sum of each value over the words of the text, a row for each row of docs.

    table: word, n, and the values.  A word that the table lacks adds nothing.
    """
    spark = docs.sparkSession
    top = frequent(table, hot).select("word", *values).collect()
    known = spark.sparkContext.broadcast({bytes(r[0]): tuple(r[1:]) for r in top})
    kinds = dict(table.dtypes)
    zero = [0 if kinds[v] == "bigint" else 0.0 for v in values]
    schema = "doc_key binary, doc_id long, n_bytes long, n_words long, head long, word binary, n long, " + ", ".join(f"v{i} {kinds[v]}" for i, v in enumerate(values))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        look = known.value
        columns: list[list] = [[] for _ in range(7 + len(values))]
        for key, doc, text in zip(batch.column("doc_key").to_pylist(), batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            counts = Counter(words(text))
            sums = list(zero)
            rare = []
            for w, n in counts.items():
                got = look.get(w)
                if got is None:
                    rare.append((w, n))
                else:
                    for i, v in enumerate(got):
                        sums[i] += n * v
            # the first row has the sums so far; its word is the row's own, so that such rows spread over the join
            first = (key, doc, len(text), counts.total(), 1, b"\x00row " + key, 0, *sums)
            for column, x in zip(columns, first, strict=True):
                column.append(x)
            if rare:
                some = len(rare)
                for column, x in zip(columns, ([key] * some, [doc] * some, [0] * some, [0] * some, [0] * some, [w for w, _ in rare], [n for _, n in rare], *([z] * some for z in zero)), strict=True):
                    column.extend(x)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names)

    arrow = [pa.binary()] + [pa.int64()] * 4 + [pa.binary(), pa.int64()] + [pa.int64() if kinds[v] == "bigint" else pa.float64() for v in values]
    names = ["doc_key", "doc_id", "n_bytes", "n_words", "head", "word", "n", *(f"v{i}" for i in range(len(values)))]
    parts = map_slices(as_bytes(docs, row_key().alias("doc_key")), "text", step, schema)
    rows = parts.join(table.select("word", *values), "word", "left")
    total = [F.sum(F.col(f"v{i}") + F.coalesce(F.col(v) * F.col("n"), F.lit(0).cast(kinds[v]))).alias(v) for i, v in enumerate(values)]
    sums = rows.groupBy("doc_key", "doc_id").agg(F.sum("head").alias("copies"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_words").alias("n_words"), *total)
    each = [(F.col(c) / F.col("copies")).cast(kinds.get(c, "bigint")).alias(c) for c in ("n_bytes", "n_words", *values)]
    return repeated(sums.select("doc_id", "copies", *each))
