"""Rows that share a doc_id, rows that are equal, and rows without an id, in the mix."""

import math
from collections import Counter

from candlewick.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, mark):
    return " ".join(f"{mark}{i}" for i in range(n))


def test_rows_that_share_an_id_come_as_often_as_each_is_taken(spark):
    rows = [(1, words(100, "a"), "en", "s", 1), (1, words(5000, "b"), "en", "s", 2)] + [(i, words(400 + i, f"c{i}_"), "en", "st"[i % 2], 3) for i in range(2, 40)]
    rows += [(None, words(300 + i, f"n{i}_"), "en", "s", 4) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    taken = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in taken) == Counter((i, len(t.split())) for i, t, *_ in rows)
    want = Counter({(r.doc_id, r.size): int(math.floor(r.taken / r.size + 0.5)) for r in taken})
    assert Counter((r.doc_id, len(r.text.split())) for r in mixing.mixed(docs).collect()) == +want
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str) == sorted(map(tuple, taken), key=str)


def test_equal_rows_come_together_as_often_as_they_are_taken(spark):
    rows = [(5, words(1000, "x"), "en", "s", i) for i in range(7)] + [(i, words(1500, f"y{i}_"), "en", "st"[i % 2], 9) for i in range(10, 22)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    taken = sum(int(math.floor(r.taken / r.size + 0.5)) for r in mixing.mix(docs).collect() if r.doc_id == 5)
    assert sum(r.doc_id == 5 for r in mixing.mixed(docs).collect()) == taken > 7
