"""Sampling of many texts: what a slice holds at once, and its steps."""

import tracemalloc

import numpy as np

from candlewick.llm import queries, subword_sampling
from candlewick.llm.lattice import _begins, _find, vocabulary


def test_a_slice_is_sampled_in_little_memory():
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 12)))) for _ in range(20_000)]
    texts = [" ".join(rng.choice(words, 400)).encode() for _ in range(subword_sampling.SLICE // 3000)]
    vocab = vocabulary(queries.PIECES)
    tracemalloc.start()
    try:
        drawn = subword_sampling.sample_batch(texts, list(range(len(texts))), vocab, 2, 0)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all(len(rows) == 2 for rows in drawn) and most < 100_000_000


def test_each_encoding_is_judged_by_what_it_writes():
    vocab = vocabulary(queries.PIECES)
    texts = [b"", "né ▁ü\U0001f600\n ".encode(), b"\xff\xfe a", b" ", b"the"]
    each = [[row[0] for row in rows] for rows in subword_sampling.sample_batch(texts, [1, 2, 3, 4, 5], vocab, 2, 0)]
    n = sum(map(len, each))
    assert subword_sampling.comes_back(texts, each, vocab) == [True] * n
    assert subword_sampling.comes_back([b"x"] * 5, each, vocab) == [False] * n


def test_units_are_told_apart():
    texts = [b"ab ba  ab\n\nab", b"", b" ab", b"ba ab"]
    points, size, number, counts = subword_sampling.cut_units(texts)
    names = ["".join(map(chr, x)) for x in np.split(points, np.cumsum(size)[:-1])]
    assert [names[i] for i in number] == ["▁ab", "▁ba", "▁▁ab", "\n", "\n", "ab", "▁▁ab", "▁ba", "▁ab"] and counts.tolist() == [6, 0, 1, 2] and len(names) == len(set(names))


def test_hashes_are_found_as_by_a_search():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 1000):
        keys = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        sought = np.concatenate([keys, rng.integers(0, 1 << 64, 5000, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
        assert (_find(keys, _begins(keys), sought) == np.minimum(np.searchsorted(keys, sought), len(keys) - 1)).all()
