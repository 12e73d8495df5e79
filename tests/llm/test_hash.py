"""Words that are equal modulo 2**64 for every base: Thue and Morse's of 1,024 letters and its complement."""

import random

import numpy as np

from candlewick.llm import bytehash, minhash, quality, queries, subword_sampling, suffix_index


def pair(a="a", b="b"):
    signs = [0]
    for _ in range(10):
        signs += [1 - s for s in signs]
    return "".join((a, b)[s] for s in signs), "".join((b, a)[s] for s in signs)


def test_arithmetic_modulo_the_prime():
    draw, p = random.Random(1), bytehash.PRIME
    a = [draw.randrange(p) for _ in range(500)] + [0, 1, p - 1, p - 1]
    b = [draw.randrange(p) for _ in range(500)] + [p - 1, p - 1, p - 1, 1]
    assert bytehash.times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % p for x, y in zip(a, b, strict=True)]
    assert bytehash.powers(bytehash.BASE, 3000).tolist() == [pow(bytehash.BASE, i, p) for i in range(3000)]
    data = draw.randbytes(2000)
    sums, total = bytehash.prefix_sums(np.frombuffer(data, np.uint8)).tolist(), 0
    for i, x in enumerate(data):
        total = (total + int(bytehash.TABLE[x]) * pow(bytehash.BASE, i, p)) % p
        assert sums[i + 1] == total
    assert len(set(bytehash.TABLE.tolist())) == 256


def test_the_pair_is_told_apart(spark):
    q, r = pair()
    hashes = {int(h[0]) for h in bytehash.batch_word_hashes([q.encode(), r.encode()])}
    assert len(hashes) == 2
    assert {int(bytehash.word_hashes(w.encode())[0]) for w in (q, r)} == hashes
    rest = " ".join(f"w{i}" for i in range(5))
    rows = [(0, f"{rest} {q}"), (1, f"{rest} {r}"), (2, f"s {q} t {r} q t"), (3, f"s {q} r t {q} r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert all(x.round_trip for x in subword_sampling.sample_encodings(docs, queries.PIECES, check=True).collect())
    near = {x.doc_id: x for x in minhash.near_duplicates(docs, percent=85, bands=32).collect()}
    assert near[0].component_id == 0 and near[1].component_id == 1
    repeats = {x.doc_id: x.n_repeat_words for x in quality.clean_lines(spark.createDataFrame([(0, f"s {q} t r {r} t"), (1, f"{q} s t {r} s t"), (2, f"{q} s t {q} s t")], "doc_id long, text string"), text=False).collect()}
    assert repeats == {0: 0, 1: 0, 2: 6}
    assert {x.doc_id: x.n_removed for x in suffix_index.digest(suffix_index.without_repeats(spark.createDataFrame([(0, q), (1, r)], "doc_id long, text string"))).collect()} == repeated({0: q, 1: r})


def repeated(texts):
    """Bytes that a 200-byte string covers which starts anywhere else too."""
    places = {}
    for i, t in texts.items():
        for k in range(len(t) - 199):
            places.setdefault(t[k : k + 200], []).append((i, k))
    gone = {i: set() for i in texts}
    for found in places.values():
        if len(found) > 1:
            for i, k in found:
                gone[i] |= set(range(k, k + 200))
    return {i: len(g) for i, g in gone.items()}


def test_words_of_long_texts_are_cut_alike():
    draw = random.Random(2)
    words = ["".join(draw.choice("abc") for _ in range(draw.randrange(1, 9))) for _ in range(40_000)] + ["x" * 150_000, "end"]
    got = bytehash.word_hashes(" ".join(words).encode())
    assert len(got) == len(words)
    each = {w: int(bytehash.word_hashes(w.encode())[0]) for w in set(words)}
    assert got.tolist() == [each[w] for w in words] and len(set(each.values())) == len(each)
