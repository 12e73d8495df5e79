"""Operators 11 to 13 against brute-force versions, on documents with nulls, empty, long, tied and repeated rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from candlewick.llm import alignment, clustering, queries, toxicity

# Alignment


def token_bytes():
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    value = {chr(b if b in plain else next(rest)): b for b in range(256)}
    a = Tokenizer.from_file(queries.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)

    def of_a(text):
        got = a.encode(" " + text, add_special_tokens=False)
        return [(i, bytes(value[c] for c in t)) for i, t in zip(got.ids, got.tokens, strict=True)]

    def of_b(text):
        ids = b.encode(text)
        return [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids]

    return of_a, of_b


def brute_alignment(texts):
    of_a, of_b = token_bytes()
    done, links = [], Counter()
    for text in texts:
        a, b = (of_a(text), of_b(text)) if text else ([], [])
        want = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            done.append(([], [], [], []))
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        shared = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for end in shared:
            groups.append("|".join(",".join(str(i) for _, e, i in side if low < e <= end) for side in spans))
            low = end
        met, j0 = [], 0
        for s, e, i in spans[0]:
            while j0 < len(spans[1]) and spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][0] < e:
                met.append((i, spans[1][j][2]))
                j += 1
        links.update(met)
        done.append((a, b, groups, met))
    best = {}
    for (_, j), n in links.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for a, b, groups, met in done:
        text = ";".join(groups)
        out.append((len(a), len(b), len(groups), len(met), sum(links[p] == best[p[1]] for p in met), sum(links[p] for p in met), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def alignment_rows():
    draw = random.Random(4)
    words = "the of river Straße naïve 1234 don't über_all fooBar 日本語 x=y; ... emoji😀 schnell café".split()
    rows = [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 40))) for _ in range(40)]
    rows += ["  two  spaces ", "\n\n\t tab", "a▁b", "nul \x00 in", "<|endoftext|> <s> </s> <unk> <0x41>", "", None, " ", "x" * 3000, "é" * 700, "  odd 　 space", "a" + " " * 3000 + "b", "﻿bom", "𝔘nicode 𐍈", "-" * 777, "=" * 41 + "a" + "=" * 3]
    rows += [rows[0], rows[0], " ".join(rows[:40])]
    return rows


def test_alignment_equals_brute_force(spark):
    texts = alignment_rows()
    schema = "doc_id long, text string, pair long, row long, n long, best boolean, groups string"
    docs = spark.createDataFrame([(None if i == 3 else i, t, 1, 2, 3, True, "g") for i, t in enumerate(texts)], schema).repartition(3)
    want = Counter((None if i == 3 else i, *w) for i, w in enumerate(brute_alignment(texts)))
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    for hot in (alignment.HOT, 3, 0):  # all pairs looked up, nearly none, none
        got = alignment.digest(docs, queries.BYTE_BPE, queries.PIECES, hot)
        assert set(columns) == set(got.columns)
        assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == want
    assert alignment.digest(docs.limit(0), queries.BYTE_BPE, queries.PIECES).count() == 0
    assert {r.n_a for r in alignment.digest(docs.where("text is null or text = ''"), queries.BYTE_BPE, queries.PIECES).collect()} == {0}


def test_quick_encoder_equals_the_library():
    of, lib = alignment.pair(queries.BYTE_BPE, queries.PIECES), Tokenizer.from_file(queries.BYTE_BPE)
    lib.encode_special_tokens = True
    draw = random.Random(6)
    names = [n for n in (b.decode("utf-8", "ignore") for b in of.bytes_a) if n]
    texts = ["".join(draw.choice(names) if draw.random() < 0.3 else draw.choice(names).strip() for _ in range(6)) for _ in range(20_000)]
    texts += [draw.choice(names) * draw.randrange(1, 9) + draw.choice(names) * draw.randrange(1, 5) for _ in range(10_000)]
    texts += [f"a{chr(c)}1{chr(c)} {chr(c)}b" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for text in texts:
        assert of.quick.encode_ordinary(" " + text) == lib.encode(" " + text, add_special_tokens=False).ids, text


def test_memory_of_windows_may_be_cleared(monkeypatch):
    of = alignment.pair(queries.BYTE_BPE, queries.PIECES)
    encoded = [e for e in of.encode([(t or "").encode() for t in alignment_rows()]) if e]
    whole = alignment.Aligner(of).align(encoded)
    monkeypatch.setattr(alignment, "MEMO", 2)
    small = alignment.Aligner(of)
    assert [small.align([e])[0] for e in encoded] == whole


def test_megabyte_text_aligned(spark):
    text = " ".join(f"word{i} naïve" for i in range(90_000))
    (row,) = alignment.digest(spark.createDataFrame([(1, text)], "doc_id long, text string"), queries.BYTE_BPE, queries.PIECES).collect()
    assert row.n_links == row.n_a + row.n_b - row.n_groups and row.n_groups > 180_000


# Toxicity

BAD = ["zorgle", "blatherskite", "vexmonger"]


def toxic_corpus(n=600, seed=9):
    draw = random.Random(seed)
    words = ["".join(draw.choice("bcdfghlmnrst") + draw.choice("aeiou") for _ in range(draw.randrange(2, 5))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic = draw.random() < 0.2
        text = [draw.choice(words) for _ in range(draw.randrange(10, 80))]
        if toxic:
            for _ in range(draw.randrange(1, 5)):
                text.insert(draw.randrange(len(text)), draw.choice(BAD) + draw.choice(["", "s", "ing"]))
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(toxic)))
    return docs, labels


def brute_scores(model, text):
    """The same model, every example compared with every text."""
    ids, w = model.vector(toxicity.words_of(text.encode()))
    if not len(ids):
        return model.steps[1][0], []
    dense = np.zeros((len(model.toxic), len(model.terms) + 1))
    for t in range(len(model.terms) + 1):
        part = slice(model.at[t], model.at[t + 1])
        dense[model.examples[part], t] = model.weights[part]
    query = np.zeros(len(model.terms) + 1)
    query[ids] = w
    cosine = dense @ query
    who = sorted((i for i in range(len(cosine)) if cosine[i] > 0), key=lambda i: (-round(cosine[i], 12), i))[: model.k]
    votes = [model.stands[i] * toxicity.NEAR / (toxicity.NEAR + max(1 - cosine[i], 0)) for i in who]
    share = (sum(v for v, i in zip(votes, who, strict=True) if model.toxic[i]) + toxicity.PRIOR * model.base) / (sum(votes) + toxicity.PRIOR)
    return float(np.interp(share, model.steps[0][1:], model.steps[1][1:])), who


@pytest.fixture(scope="module")
def toxic(spark):
    docs, labels = toxic_corpus()
    extra = [(900, None), (901, ""), (902, " \n 12 !!"), (None, "zorgle zorgle"), (903, docs[4][1]), (903, docs[4][1]), (904, "ZORGLE " * 30_000)]
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs + extra], "doc_id long, text string, y int, key string")
    return d.repartition(3), spark.createDataFrame([(i, y, y, "c") for i, y in labels] + [(None, 1, 1, "c"), (7, None, None, "c")], "doc_id long, toxic int, quality int, text string"), docs + extra, dict(labels)


def test_toxicity_finds_forms_of_words(toxic):
    docs, labels, rows, known = toxic
    got = toxicity.scores(docs, labels).collect()
    assert len(got) == len(rows) and {c for c in ("doc_id", "held_out", "score", "predicted")} <= set(got[0].asDict())
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(by[i].predicted, y) for i, y in known.items() if by[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97 and sum(p for p, y in held if not y) == 0
    assert by[904].predicted == 1 and by[900].score == by[901].score == by[902].score < 0.7
    assert by[904].evidence[0].label == 1 and by[900].evidence == []


def test_scores_equal_comparing_all(toxic, spark):
    docs, labels, rows, _ = toxic
    model = toxicity.learned(docs, labels, "toxic", ~toxicity.held() & F.col("doc_id").isNotNull(), 4000, 4096, 25)
    got = {(r.doc_id, round(r.score, 9)) for r in toxicity.scores(docs, labels).collect()}
    assert got == {(i, round(brute_scores(model, t or "")[0], 9)) for i, t in rows}
    for _, t in rows[:80]:
        ids, w = model.vector(toxicity.words_of(t.encode()))
        assert model.nearest(ids, w)[0].tolist() == brute_scores(model, t)[1]


def test_labels_of_held_out_documents_and_other_columns_do_not_matter(toxic, spark):
    docs, labels, _, _ = toxic
    one = {(r.doc_id, r.score) for r in toxicity.scores(docs, labels).collect()}
    flipped = labels.withColumns({"toxic": F.when(toxicity.held(), 1 - F.col("toxic")).otherwise(F.col("toxic")), "quality": F.lit(1)})
    assert {(r.doc_id, r.score) for r in toxicity.scores(docs.repartition(7), flipped).collect()} == one


def test_toxicity_without_labels_or_texts(toxic, spark):
    docs, labels, rows, _ = toxic
    assert {(r.score, r.predicted) for r in toxicity.scores(docs, labels.limit(0)).collect()} == {(0.0, 0)}
    assert toxicity.scores(docs.limit(0), labels).count() == 0
    bounded = toxicity.scores(docs, labels, per_label=50, most_terms=30).collect()
    assert len(bounded) == len(rows) and max(r.score for r in bounded if r.doc_id == 904) > 0.5
    both = labels.unionByName(labels.withColumn("toxic", 1 - F.col("toxic")))  # every text has both labels
    assert toxicity.scores(docs, both).agg(F.max("score")).first()[0] < 0.7


def test_isotonic_is_the_least_squares_fit():
    draw = np.random.default_rng(3)
    x, y, w = draw.random(60).round(1), draw.random(60) < 0.5, draw.integers(1, 4, 60).astype(float)
    points, levels = toxicity.isotonic(x, y, w, 0.1, 0.0)
    assert (np.diff(levels[1:]) >= 0).all() and (np.diff(points) >= 0).all()
    assert math.isclose(points[0], -1)


# Clusters


def brute_clusters(rows, k=16, rounds=3):
    def ok(v):
        return v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, [math.floor(64 * x) if abs(x) < 2**53 else 64 * int(x) for x in v]) for i, v in rows if ok(v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    named += [("~", v) for i, v in kept if i is None]
    centers = [list(v) for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for c in range(len(centers)):
            mine = [v for (_, v), n in zip(kept, at, strict=True) if n == c]
            if mine:
                centers[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    done = [(i, *near(v)[::-1]) for i, v in kept]
    each = Counter()
    for _, c, d in done:
        each[c] += d
    fit = lambda x: x if x < 2**63 else None
    whole = lambda ds: None if any(fit(d) is None for d in ds) else fit(sum(ds))
    of = {c: whole([d for _, n, d in done if n == c]) for c in each}
    total = None if None in of.values() else fit(sum(of.values()))
    return Counter((i, c, fit(d), of[c], total, hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for i, c, d in done)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
VECTORS = "vec_id long, embedding array<float>, label int, cluster string, vec int"


def clustered(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], VECTORS).repartition(4)
    return Counter(tuple(r[c] for c in COLUMNS) for r in clustering.clusters(df).collect())


def vectors(n, seed, spread=1.0):
    draw = np.random.default_rng(seed)
    return [(i, [float(x) for x in (draw.normal(0, spread, 64) + (i % 5)).astype(np.float32)]) for i in range(n)]


def test_clusters_equal_brute_force(spark):
    rows = vectors(300, 1)
    rows += [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 63 + [None]), (404, [float("nan")] + [0.0] * 63), (405, [float("inf")] * 64), (406, [0.0] * 64), (406, [0.0] * 64), (None, [2.0] * 64)]
    assert clustered(spark, rows) == brute_clusters(rows)


@pytest.mark.parametrize("rows", [[], [(1, [0.5] * 64)], [(i, [0.25] * 64) for i in range(40)], [(7, [float(i % 3)] * 64) for i in range(30)], [(None, [float(i)] * 64) for i in range(3)]])
def test_few_equal_and_tied_vectors(spark, rows):
    assert clustered(spark, rows) == brute_clusters(rows)


def test_large_components_are_exact(spark):
    draw = np.random.default_rng(5)
    rows = vectors(60, 2) + [(100 + i, [float(np.float32(x)) for x in draw.normal(0, 10.0 ** (5 + 4 * i), 64)]) for i in range(8)]
    assert clustered(spark, rows) == brute_clusters(rows)


def test_search_measures_few_and_misses_none():
    draw = np.random.default_rng(8)
    x = draw.integers(-200, 200, (500, 64)) + 40 * draw.integers(0, 16, (500, 1))
    c = draw.integers(-200, 200, (16, 64)) + 40 * np.arange(16)[:, None]
    name, best, measured = clustering.search(x, c)
    far = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (name == far.argmin(1)).all() and (best == far.min(1)).all()
    assert measured < 0.5 * far.size
    tied = clustering.search(x, np.concatenate([c, c]))
    assert (tied[0] == name).all()


def test_clusters_by_sql(spark, tmp_path):
    rows = vectors(200, 6) + [(500, None), (501, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], VECTORS)
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    found = duckdb.sql(clustering.oracle())
    at = [found.columns.index(c) for c in COLUMNS]
    assert Counter(tuple(r[i] for i in at) for r in found.fetchall()) == brute_clusters(rows)
