"""Each corpus operator against a brute-force version, on documents with nulls, empty, long, tied and repeated rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from candlewick.llm import ann, langid, lattice_lm, line_dedup, minhash, mixing, quality, queries, subword_sampling, suffix_index, token_counts
from candlewick.llm.lattice import decode, lattices, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, doc_key string, vec string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    draw = random.Random(3)
    pools = {"en": "the of and thing with river stone market under a to we they house light".split(), "de": "der die und nicht mit straße größe über haus ein zu wir sie licht".split()}
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        lines = [" ".join(draw.choice(pools[lang]) + draw.choice(["", "er", "s", "ing"]) for _ in range(draw.randint(4, 14))).capitalize() + "." for _ in range(draw.randint(2, 9))]
        rows.append([i, "\n".join(lines), lang, f"s{i % 4}"])
    rows[10][1] = rows[9][1]  # an exact copy
    rows[12][1] = rows[11][1] + " One more."  # a near copy
    long_ = "\n".join(r[1] for r in rows[:40])
    rows += [[120, None, "en", "s1"], [121, "", None, None], [122, " \n\t \n", "en", None], [123, "12 34 $$$ !!", "de", "s2"], [124, long_ * 8, "en", "s0"], [125, "x" * 3000, "en", "s0"], [126, "a <|endoftext|> b ☃ é ▁ΑΣ", None, "s3"]]
    rows.append([None, "A line without an id that is long enough.", "en", "s1"])
    rows += [list(rows[20]), list(rows[20])]  # repeated rows
    rows.append([127, rows[21][1].split("\n")[0][:-2] + "!.", "en", "s1"])
    return [(i, t, la, s, None, 7, 0.5, "k", "v") for i, t, la, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=True):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def test_token_counts(docs, empty):
    tok = Tokenizer.from_file(queries.WORD_BPE)
    want = Counter((d[0], len((d[1] or "").encode()), len(tok.encode(d[1] or "", add_special_tokens=False).ids)) for d in corpus())
    got = token_counts.token_counts(docs, queries.WORD_BPE, 100).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.token_counts(empty, queries.WORD_BPE).count() == 0
    bpe = token_counts.word_bpe(queries.WORD_BPE)
    for text in ("''s don't I'LL", "a\x1cb\x85c　d", "ﬁ Ⅷ ½ İ ΑΣΣ", "<|startoftext|><|endoftext|>x", "🙂‍🙂 é"):
        assert sum(bpe.pieces(w) for w in bpe.pretokens(text.encode())) == len(tok.encode(text, add_special_tokens=False).ids)


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(docs, empty):
    sets = {d[0]: shingle_set(d[1]) for d in corpus() if d[0] is not None}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i in sets if root(i) == i)


def test_star_misses_are_found(spark):
    """Links between members that both differ from their bucket's hub: a chain of texts, each near the next only."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(12):
        text = list(base)
        for j in range(k * 5):
            text[j * 5 + 2] = f"v{j}"
        rows.append((k, " ".join(text)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}


def test_pipeline_links_from_080(spark):
    """The pipeline's stage has no contract of its own and links from 0.80; op5_minhash links from 0.85."""
    import corpus_pipeline

    base = [f"w{i}" for i in range(400)]
    rows = []
    for k, changes in enumerate((0, 8, 9)):  # similarity to the first: 1, 356/436 = 0.817, 351/441 = 0.796
        text = list(base)
        for j in range(changes):
            text[40 * j + 20 + k] = f"v{k}.{j}"
        rows.append((k, " ".join(text)))
    sets = [shingle_set(t) for _, t in rows]
    alike = [len(sets[0] & s) / len(sets[0] | s) for s in sets]
    assert 0.80 <= alike[1] < 0.85 and alike[2] < 0.80
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs, "").collect()} == {0, 2}
    assert minhash.near_duplicates(docs, percent=85, bands=32).where("kept").count() == 3


def test_line_dedup(docs, empty):
    rows = sorted({(d[0] if d[0] is not None else 1 << 62, d[1]) for d in corpus() if d[1] is not None})
    seen, want = [], {}
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            if words(line):
                near = [x for x in seen if x == line or (len(line) >= 20 and len(x) >= 20 and abs(len(x) - len(line)) <= 1 and edit1(x, line))]
                if not near:
                    kept.append(line)
                seen.append(line)
            else:
                kept.append(line)
        want[i] = "\n".join(kept)
    got = line_dedup.deduplicated(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_equal", "n_near"]
    out = got.collect()
    assert len(out) == len(corpus())
    assert sum(r.n_near for r in out) >= 1
    for r in out:
        assert r.text == (want[r.doc_id if r.doc_id is not None else 1 << 62] if r.text is not None else None)
    assert line_dedup.deduplicated(empty).count() == 0


def edit1(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def test_line_edits_anywhere(spark):
    """Every place and kind of edit in short and long lines, also two edits, which is one too many."""
    draw = random.Random(5)
    rows, want = [], []
    for n in (20, 21, 63, 255, 256, 257, 700, 1500):
        line = "".join(draw.choice("abcdefgh ") for _ in range(n)) + "."
        rows.append((len(rows), line))
        want.append(line)
        for place in {0, 1, n // 3, n // 2, n - 2, n - 1, n}:
            for new in (line[:place] + "Z" + line[place:], line[:place] + line[place + 1 :], line[:place] + "Z" + line[place + 1 :]):
                rows.append((len(rows), new))
                want.append("")
        rows.append((len(rows), "QQ" + line))
        want.append("QQ" + line)
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = []
    for i, line in rows:
        assert got[i] == ("" if any(len(x) >= 20 and len(line) >= 20 and abs(len(x) - len(line)) <= 1 and (x == line or edit1(x, line)) for x in seen) or line in seen else line)
        seen.append(line)


def test_quality(docs, empty):
    got = quality.clean_lines(docs).collect()
    assert len(got) == len(corpus())
    by_id = {d[0]: d[1] for d in corpus()}
    for r in got:
        text = by_id[r.doc_id] or ""
        w = words(text, lower=False)
        grams = Counter(zip(w, w[1:], w[2:]))
        again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(again), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(text.count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality.clean_lines(empty).count() == 0
    fails = ["A | B | C", "No end", "BUY!! NOW!! OR!! NOT!!", "We use cookies: see our Cookie Policy.", "One### two$$$ three.", "All Rights Reserved."]
    assert all(map(quality.line_fails, fails))
    assert not any(map(quality.line_fails, ["A plain line.", "„Wirklich?“ fragte sie.", "It cost $5, or 3% less."]))


def test_language(docs, empty):
    got = langid.identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows, lang = got.collect(), {d[0]: d[2] for d in corpus()}
    assert len(rows) == len(corpus())
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.doc_id in (120, 121, 122, 123))
    judged = [r for r in rows if r.doc_id is not None and r.doc_id < 120]
    assert sum(r.lang_pred == lang[r.doc_id] for r in judged) >= 0.95 * len(judged)
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (120, 121, 122, 123)").count() == 0
    assert langid.accepted(empty).count() == 0


def test_language_long_texts_and_many_labels(spark):
    """Large alphabets do not fill up, scores do not fall with length, and no label is left out."""
    draw = random.Random(4)
    text = lambda start, size, n: "".join(chr(start + draw.randrange(size)) for _ in range(n))
    starts = {"big0": (0x4E00, 3000), "big1": (0x5A00, 3000)} | {f"small{k:02d}": (0x6600 + 20 * k, 12) for k in range(68)}
    rows = [(i * 100 + k, text(*starts[lang], 1500 if lang < "c" else 150), lang) for i, lang in enumerate(starts) for k in range(12)]
    asked = {10**6 + 10 * n + i: (f"big{i}", n) for n in (5, 300) for i in (0, 1)}
    rows += [(i, text(*starts[lang], n * 1000), None) for i, (lang, n) in asked.items()]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()}
    assert all(got[i].lang_pred == lang for i, (lang, _) in asked.items())
    assert all(abs(got[10**6 + 50 + i].score - got[10**6 + 3000 + i].score) < 0.05 for i in (0, 1))
    assert all(got[i].lang_pred == lang for i, _, lang in rows if lang)


def foreign():
    """(doc_id, text, stays): texts of no learned language, noise, and very short texts."""
    draw = random.Random(5)
    noise = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    gone = [
        " ".join(noise("abcdefghijklmnopqrstuvwxyz", draw.randint(2, 9)) for _ in range(300)), noise("0123456789abcdef", 3000), noise("ABCDEFGHIJKLMabcdefghijklmnopqrstuvwxyz0123456789+/", 3000), "qj" * 1500,
        "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 5, "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια. " * 5, "人人生而自由在尊严和权利上一律平等" * 5,
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "да нет", "99 人",
    ]
    return [(1000 + i, t, False) for i, t in enumerate(gone)] + [(1100, "The river.", True), (1101, "das haus", True)]


def language_scores(rows):
    """doc_id and (language, score) of the language model from Python sets of n-grams; every learned row is a landmark."""

    def pieces(text):
        text = (text or "").lower()
        k = -(-len(text) // langid.PIECE)
        cut = ["".join(c if c.isalpha() else " " for c in text[i * len(text) // k : (i + 1) * len(text) // k]) for i in range(k)]
        return [re.sub(" +", " ", f" {c} ") for c in cut if c.strip()]

    def grams(s):
        return frozenset(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))

    def mixed(s):
        return " " + "".join(chr(c) for c in np.random.default_rng(len(s)).permutation(np.array([ord(c) for c in s[1:-1]]))) + " "

    def kernel(parts):
        return np.mean([[len(p & m) / math.sqrt(len(p) * len(m)) for m in marks] for p in map(grams, parts)], axis=0)

    learned = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 and r[2] and pieces(r[1])]
    known = [(r[2], pieces(r[1])) for r in learned]
    marks, names = [grams(p[zlib.crc32(r[1].encode()) % len(p)]) for r, (_, p) in zip(learned, known, strict=True)], sorted({lang for lang, _ in known})
    x = np.array([kernel(p) for _, p in known] + [kernel([mixed(s) for s in p]) for _, p in known] + [np.zeros(len(marks))] * len(known))
    y = np.array([[1.0 if lang == n else -1.0 for n in names] for lang, _ in known] + [[-1.0] * len(names)] * (2 * len(known)))
    values, vectors = np.linalg.eigh(np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in marks] for a in marks]))
    whiten = (vectors / np.sqrt(np.maximum(values, 1e-300)))[:, values > 1e-9 * values[-1]]
    f = x @ whiten
    weights = np.linalg.solve((f - f.mean(0)).T @ (f - f.mean(0)) + 0.3 * np.eye(f.shape[1]), (f - f.mean(0)).T @ (y - y.mean(0)))
    out = {}
    for r in rows:
        if pieces(r[1]):
            v = y.mean(0) + (kernel(pieces(r[1])) @ whiten - f.mean(0)) @ weights
            out[r[0]] = names[int(v.argmax())], min(max((1 + v.max()) / 2, 0), 1), {c for m in marks for c in m if len(c) == 1}
    return out


def test_language_stage_drops_foreign_text(spark):
    import corpus_pipeline

    rows = corpus() + [(i, t, None, "s9", None, 7, 0.5, "k", "v") for i, t, _ in foreign()]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want, score = set(), language_scores(rows)
    for i, (_, value, alphabet) in score.items():
        letters = [c for c in next(r[1] for r in rows if r[0] == i).lower() if c.isalpha()]
        if 2 * sum(c in alphabet for c in letters) >= len(letters) if len(letters) < langid.SHORT else value >= 0.3:
            want.add(i)
    for r in langid.identify(docs).collect():
        assert (r.lang_pred == "und") == (r.doc_id not in score)
        assert r.doc_id not in score or abs(r.score - score[r.doc_id][1]) < 1e-6
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, "").collect()}
    assert kept == want
    assert {i for i, _, _ in foreign()} & kept == {i for i, _, stays in foreign() if stays}
    assert set(range(120)) <= kept


@pytest.mark.parametrize("crowd", [4096, 1])
def test_suffix_dedup(spark, docs, empty, crowd):
    want = Counter()
    for d, x in zip(corpus(), suffix_index.brute_force([(d[1] or "").encode() for d in corpus()])):
        want[(d[0], *x)] += 1
    got = suffix_index.digest(suffix_index.without_repeats(docs, crowd=crowd))
    assert Counter(map(tuple, got.collect())) == want
    if crowd == 1:
        assert suffix_index.digest(suffix_index.without_repeats(empty)).count() == 0


def test_suffix_dedup_periodic(spark):
    texts = ["ab" * 300, "xyz" + "ab" * 120, "é" * 150, "q" * 199, "q" * 200, "".join(chr(97 + i * 7 % 26) for i in range(500)), "z" + "".join(chr(97 + i * 7 % 26) for i in range(250))]
    rows = [(i, t) for i, t in enumerate(texts)]
    want = {i: x for i, x in enumerate(suffix_index.brute_force([t.encode() for t in texts]))}
    for batches in (1, 5):
        got = suffix_index.digest(suffix_index.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches)).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_lm_scores(docs, empty):
    rows = corpus()
    learned = [d for d in rows if d[0] is None or zlib.crc32(str(d[0]).encode()) % 5 != 1]
    counts = Counter(w for d in learned for w in (d[1] or "").encode().lower().split())
    total, distinct, ends = sum(counts.values()) + len(learned), len(counts) + 1, len(learned)
    text = {d[0]: (d[1] or "").encode().lower().split() for d in rows}
    got = lattice_lm.scores(docs, queries.PIECES).collect()
    assert len(got) == len(rows)
    for r in got:
        log = lambda c: math.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        assert r.n_tokens == len(text[r.doc_id]) + 1 and r.n_known == sum(counts[w] > 0 for w in text[r.doc_id]) + 1 and r.train_tokens == total
        assert math.isclose(r.base_score, sum(log(counts[w]) for w in text[r.doc_id]) + log(ends), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert lattice_lm.scores(empty, queries.PIECES).count() == 0


def segmentations(unit, vocab):
    ids = {p: i for i, p in enumerate(vocab.pieces) if i >= 259}

    def go(at, found, weight):
        if at == len(unit):
            yield tuple(found), weight
            return
        for n in range(1, 17):
            if at + n <= len(unit) and (i := ids.get(unit[at : at + n])) is not None:
                yield from go(at + n, [*found, i], weight + vocab.weights[i])
        if unit[at] not in ids:
            raw = [vocab.byte0 + b for b in unit[at].encode()]
            yield from go(at + 1, [*found, *raw], weight + sum(vocab.weights[raw]))

    return list(go(0, [], 0.0))


def test_lattice_marginals():
    vocab = vocabulary(queries.PIECES)
    units = ["▁the", "▁under", "☃", "▁é☃x", "▁▁▁a", "▁"]
    want = [math.log(sum(math.exp(w) for _, w in segmentations(u, vocab))) for u in units]
    found = lattices(units, vocab)
    assert np.allclose(found.unit_logs(), want)
    ends = np.append(found.start[1:], len(found.left)) - 1
    assert np.allclose(found.from_start()[ends], want)
    uses = lattice_lm.expected_uses(units, np.ones(len(units)), vocab)
    assert math.isclose(uses.sum(), sum(sum(len(s) * math.exp(w) for s, w in segmentations(u, vocab)) / sum(math.exp(w) for _, w in segmentations(u, vocab)) for u in units), rel_tol=1e-9)


def test_sampling_distribution():
    vocab, n = vocabulary(queries.PIECES), 4000
    text = "under the"
    every = [(a + b, x + y) for a, x in segmentations("▁under", vocab) for b, y in segmentations("▁the", vocab)]
    z = math.log(sum(math.exp(w) for _, w in every))
    true = {s: math.exp(w - z) for s, w in every}
    first, second, estimate = Counter(), Counter(), Counter()
    for rows in subword_sampling.sample_batch([text.encode()] * n, list(range(n)), vocab, 2, 11):
        a, b = (tuple(r[0]) for r in rows)
        assert a != b
        first[a] += 1
        second[b] += 1
        for ids, log_p, score in rows:
            assert math.isclose(math.exp(log_p), true[tuple(ids)], rel_tol=1e-9)
            estimate[tuple(ids)] += math.exp(log_p) / score / n
    for s in sorted(true, key=true.get)[-4:]:
        p2 = sum(true[t] * true[s] / (1 - true[t]) for t in true if t != s)
        assert abs(first[s] / n - true[s]) < 4 * math.sqrt(true[s] / n) and abs(second[s] / n - p2) < 4 * math.sqrt(p2 / n) + 0.003
        assert abs(estimate[s] - true[s]) < 0.05
    # all segmentations come, in some order, if asked for
    rows = subword_sampling.sample_batch([b"the"], [5], vocab, 1000, 0)[0]
    assert {tuple(r[0]) for r in rows} == {s for s, _ in segmentations("▁the", vocab)} and all(r[2] == 1.0 for r in rows)


def test_sampling_round_trip(docs, empty):
    got = subword_sampling.sample_encodings(docs, queries.PIECES, k=3)
    rows = subword_sampling.decoded(got, queries.PIECES).collect()
    text = {d[0]: (d[1] or "").replace("▁", " ") for d in corpus()}
    assert all(r.text == text[r.doc_id] and r.n_pieces == len(r.ids) for r in rows)
    again = {(r.doc_id, r["rank"], tuple(r.ids)) for r in subword_sampling.sample_encodings(docs.repartition(1), queries.PIECES, k=3).collect()}
    assert again == {(r.doc_id, r["rank"], tuple(r.ids)) for r in rows}
    assert Counter(r.doc_id for r in rows)[124] == 3 and Counter(r.doc_id for r in rows)[121] == 1
    assert subword_sampling.sample_encodings(empty, queries.PIECES).count() == 0
    assert decode([], vocabulary(queries.PIECES)) == ""


def filled(sizes):
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_ = {}, set(sizes)
    left = 1.5 * sum(sizes.values())
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / whole for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)
        left = 1.5 * sum(sizes.values()) - sum(target.values())
    return target


@pytest.mark.parametrize("block", [7, 2048])
def test_mixing(docs, empty, block):
    got = mixing.mix(docs, block=block).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((d[0], len(words(d[1])), d[3]) for d in corpus())
    sizes = Counter()
    for d in corpus():
        sizes[d[3]] += len(words(d[1]))
    want, taken = filled(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, mixing.mix(docs.repartition(5), block=block).collect())) == sorted(map(str, got))
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_schedule_is_even(spark):
    goals = spark.createDataFrame([(0, 5000, 9000.0), (1, 3000, 3000.0), (2, 1000, 500.0)], "nth long, source_size long, target double")
    slots = sorted(mixing.schedule(goals, 10).collect())
    assert {n: sum(s.words for s in slots if s.nth == n) for n in range(3)} == {0: 9000, 1: 3000, 2: 500}
    half = [s for s in slots if s.slot < slots[-1].slot / 3]
    share = sum(s.nth == 0 for s in half) / len(half)
    assert abs(share - 0.72) < 0.02


def test_nearest(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(40, 24))
    points = (centres[draw.integers(0, 40, 1500)] + 0.25 * draw.normal(size=(1500, 24))) * draw.uniform(0.9, 1.1, (1500, 1))
    points[300:700] = points[200]  # one very common vector
    rows = [(i, [float(x) for x in v], 1, "x") for i, v in enumerate(points)]
    rows += [(2000, None, 0, ""), (2100, [0.0] * 24, 0, ""), (2200, [float("nan")] * 24, 0, ""), (2300, [None] * 24, 0, ""), (None, rows[0][1], 0, ""), (2400, [], 0, ""), rows[5], rows[100]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, rank string")
    got = ann.nearest(df).collect()
    hits = n = 0
    for q in range(0, 1500, 100):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(r.vec_id != q for r in own)
        d = np.sqrt(((points - points[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        assert all(math.isclose(r.score, d[r.vec_id], abs_tol=1e-9) for r in own)
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        hits, n = hits + len({r.vec_id for r in own} & set(best.tolist())), n + 10
        if 300 <= q < 700:
            assert [r.vec_id for r in own] == [i for i in [200, *range(300, 320)] if i != q][:10]
    assert len(got) == 150 and hits >= 0.9 * n
    few = ann.nearest(df.where("vec_id < 4"), tables=1, axes=3, probes=1).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == [int(i) for i in np.lexsort((np.arange(1, 4), np.sqrt(((points[1:4] - points[0]) ** 2).sum(1)))) + 1]
    assert ann.nearest(df.limit(0)).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    alive = {d[0] for d in corpus() if any(c.isalpha() for c in d[1] or "")}
    assert {r.doc_id for r in rows} <= alive and len({r.doc_id for r in rows}) > 60
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, step = step, stage(spark, step, str(tmp_path))
        assert step.columns == before.columns
