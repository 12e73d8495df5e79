"""Cross-tokenizer alignment (operator 11): which tokens of two tokenizers overlap, by windows between whitespace-token anchors.

A text is encoded whole by both tokenizers.  Where both have a token end and the next token of each begins with a space, the text
is cut: such a shared end is an anchor.  Between two anchors lies a window, in plain prose a word; its alignment depends on the
token ids inside alone, so it is worked out once for each distinct pair of id tuples and then looked up.

Corpus-wide link counts are sums over the distinct id pairs of documents.  The most frequent pairs (a fixed number) are looked up
where a document is read; the rest meet their counts in a shuffle join.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from candlewick.llm.common import as_bytes, scratch, slices, stored, texts_of
from candlewick.llm.token_counts import byte_letters
from candlewick.llm.wordsums import frequent

#: Bytes of text that are aligned at once, and windows that a task remembers.
PART, MEMO = 1 << 20, 1 << 18
#: Pairs whose counts are sent to the tasks: a fixed bound, some 5 MB.
HOT = 1 << 18
LONG_BLANK = re.compile(r"\s{1000}")
Ids = np.ndarray


class Pair:
    """Both tokenizers, and for each of their ids its bytes, their number, and whether they begin with a space."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        with open(byte_level, encoding="utf-8") as file:
            spec = json.load(file)
        value = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"] for t in spec["added_tokens"]}
        a = {i: bytes(value[c] for c in w) for w, i in spec["model"]["vocab"].items() if w not in special}
        # the same vocabulary as ranks, for the quicker library: an id is the place of its merge
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.quick = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks={w: i for i, w in a.items()}, special_tokens={})
        self.slow = Tokenizer.from_file(byte_level)
        self.slow.encode_special_tokens = True
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        b = {i: self._piece(i) for i in range(self.model.get_piece_size())}
        self.bytes_a, self.bytes_b = ([of.get(i, b"") for i in range(max(of) + 1)] for of in (a, b))
        self.size_a, self.size_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.space_a, self.space_b = (np.array([w[:1] == b" " for w in x]) for x in (self.bytes_a, self.bytes_b))

    def _piece(self, i: int) -> bytes:
        name = self.model.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode()

    def encode(self, texts: list[bytes]) -> list[tuple[Ids, Ids] | None]:
        """The ids of each text by both; None where the text is empty or either does not give back a space and the text."""
        read = [t.decode("utf-8", "replace") for t in texts]
        of_b = iter(self.model.encode([r for r in read if r], num_threads=1))
        out: list[tuple[Ids, Ids] | None] = []
        for text, whole in zip(texts, read, strict=True):
            if not whole:
                out.append(None)
                continue
            # the quick library's pattern recurses over long white space
            a = self.slow.encode(" " + whole, add_special_tokens=False).ids if LONG_BLANK.search(whole) else self.quick.encode_ordinary(" " + whole)
            b = next(of_b)
            same = all(b"".join(map(names.__getitem__, ids)) == b" " + text for names, ids in ((self.bytes_a, a), (self.bytes_b, b)))
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if same else None)
        return out


@functools.cache
def pair(byte_level: str, pieces: str) -> Pair:
    """Loaded once in each Python worker."""
    return Pair(byte_level, pieces)


def strings() -> list[bytes]:
    """How an id is written: as A's inside and at the end of a group's list, then as B's."""
    return [b"%d%s" % (i, mark) for mark in (b",", b"|", b",", b";") for i in range(1 << 16)]


Window = tuple[bytes, bytes, int]


class Aligner:
    """Aligns encoded texts window by window; remembers windows by their id tuples."""

    def __init__(self, of: Pair) -> None:
        self.of, self.written = of, strings()
        self.lengths = np.array([*map(len, self.written)])
        self.memo: dict[tuple[bytes, bytes], Window | int] = {}

    def ends(self, a: Ids, b: Ids) -> tuple[np.ndarray, np.ndarray]:
        """The byte offsets at which a token of either ends, ascending, and for each 1 (of A), 2 (of B) or 3 (of both)."""
        end_a, end_b = np.cumsum(self.of.size_a[a]), np.cumsum(self.of.size_b[b])
        kind = np.zeros(int(end_a[-1]) + 1, np.int8)
        kind[end_a] = 1
        kind[end_b] += 2
        at = np.flatnonzero(kind)
        return at, kind[at]

    def anchors(self, a: Ids, b: Ids) -> tuple[np.ndarray, np.ndarray]:
        """Where windows begin in a and in b: at 0, and after shared ends before tokens that begin with a space."""
        _, kind = self.ends(a, b)
        after_a, after_b = kind[(kind & 1) > 0][:-1] == 3, kind[kind > 1][:-1] == 3
        return np.append(0, np.flatnonzero(after_a & self.of.space_a[a[1:]]) + 1), np.append(0, np.flatnonzero(after_b & self.of.space_b[b[1:]]) + 1)

    def windows(self, keys: list[tuple[bytes, bytes]]) -> list[Window]:
        """For each window, given by its id tuples: its groups as text, its links (A id * 65536 + B id, 4 bytes each) and the
        number of its groups.  All in one go: laid end to end, windows have their ends at the same places in both."""
        a, b = (np.frombuffer(b"".join(k[side] for k in keys), "<u2").astype(np.int64) for side in (0, 1))
        at, kind = self.ends(a, b)
        of_a, of_b, shared = (kind & 1) > 0, kind > 1, kind == 3
        # between two neighbouring ends lies one token of each
        links = (a[np.cumsum(of_a) - of_a] << 16) | b[np.cumsum(of_b) - of_b]
        group = np.cumsum(shared) - shared
        group_a, group_b = group[of_a], group[of_b]
        n = int(shared.sum())
        before = lambda g: np.append(0, np.cumsum(np.bincount(g, minlength=n)))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + before(group_b)[group_a]] = a + (shared[of_a].astype(np.int64) << 16)
        order[np.arange(len(b)) + before(group_a)[group_b + 1]] = b + ((2 + shared[of_b].astype(np.int64)) << 16)
        text = b"".join(map(self.written.__getitem__, order.tolist()))
        # where each window ends: among links, groups, and characters
        tokens = np.cumsum([(len(k[0]) + len(k[1])) // 2 for k in keys])
        last = np.searchsorted(at, np.cumsum(self.of.size_a[a])[np.cumsum([len(k[0]) // 2 for k in keys]) - 1], "right")
        links_at, groups_at, text_at = 4 * last, np.cumsum(shared)[last - 1], np.cumsum(self.lengths[order])[tokens - 1]
        raw, out, i, g, c = links.astype("<u4").tobytes(), [], 0, 0, 0
        for to, upto, end in zip(links_at.tolist(), groups_at.tolist(), text_at.tolist(), strict=True):
            out.append((text[c : end - 1], raw[i:to], upto - g))
            i, g, c = to, upto, end
        return out

    def align(self, texts: list[tuple[Ids, Ids]]) -> list[tuple[bytes, bytes, int]]:
        """Groups as text, links, and number of groups, of each text."""
        if not texts:
            return []
        a, b = np.concatenate([t[0] for t in texts]), np.concatenate([t[1] for t in texts])
        from_a, from_b = self.anchors(a, b)
        raw_a, raw_b = a.astype("<u2").tobytes(), b.astype("<u2").tobytes()
        cuts_a, cuts_b = (2 * from_a).tolist(), (2 * from_b).tolist()
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, found, missing = self.memo, [], []
        for a0, a1, b0, b1 in zip(cuts_a, [*cuts_a[1:], len(raw_a)], cuts_b, [*cuts_b[1:], len(raw_b)], strict=True):
            key = raw_a[a0:a1], raw_b[b0:b1]
            got = memo.get(key)
            if got is None:
                got = memo[key] = len(missing)
                missing.append(key)
            found.append(got)
        if missing:
            fresh = self.windows(missing)
            memo.update(zip(missing, fresh, strict=True))
            found = [fresh[w] if type(w) is int else w for w in found]
        # texts begin with a space, so each begins a window
        first = np.searchsorted(from_a, np.cumsum([0, *(len(t[0]) for t in texts)])).tolist()
        out = []
        for i, j in zip(first, first[1:], strict=False):
            groups, links, n = zip(*found[i:j], strict=True)
            out.append((b";".join(groups), b"".join(links), sum(n)))
        return out


FIELDS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups binary, pairs binary, counts binary"


def aligned(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """For each row of docs: doc_id, n_a, n_b (tokens), n_groups, n_links, groups (`a1,a2|b1;a3|b2`, decimal ids in order), and its
    distinct linked id pairs (A id * 65536 + B id, ascending, 4 bytes each) with how many links hold each (4 bytes each).

    A text that is null, empty, or that either tokenizer does not give back has no tokens: zeros and empty values.  Texts of any
    length are encoded whole.  Other columns are ignored, repeated rows each get their row, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pair(byte_level, pieces)
        aligner = Aligner(of)
        for batch in batches:
            for piece in slices([batch], "text", PART):
                encoded = of.encode(texts_of(piece))
                done = iter(aligner.align([ids for ids in encoded if ids]))
                rows: list[tuple] = []
                for ids in encoded:
                    if ids is None:
                        rows.append((0, 0, 0, 0, b"", b"", b""))
                        continue
                    groups, links, n_groups = next(done)
                    pairs, counts = np.unique(np.frombuffer(links, "<u4"), return_counts=True)
                    rows.append((len(ids[0]), len(ids[1]), n_groups, len(links) // 4, groups, pairs.tobytes(), counts.astype("<u4").tobytes()))
                columns = [pa.array(x, pa.int64() if k < 4 else pa.binary()) for k, x in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns], [f.split()[0] for f in FIELDS.split(", ")])

    return as_bytes(docs).mapInArrow(run, FIELDS)


def numbers(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u4").astype(np.int64)


def link_counts(rows: DataFrame) -> DataFrame:
    """pair, n, best: in how many links of all rows the id pair is, and whether no other pair of its B id is in more.  Summed within
    each task before the shuffle; a task holds distinct pairs only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, total = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in slices(batches, "pairs"):
            each = [(pairs, total)] + [(numbers(p), numbers(c)) for p, c in zip(batch.column("pairs").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
            flat = np.concatenate([x for x, _ in each])
            pairs, at = np.unique(flat, return_inverse=True)
            more = np.zeros(len(pairs), np.int64)
            np.add.at(more, at, np.concatenate([n for _, n in each]))
            total = more
        for i in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + (1 << 16)]), pa.array(total[i : i + (1 << 16)])], ["pair", "n"])

    sums = stored(rows.select("pairs", "counts").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "links")
    b = F.col("pair").bitwiseAND(0xFFFF)
    most = sums.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # 65,536 rows at most
    return stored(sums.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "link-counts")


TOTALS = ("n_a", "n_b", "n_groups", "n_links")


def link_sums(rows: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """For each of the stored rows (with row, its number): doc_id, the counts, groups_sha256, n_best (links whose pair is best) and
    count_sum (the sum of n over links)."""
    top = frequent(counts, hot).toPandas().sort_values("pair")
    known = rows.sparkSession.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))
    names = ["row", "doc_id", *TOTALS, "groups_sha256", "n_best", "count_sum", "pair", "times"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in slices(batches, "pairs"):
            head: list[tuple[int, int]] = []
            rare: list[tuple[int, int, int]] = []
            for row, p, c in zip(*(batch.column(x).to_pylist() for x in ("row", "pairs", "counts")), strict=True):
                ids, times = numbers(p), numbers(c)
                at = np.minimum(np.searchsorted(pairs, ids), len(pairs) - 1) if len(pairs) else np.zeros(len(ids), int)
                hit = pairs[at] == ids if len(pairs) else np.zeros(len(ids), bool)
                at, some = at[hit], times[hit]
                head.append((int(some[best[at]].sum()), int((some * n[at]).sum())))
                rare += zip([row] * int((~hit).sum()), ids[~hit].tolist(), times[~hit].tolist(), strict=True)
            rows = batch.column("row").to_pylist()
            # the row's own number, below zero, in place of a pair: such rows spread over the join
            first = [*(batch.column(x) for x in names[:7]), *(pa.array(x, pa.int64()) for x in zip(*head, strict=True)), pa.array([-1 - r for r in rows], pa.int64()), pa.array([0] * len(rows), pa.int64())]
            yield pa.RecordBatch.from_arrays(first, names)
            if rare:
                r, p, t = (pa.array(x, pa.int64()) for x in zip(*rare, strict=True))
                gap = pa.nulls(len(rare), pa.int64())
                yield pa.RecordBatch.from_arrays([r, gap, *[gap] * 4, pa.nulls(len(rare), pa.string()), gap, gap, p, t], names)

    parts = rows.mapInArrow(look, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pair long, times long")
    met = parts.join(counts, "pair", "left")
    more = {"n_best": F.when(F.col("best"), F.col("times")), "count_sum": F.col("n") * F.col("times")}
    keep = [F.max(c).alias(c) for c in ("doc_id", *TOTALS, "groups_sha256")]
    sums = [F.sum(F.coalesce(c, F.lit(0)) + F.coalesce(v, F.lit(0))).alias(c) for c, v in more.items()]
    return met.groupBy("row").agg(*keep, *sums).drop("row")


def digest(docs: DataFrame, byte_level: str, pieces: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (of the groups as text; '' without tokens), a row for
    each row of docs.  See aligned() for texts without tokens."""
    with scratch(docs.sparkSession) as keep:
        sha = F.when(F.length("groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
        rows = stored(aligned(docs, byte_level, pieces).select(F.monotonically_increasing_id().alias("row"), "doc_id", *TOTALS, sha, "pairs", "counts"), "alignments")
        return keep(link_sums(rows, link_counts(rows), hot), "alignment-sums")
