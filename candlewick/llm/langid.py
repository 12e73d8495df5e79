"""Language identification (operator 4): kernel ridge regression on blended-spectrum n-gram presence kernels.

The kernel of two pieces of text is the number of character n-grams (lengths 1 to ``longest``) present in both, divided by
the geometric mean of the numbers present in each.  Letters count in lower case; any run of other characters is one blank.
N-grams are 64-bit hashes kept as sorted sets, so no number of them fills up a table.  A text is cut into equal pieces of at
most ``PIECE`` characters; its kernel with a landmark is the mean over all its pieces that have a letter, so that a score
does not depend on length.  Nyström landmarks, drawn evenly from the languages, turn the kernel into features; one ridge
regression for each language against the rest gives its score.  Kernel rows are sparse: only n-grams of landmarks are looked
up, each with the list of landmarks that have it.

The sample that is learned from is ``per_language`` labelled texts for each language, by smallest hash of doc_id, and every
language is learned.  Beside it the regression learns two kinds of unlike text as no language: each text with its letters
in random order, and text that shares nothing with any landmark.  So the score of a text of no learned language is near 0,
however many languages are learned.  The driver gets the n-grams of the landmarks and, from each task, sums of products of kernel rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.common import as_bytes, bounded, fold, map_slices, row_key, scratch, slices, small, stored, texts_of

UNKNOWN = "und"
PIECE = 4096  # characters at most in one piece of a text
EACH = 4  # landmarks of each language at least
CHOSEN = 200_000  # keys of the sample that are broadcast at most, some 10 MB
SHORT = 20  # letters: a text with fewer is judged by its alphabet


@functools.cache
def letters() -> np.ndarray:
    """For each code point below 2**16, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def are_letters(points: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter; those above 2**16, mostly few, are asked for once each."""
    out = letters()[np.minimum(points, 0xFFFF).astype(np.intp)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        distinct, inverse = np.unique(points[high], return_inverse=True)
        out[high] = np.array([chr(int(c)).isalpha() for c in distinct])[inverse]
    return out


def pieces(text: bytes) -> Iterator[np.ndarray]:
    """The code points of each piece that has a letter: lower case, a blank for each run of other characters, and at both ends."""
    whole = text.decode("utf-8", "replace").lower()
    k = -(-len(whole) // PIECE)
    for i in range(k):
        points = np.frombuffer((" " + whole[i * len(whole) // k : (i + 1) * len(whole) // k] + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        is_letter = are_letters(points)
        is_letter[[0, -1]] = False
        if is_letter.any():
            yield np.where(is_letter, points, np.uint64(32))[is_letter | np.append(True, is_letter[:-1])]


def drawn_piece(text: bytes) -> np.ndarray | None:
    """One of the pieces of a text, wherever it lies, drawn by the hash of the text; None if it has no letter."""
    every = list(pieces(text))
    return every[zlib.crc32(text) % len(every)] if every else None


def grams(points: np.ndarray, longest: int) -> np.ndarray:
    """The distinct n-grams of a piece, as sorted hashes."""
    found, gram = [], np.zeros(len(points), np.uint64)
    for n in range(1, longest + 1):
        gram = gram[: max(len(points) - n + 1, 0)] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        found.append((gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
    return np.unique(np.concatenate(found))


@dataclass
class Model:
    """The n-grams of the landmarks, for each the landmarks that have it, and a coefficient for each landmark and language."""

    languages: list[str]
    vocabulary: np.ndarray
    starts: np.ndarray
    marks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    longest: int

    @classmethod
    def untrained(cls, languages: list[str], landmarks: list[np.ndarray], longest: int) -> Model:
        sizes = np.array([len(x) for x in landmarks])
        flat, of = np.concatenate(landmarks), np.repeat(np.arange(len(landmarks), dtype=np.int32), sizes)
        order = np.argsort(flat, kind="stable")
        vocabulary, starts = np.unique(flat[order], return_index=True)
        return cls(languages, vocabulary, np.append(starts, len(flat)), of[order], sizes, np.zeros((len(landmarks), len(languages))), np.zeros(len(languages)), longest)

    def row(self, found: np.ndarray) -> np.ndarray:
        """The kernel of one piece, given by its n-grams, with each landmark."""
        at = np.minimum(np.searchsorted(self.vocabulary, found), len(self.vocabulary) - 1)
        at = at[self.vocabulary[at] == found]
        first, many = self.starts[at], self.starts[at + 1] - self.starts[at]
        place = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
        return np.bincount(self.marks[place], minlength=len(self.sizes)) / np.sqrt(len(found) * self.sizes)

    def kernel(self, text: bytes, shuffled: bool = False) -> np.ndarray | None:
        """The mean over the pieces of a text, or of the text with the letters of each piece in random order; None if it has
        no letter."""
        total, n = 0.0, 0
        for points in pieces(text):
            if shuffled:
                points = np.concatenate([points[:1], np.random.default_rng(len(points)).permutation(points[1:-1]), points[-1:]])
            total, n = total + self.row(grams(points, self.longest)), n + 1
        return total / n if n else None

    def short(self, text: bytes) -> bool | None:
        """Whether at least half of the letters of a very short text occur in landmarks; None if the text is not so short."""
        points = np.empty(0, np.uint64)
        for x in pieces(text):
            points = np.append(points, x[x != 32])
            if len(points) >= SHORT:
                return None
        return 2 * sum(bool(np.isin(grams(points[i : i + 1], 1), self.vocabulary)[0]) for i in range(len(points))) >= len(points)

    def scores(self, kernel: np.ndarray) -> np.ndarray:
        return kernel @ self.weights + self.bias


def sample(docs: DataFrame, learn: Column, per_language: int) -> DataFrame:
    """lang, rank, times and text (bytes) of the sample, stored: the first distinct texts with a letter of each language, and how
    many rows each stands for.  Rows are chosen by their keys alone; only the texts of chosen ones are moved."""
    labelled = docs.where(learn).where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}")).withColumn("key", row_key())
    keys = labelled.groupBy("lang", "key").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("times")).withColumn("h", F.xxhash64("doc_id", F.lit(4)))
    # a top-k filter on a window: Spark keeps k rows a language in each task before it shuffles
    first = keys.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "key"))).where(F.col("rank") <= per_language)
    chosen = stored(first.select("lang", "key", "rank", "times"), "language-keys")
    few = labelled.select("lang", "key", F.col("text").cast("binary").alias("text")).join(small(chosen, CHOSEN), ["lang", "key"]).dropDuplicates(["lang", "key"])
    return stored(few.select("lang", "rank", "times", "text"), "languages")


def learned(docs: DataFrame, learn: Column, per_language: int, landmarks: int, ridge: float, longest: int) -> Model | None:
    """Nyström features from the landmarks (a drawn piece of a chosen text each), then ridge regression with targets 1 and -1."""
    with scratch(docs.sparkSession):
        return _learned(docs, learn, per_language, landmarks, ridge, longest)


def _learned(docs: DataFrame, learn: Column, per_language: int, landmarks: int, ridge: float, longest: int) -> Model | None:
    few = sample(docs, learn, per_language)
    names = sorted(r.lang for r in few.select("lang").distinct().collect())

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [grams(p, longest).tobytes() if (p := drawn_piece(t)) is not None else None for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), pa.array(found, pa.binary())], ["lang", "rank", "grams"])

    chosen = few.orderBy("rank", "lang").limit(max(landmarks, EACH * len(names)))
    marks = sorted((r["rank"], r.lang, bytes(r.grams)) for r in map_slices(chosen, "text", first, "lang string, rank int, grams binary").where("grams is not null").collect())
    if not marks:
        return None
    model = Model.untrained(names, [np.frombuffer(m[2], np.uint64) for m in marks], longest)
    shared, place, m = docs.sparkSession.sparkContext.broadcast(model), {name: k for k, name in enumerate(names)}, len(marks)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a task: the sums of x x', x y', x and y over its texts and their unlike ones, x the kernel row and y the target."""
        side, total = shared.value, np.zeros((m + 1, m + 1 + len(names)))
        for batch in slices(batches, "text"):
            x, y = [], []
            weights: list[int] = []
            for lang, times, text in zip(batch.column("lang").to_pylist(), batch.column("times").to_pylist(), texts_of(batch), strict=True):
                if (row := side.kernel(text)) is not None:
                    x.append(np.append(row, 1.0))
                    y.append(np.where(np.arange(len(names)) == place[lang], 1.0, -1.0))
                    x += [np.append(side.kernel(text, shuffled=True), 1.0), np.append(np.zeros(m), 1.0)]
                    y += [np.full(len(names), -1.0)] * 2
                    weights += [times] * 3
            if x:
                total += (np.stack(x).T * weights) @ np.hstack([np.stack(x), np.stack(y)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    total = np.zeros((m + 1, m + 1 + len(names)))
    for r in few.select("lang", "times", "text").mapInArrow(products, "total binary").toLocalIterator():
        total += np.frombuffer(bytes(r.total)).reshape(total.shape)
    return solved(model, total, ridge)


def solved(model: Model, total: np.ndarray, ridge: float) -> Model:
    m = len(model.sizes)
    bounds, vocabulary = model.starts, np.arange(len(model.vocabulary))
    of = np.repeat(vocabulary, np.diff(bounds))
    order = np.argsort(model.marks, kind="stable")
    each = np.split(model.vocabulary[of[order]], np.cumsum(model.sizes)[:-1])
    values, vectors = np.linalg.eigh(np.stack([model.row(x) for x in each]))
    good = values > 1e-9 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    n = total[m, m]
    mean, middle = total[m, :m] / n, total[m, m + 1 :] / n
    square, cross = total[:m, :m] - n * np.outer(mean, mean), total[:m, m + 1 :] - n * np.outer(mean, middle)
    inner = whiten.T @ square @ whiten
    model.weights = whiten @ np.linalg.solve(inner + ridge * np.eye(len(inner)), whiten.T @ cross)
    model.bias = middle - mean @ model.weights
    return model


def identify(docs: DataFrame, learn: Column | None = None, per_language: int = 300, landmarks: int = 240, ridge: float = 0.3, longest: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score, a row for each row of docs.

    Learns from rows where `learn` holds (default: not held out; held out are those with crc32(doc_id) % 5 = 0), lang is
    not null and the text has a letter; of equal rows one is drawn and weighs as many.  score is (1 + the best regression value) / 2 within 0 to 1.  A text that is null
    or has no letter is `und` with score 0, as is every text if nothing can be learned.  Equal values go to the first
    language by name.  A null doc_id is not held out and not learned from.  Repeated rows each get their row.  Other
    columns are ignored.
    """
    learn = (~fold(0) & F.col("doc_id").isNotNull()) if learn is None else learn
    model = learned(docs, learn, per_language, landmarks, ridge, longest)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, best, score in _predicted(batches, shared.value):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return as_bytes(docs, fold(0).alias("held_out")).mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def _predicted(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[tuple[pa.RecordBatch, list[str], list[float]]]:
    for batch in slices(batches, "text"):
        best, score = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
        for i, t in enumerate(texts_of(batch) if model else ()):
            if (kernel := model.kernel(t.encode() if isinstance(t, str) else t)) is not None:
                row = model.scores(kernel)
                k = int(row.argmax())
                best[i], score[i] = model.languages[k], float(np.clip((1 + row[k]) / 2, 0, 1))
        yield batch, best, score


def accepted(docs: DataFrame, least: float = 0.3, per_language: int = 300, landmarks: int = 240, ridge: float = 0.3, longest: int = 3) -> DataFrame:
    """The rows of docs, with all their columns, that are of a learned language: the score is at least `least`.  The same model
    as identify(); rows are decided where they are read, without a shuffle.

    The default lies between the scores of labelled and of unlike text on sf0.1: of 1,960 held-out labelled documents those
    with SHORT letters or more score 0.35 and up; random letters, hex and base64 digits, one letter repeated, shuffled
    English, Finnish, Cyrillic, Greek and Chinese text score 0.22 at most.  A text of fewer than SHORT letters shows too few n-grams for a score.  It stays if at least half of its letters occur in
    a landmark, whatever its score: another script goes, noise in a learned alphabet stays."""
    learn = ~fold(0) & F.col("doc_id").isNotNull()
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, learn, per_language, landmarks, ridge, longest))

    def stays(text: str | None, best: str, score: float) -> bool:
        if best == UNKNOWN:
            return False
        known = shared.value.short(text.encode())
        return score >= least if known is None else known

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, best, score in _predicted(batches, shared.value):
            yield batch.filter(pa.array([*map(stays, batch.column("text").to_pylist(), best, score)], pa.bool_()))

    return bounded(docs).mapInArrow(keep, docs.schema)
