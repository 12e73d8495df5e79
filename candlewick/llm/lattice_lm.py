"""Language-model scores (operator 7): marginal likelihood of a text over all its subword segmentations.

A text is the sequence of its words (A-Z lower-cased), each with the blank mark before it, and an end.  Pieces are drawn
independently; the probability of a word is the sum over all its segmentations, computed in log space by a recursion over
its lattice.  The piece probabilities start from the scores of an existing vocabulary and are re-estimated once from the
training texts by the expected number of uses of each piece (one EM step; the vocabulary stays as it is).

All of it happens once for each distinct word; documents get the sums over their words by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.bytehash import grouped
from candlewick.llm.common import fold, scratch, slices, stored
from candlewick.llm.lattice import SPACE, Vocabulary, lattices, vocabulary
from candlewick.llm.wordsums import document_sums, word_counts

CHARACTERS = 1 << 18  # in one batch of lattices
FLOOR = 0.01  # expected uses that each piece has before any training text


def words(text: bytes) -> list[bytes]:
    """Runs of bytes other than 9-13 and 32; A-Z lower-cased."""
    return text.lower().split()


def _units(found: list[bytes]) -> list[str]:
    return [SPACE + w.decode("utf-8", "replace").replace("\n", " ") for w in found]


def expected_uses(units: list[str], counts: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """For each piece, the expected number of uses in units that occur `counts` times."""
    lattice = lattices(units, vocab)
    ahead, behind = lattice.from_start(), lattice.from_end()
    size = np.diff(np.append(lattice.start, len(lattice.left)))
    owner = np.repeat(np.arange(len(units)), size)[lattice.node]
    share = np.exp(np.minimum(ahead[lattice.node] + lattice.weight + behind[lattice.target] - behind[lattice.start][owner], 0.0)) * counts[owner]
    whole = lattice.piece >= 0
    uses = np.bincount(lattice.piece[whole], share[whole], len(vocab.pieces))
    for c in np.unique(lattice.piece[~whole]):
        n = share[lattice.piece == c].sum()
        for byte in chr(-1 - c).encode("utf-8", "surrogatepass"):
            uses[vocab.byte0 + byte] += n
    return uses


def relearn(table: DataFrame, ends: int, vocab_path: str) -> tuple[np.ndarray, float]:
    """Log probabilities of pieces and of the end, from training words (word, n_learned) and the number of training texts.

    A row for each piece of the vocabulary, no more, reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        uses = np.zeros(len(vocab.pieces))
        for batch in slices(batches, "word"):
            units, counts = _units(batch.column("word").to_pylist()), batch.column("n_learned").to_numpy().astype(np.float64)
            for a, b in grouped([len(u) for u in units], CHARACTERS):
                uses += expected_uses(units[a:b], counts[a:b], vocab)
        used = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(uses[used])], ["piece", "uses"])

    rows = table.where("n_learned > 0").select("word", "n_learned").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
    vocab = vocabulary(vocab_path)
    uses = np.where(np.isneginf(vocab.weights), 0.0, FLOOR)
    for row in rows:
        uses[row.piece] += row.uses
    total = uses.sum() + ends + FLOOR
    with np.errstate(divide="ignore"):
        return np.log(uses / total), float(np.log((ends + FLOOR) / total))


def scores(docs: DataFrame, model: str, learn: Column | None = None, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row for each row of docs.

    Tokens are the words and one end.  Learned from are the rows where `learn` holds (default: those whose
    crc32(doc_id) % 5 is not 1; a null doc_id is never held out).  base_score is the sum over tokens of
    log10((c + 0.5) / (N + 0.5 (V + 1))); score is the lattice model's log10 probability of the text and its end.  A null or
    empty text is an end alone.  Repeated rows each count and get their row.  Other columns are ignored.
    """
    held_out = fold(1) if held_out is None else held_out
    learn = ~held_out if learn is None else learn
    with scratch(docs.sparkSession) as keep:
        return keep(_scores(docs, model, learn, held_out), "lm-scores")


def _scores(docs: DataFrame, model: str, learn: Column, held_out: Column) -> DataFrame:
    counted = stored(word_counts(docs, words, learn), "words")
    ends = docs.where(learn).count()
    known = counted.agg(F.coalesce(F.sum("n_learned"), F.lit(0)), F.count(F.when(F.col("n_learned") > 0, 1))).first()
    total, distinct = known[0] + ends, known[1] + (ends > 0)
    weights, log_end = relearn(counted, ends, model)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model).with_weights(shared.value)
        for batch in slices(batches, "word"):
            units = _units(batch.column("word").to_pylist())
            logs = [lattices(units[a:b], vocab).unit_logs() for a, b in grouped([len(u) for u in units], CHARACTERS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(logs) / np.log(10))], ["word", "n", "n_learned", "score"])

    base = F.log10((F.col("n_learned") + 0.5) / (total + 0.5 * (distinct + 1)))
    scored = counted.mapInArrow(run, "word binary, n long, n_learned long, score double")
    scored = stored(scored.select("word", "n", (F.col("n_learned") > 0).cast("long").alias("n_known"), base.alias("base_score"), "score"), "scores")
    sums = document_sums(docs, words, scored, ["n_known", "base_score", "score"])
    end_base = float(np.log10((ends + 0.5) / (total + 0.5 * (distinct + 1))))
    return sums.select(
        "doc_id", held_out.alias("held_out"), (F.col("n_words") + 1).alias("n_tokens"), (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + end_base).alias("base_score"), (F.col("score") + log_end / float(np.log(10))).alias("score"),
    )
