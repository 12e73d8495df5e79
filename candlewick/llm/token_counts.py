"""Token counts (operator 10): pieces counted once for each distinct pre-token, then summed over documents.

A text is cut as the tokenizer cuts it: special strings first (one token each), the rest normalised and split into
pre-tokens.  Byte-pair merging never crosses a pre-token, so the number of tokens of a text is the sum over its
pre-tokens of a number that depends on the pre-token alone.  That number is computed once for each distinct pre-token of
the corpus and joined to the pre-token frequencies of each document; token ids are never made.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from candlewick.llm.common import scratch, slices, stored
from candlewick.llm.wordsums import document_sums, word_counts


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as itself, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class WordBpe:
    """Pre-tokens of a tokenizer that lower-cases and drops white space, and the number of pieces of a pre-token."""

    def __init__(self, path: str) -> None:
        self.model = Tokenizer.from_file(path).model
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # Unicode's White_Space; \s of this library has the separators 1C to 1F besides
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.letters = byte_letters()

    def pretokens(self, text: bytes) -> list[bytes]:
        whole = text.decode("utf-8", "replace")
        out: list[str] = []
        at = 0
        for hit in self.special.finditer(whole):
            out += self._cut(whole[at : hit.start()])
            out.append(hit.group())
            at = hit.end()
        out += self._cut(whole[at:] if at else whole)
        return [w.encode() for w in out]

    def _cut(self, text: str) -> list[str]:
        # letter by letter, so without the final form of sigma
        return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def pieces(self, word: bytes) -> int:
        if self.special.fullmatch(word.decode()):
            return 1
        return len(self.model.tokenize("".join(map(self.letters.__getitem__, word))))


@functools.cache
def word_bpe(path: str) -> WordBpe:
    """Loaded once in each Python worker."""
    return WordBpe(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), a row for each row of docs.

    Null and empty texts have no bytes and no tokens.  A null doc_id is kept.  Repeated rows each get their row.  Other
    columns are ignored; an empty table gives an empty table.  A text of any length is cut whole.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for batch in slices(batches, "word"):
            pieces = [bpe.pieces(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], ["word", "n", "n_tokens"])

    def cut(text: bytes) -> list[bytes]:
        return word_bpe(vocabulary).pretokens(text)

    with scratch(docs.sparkSession) as keep:
        words = word_counts(docs, cut).select("word", "n")
        counted = stored(words.mapInArrow(count, "word binary, n long, n_tokens long"), "pretokens")
        sums = document_sums(docs, cut, counted, ["n_tokens"])
        return keep(sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")), "token-counts")
