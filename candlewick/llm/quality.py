"""Quality rules (operator 3): line-first cleaning.

Each line of a text is held against three rules, and failing lines are removed:

* punctuation: the line must end in terminal punctuation, not hold 3 or more symbol characters at a rate above 3 for 10
  words, and not have a doubled exclamation mark after every fifth word or more;
* navigation: separators (``|``, ``»``, ``•``, ``·``) at least twice and for a quarter of the words or more;
* boilerplate: the line holds a phrase of the list.

A document is rejected if more than ``lost`` percent of its characters in words stood in removed lines, or if it fails a
base rule: fewer than 50 words, or more than half of its words in repeated three-word windows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from candlewick.llm.bytehash import batch_word_hashes, mix
from candlewick.llm.common import as_bytes, map_slices, texts_of

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
# Sentence ends of Unicode (Latin, Arabic, Devanagari, CJK, Ethiopic, Khmer, Myanmar), and what closes after them.
TERMINAL = ".!?…:;\"'”’»)" + "؟۔।॥。！？｡．…：；」』）】።፧፨។៕။"
SEPARATORS = "|»•·"
PHRASES = ("all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy", "sign up for", "subscribe to", "terms of service", "terms of use", "this work is licensed", "use of cookies")
_any_phrase = re.compile("|".join(map(re.escape, PHRASES)))
_to_lower = {c: c + 32 for c in range(65, 91)}
_no_blanks = dict.fromkeys(map(ord, BLANKS))
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_bad_lines", "lost_chars", "kept"]


def line_fails(line: str) -> bool:
    """Whether a line with a word fails a rule."""
    body = line.strip(BLANKS)
    words = len(body.encode().split())
    if body[-1] not in TERMINAL or (3 <= (marks := sum(map(body.count, SYMBOLS))) and 10 * marks > 3 * words):
        return True
    if (shouts := body.count("!!")) >= 3 and 5 * shouts >= words:
        return True
    if (bars := sum(map(body.count, SEPARATORS))) >= 2 and 4 * bars >= words:
        return True
    return _any_phrase.search(body.translate(_to_lower)) is not None


def repeat_words(words: np.ndarray) -> int:
    """Words in three-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    a, b, c = (mix(words, i) for i in range(3))
    grams = a[:-2] + b[1:-1] * np.uint64(3) + c[2:] * np.uint64(5)
    _, inverse, count = np.unique(grams, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[inverse] > 1)
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[again + i] = True
    return int(covered.sum())


def measure(text: str, words: np.ndarray, lost: int = 40) -> tuple[tuple, list[str]]:
    """FIELDS of a text, and its lines that pass."""
    lines, seen, passed = text.split("\n"), set(), []
    n_lines = n_dup = n_bad = lost_chars = 0
    for line in lines:
        size = len(line.translate(_no_blanks))
        if not size:
            passed.append(line)
            continue
        n_lines += 1
        n_dup += line in seen
        seen.add(line)
        if line_fails(line):
            n_bad += 1
            lost_chars += size
        else:
            passed.append(line)
    n, chars, repeats = len(words), len(text.translate(_no_blanks)), repeat_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    return (n, chars, sum(map(text.count, SYMBOLS)), n_dup, repeats, failed, n_lines, n_bad, lost_chars, not failed and 100 * lost_chars <= lost * chars), passed


def clean_lines(docs: DataFrame, lost: int = 40, text: bool = True) -> DataFrame:
    """doc_id, the text without its failing lines (unless text=False), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_lines (with a word), n_bad_lines, lost_chars, kept; a row for each row of docs.

    All counts are of the text as given.  A null text counts as empty, stays null, and fails for having few words.  Lines
    without a word stay.  A null doc_id is kept as it is.  Repeated rows each get their row.  Other columns are ignored.
    """
    kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 3 + [pa.bool_()]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        rows, left = [], []
        for whole, words, given in zip(texts, batch_word_hashes(texts, lower=False), batch.column("text"), strict=True):
            fields, passed = measure(whole.decode("utf-8", "replace"), words, lost)
            rows.append(fields)
            left.append("\n".join(passed) if given.is_valid else None)
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        cleaned = [pa.array(left, pa.string())] if text else []
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cleaned, *columns], ["doc_id", *["text"] * text, *FIELDS])

    types = ", ".join(f"{f} {'boolean' if k == pa.bool_() else 'long'}" for f, k in zip(FIELDS, kinds, strict=True))
    return map_slices(as_bytes(docs), "text", step, f"doc_id long, {'text string, ' * text}{types}")


def oracle(lost: int = 40) -> str:
    """The same in DuckDB's SQL, without the text."""
    blank, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
    symbols, bars = "[#*$%&|<>]", "[|»•·]"
    ends = "[" + TERMINAL.replace("'", "''") + "]" + blank + "*$"
    phrases = "|".join(PHRASES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, unnest(regexp_extract_all(text, '{word}')) AS w, generate_subscripts(regexp_extract_all(text, '{word}'), 1) AS i FROM d),
g AS (SELECT k, i, w, lead(w, 1) OVER s AS w1, lead(w, 2) OVER s AS w2 FROM w WINDOW s AS (PARTITION BY k ORDER BY i)),
t AS (SELECT k, i, count(*) OVER (PARTITION BY k, w, w1, w2) AS c FROM g WHERE w2 IS NOT NULL),
r AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM t WHERE c > 1) GROUP BY k),
l0 AS (SELECT k, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
l1 AS (SELECT k, i, l, len(regexp_replace(l, '{blank}+', '', 'g')) AS size, len(regexp_extract_all(l, '{word}')) AS n,
  len(regexp_extract_all(l, '{symbols}')) AS sym, len(regexp_extract_all(l, '!!')) AS shouts, len(regexp_extract_all(l, '{bars}')) AS bars,
  row_number() OVER (PARTITION BY k, l ORDER BY i) AS again FROM l0 WHERE regexp_matches(l, '{word}')),
l AS (SELECT *, NOT regexp_matches(l, '{ends}') OR (sym >= 3 AND 10 * sym > 3 * n) OR (shouts >= 3 AND 5 * shouts >= n) OR (bars >= 2 AND 4 * bars >= n)
  OR regexp_matches(lower(l), '{phrases}') AS bad FROM l1),
s AS (SELECT k, count(*) AS n_lines, sum(n) AS n_words, sum(size) AS word_chars, sum((again > 1)::INT) AS n_dup_lines, sum(bad::INT) AS n_bad_lines,
  sum(CASE WHEN bad THEN size ELSE 0 END) AS lost_chars FROM l GROUP BY k),
a AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '{symbols}'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_bad_lines, 0)::BIGINT AS n_bad_lines,
  coalesce(lost_chars, 0)::BIGINT AS lost_chars FROM d LEFT JOIN s USING (k) LEFT JOIN r USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND 100 * lost_chars <= {lost} * word_chars AS kept FROM b"""
