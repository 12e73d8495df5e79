"""Sampled suffixes of texts: which suffixes a sparse suffix array holds, and the windows each stands for.

A window is ``width`` bytes.  Of the ``width - gram + 1`` byte grams in it, the one with the smallest hash (leftmost on
ties) is its anchor.  Equal windows have their anchor at the same place, so two texts share a window exactly if a suffix
that starts at an anchor of each agrees on the gram, and the bytes around both agree too.  Consecutive windows mostly
have the same anchor and are kept as one run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from candlewick.llm.bytehash import PIECE, grouped, prefix_sums, quick_hashes, span_hashes


SMALL = 1 << 16  # texts are joined up to this size, so that the arrays stay in the cache


@dataclass
class Runs:
    """Runs of windows with one anchor: text number, first and last window start in the text, hash of the gram at the
    anchor, hash of all bytes the run touches."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    gram: np.ndarray
    region: np.ndarray


def runs(texts: list[bytes], width: int = 200, gram: int = 100) -> Iterator[Runs]:
    for a, b in grouped([len(t) for t in texts], SMALL):
        if b == a + 1:
            for at in range(0, max(1, len(texts[a]) - width + 1), SMALL):
                piece = texts[a][at : at + SMALL + width - 1]
                yield from _runs([piece], a, at, width, gram)
        else:
            yield from _runs(texts[a:b], a, 0, width, gram)


def window_hashes(body: bytes, width: int) -> np.ndarray:
    """A hash of each window of a text."""
    buf = np.frombuffer(body, np.uint8)
    at = np.arange(max(0, len(buf) - width + 1))
    return span_hashes(prefix_sums(buf), at, at + width, 2)


def _runs(texts: list[bytes], number: int, shift: int, width: int, gram: int) -> Iterator[Runs]:
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buf) - width + 1
    if n <= 0:
        return
    sums = prefix_sums(buf)
    at = np.arange(len(buf) - gram + 1)
    low = np.uint64(PIECE - 1)
    best = (quick_hashes(buf, gram) & ~low) | at.astype(np.uint64)  # only chooses places
    span, have = width - gram + 1, 1
    while have < span:  # sliding minimum over `span` places by doubling
        step = min(have, span - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    anchor = (best & low).astype(np.int64)
    ends = np.cumsum([len(t) for t in texts])
    text = np.searchsorted(ends, np.arange(n), "right")
    good = np.arange(n) + width <= ends[text]
    anchor = np.where(good, anchor, -1)
    turn = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(text) != 0)) + 1
    first = np.concatenate([[0], turn])
    last = np.concatenate([turn, [n]]) - 1
    keep = anchor[first] >= 0
    first, last = first[keep], last[keep]
    place = anchor[first]
    start = np.concatenate([[0], ends[:-1]])[text[first]]
    region = span_hashes(sums, first, last + width, 1) + (place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    yield Runs(text[first] + number, first - start + shift, last - start + shift, span_hashes(sums, place, place + gram), region)
