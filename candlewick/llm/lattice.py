"""Segmentation lattices of many short strings at once.

A unit is a string that pieces never cross.  Its lattice has a node before each character and one at the end, and an edge
for each vocabulary piece that matches; a character that is no piece itself has an edge for its UTF-8 bytes.  All lattices
of a batch lie in flat arrays, and sums over paths run over the units in parallel, one character position at a time.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece

SPACE = "▁"
STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Pieces by length: sorted hashes of all their prefixes, the piece id of each prefix that is one (else -1), and where the hashes
    that share their first bits begin."""

    pieces: list[str]
    prefixes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    weights: np.ndarray  # natural log of each piece's probability
    byte0: int  # id of the piece for byte 0

    @functools.cached_property
    def raw(self) -> list[bytes]:
        """What each piece writes."""
        return [bytes([i - self.byte0]) if 0 <= i - self.byte0 < 256 else p.encode() for i, p in enumerate(self.pieces)]

    @functools.cached_property
    def spaced(self) -> pa.Array:
        """What each piece writes, with spaces for blank marks."""
        return pa.array([r.replace(SPACE.encode(), b" ") for r in self.raw], pa.binary())

    def with_weights(self, weights: np.ndarray) -> Vocabulary:
        return Vocabulary(self.pieces, self.prefixes, weights, self.byte0)


def _hash(points: np.ndarray, before: np.ndarray | np.uint64) -> np.ndarray:
    x = (before + points + np.uint64(1)) * STEP
    return x ^ (x >> np.uint64(32))


def _begins(keys: np.ndarray) -> np.ndarray:
    """For all values of the first bits, the first of the sorted keys that has them or higher ones; some two values a key."""
    bits = max(1, len(keys).bit_length() + 1)
    return np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))


def _find(keys: np.ndarray, begins: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Places of the first keys that are not below those sought, the last place at most."""
    last = len(keys) - 1
    at = np.minimum(begins[sought >> np.uint64(65 - len(begins).bit_length())], last)
    going = np.flatnonzero(keys[at] < sought)
    while len(going):
        going = going[at[going] < last]
        at[going] += 1
        going = going[keys[at[going]] < sought[going]]
    return at


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """The pieces of a SentencePiece model.  Its scores fall by one for each piece of the list; a piece's probability is
    taken inversely proportional to 2 minus its score (Zipf's law over the ranks), and byte pieces get the least one."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    byte0 = next(i for i in range(n) if model.is_byte(i))
    rank = np.full(n, np.inf)
    # single characters have no merge; their score is a floor, so they rank after all merges
    scores = np.array([model.get_score(i) for i in plain])
    rank[plain] = 2 - np.maximum(scores, -2.0 * n)
    rank[byte0 : byte0 + 256] = 2.0 * n
    weights = -np.log(rank)
    weights -= np.log(np.exp(weights).sum())
    by_length: list[dict[int, int]] = []
    for i in plain:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for k, c in enumerate(pieces[i]):
                h = _hash(np.uint64(ord(c)), h)
                if k == len(by_length):
                    by_length.append({})
                by_length[k].setdefault(int(h), -1)
        by_length[len(pieces[i]) - 1][int(h)] = i
    prefixes = []
    for found in by_length:
        keys = np.array(sorted(found), np.uint64)
        prefixes.append((keys, np.array([found[int(k)] for k in keys], np.int64), _begins(keys)))
    return Vocabulary(pieces, prefixes, weights, byte0)


@dataclass
class Lattices:
    """start: first node of each unit (end node: the next unit's start minus 1).  Edges are sorted by node: edge_of[node] is
    the node's first edge, edge_of[node + 1] the first after it."""

    start: np.ndarray
    edge_of: np.ndarray
    node: np.ndarray
    target: np.ndarray
    piece: np.ndarray  # id, or -1 - code point for the bytes of a character
    weight: np.ndarray
    left: np.ndarray  # characters from each node to its unit's end

    def from_end(self) -> np.ndarray:
        """For each node, log of the sum over all paths to the end."""
        return self._sums(self.left[self.node], self.node, self.target)

    def from_start(self) -> np.ndarray:
        size = np.diff(np.append(self.start, len(self.left))) - 1
        gone = np.repeat(size, size + 1) - self.left
        return self._sums(gone[self.target], self.target, self.node)

    def _sums(self, depth: np.ndarray, to: np.ndarray, by: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.left))
        if to is not self.node:  # edges are sorted by node already
            first = np.argsort(to, kind="stable")
            depth, to, by, weight = depth[first], to[first], by[first], self.weight[first]
        else:
            weight = self.weight
        most = int(depth.max(initial=0))
        order = np.argsort(depth.astype(np.uint16) if most < 1 << 16 else depth, kind="stable")  # short integers sort by radix
        cuts = np.append(0, np.cumsum(np.bincount(depth, minlength=most + 1)))[1:]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            e = order[a:b]
            value, nodes = weight[e] + total[by[e]], to[e]
            first = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
            top = np.maximum.reduceat(value, first)
            size = np.diff(np.append(first, len(e)))
            total[nodes[first]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, size)), first))
        return total

    def unit_logs(self) -> np.ndarray:
        return self.from_end()[self.start]


def bytes_of(points: np.ndarray) -> np.ndarray:
    """The number of UTF-8 bytes of code points."""
    return 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)


def lattices(units: list[str], vocab: Vocabulary) -> Lattices:
    """The lattices of non-empty units."""
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    return point_lattices(points, np.array([len(u) for u in units], np.int64), vocab)


def point_lattices(points: np.ndarray, size: np.ndarray, vocab: Vocabulary) -> Lattices:
    """The lattices of non-empty units: their code points, one unit after the other, and how many each has."""
    points = points.astype(np.uint64)
    unit = np.repeat(np.arange(len(size)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(points))
    froms, ids = [], []
    alive, h = np.arange(len(points)), np.zeros(len(points), np.uint64)
    for n, (keys, found, begins) in enumerate(vocab.prefixes, 1):
        room = left[alive] >= n
        alive, h = alive[room], h[room]
        h = _hash(points[alive + n - 1], h)
        at = _find(keys, begins, h)
        same = keys[at] == h
        alive, h, at = alive[same], h[same], at[same]
        if not len(alive):
            break
        whole = found[at] >= 0
        froms.append(alive[whole])
        ids.append(found[at][whole])
        if n == 1:
            lone = np.ones(len(points), bool)
            lone[froms[0]] = False
            bare = np.flatnonzero(lone)
    if not froms:
        bare = np.arange(len(points))
    froms.append(bare)
    ids.append(-1 - points[bare].astype(np.int64))
    # a place has one edge of each length at most: edges go to their places' next free slots, the shortest first
    free = np.cumsum(edges := sum(np.bincount(f, minlength=len(points)) for f in froms)) - edges
    place = np.repeat(np.arange(len(points)), edges)
    length, piece = np.empty((2, len(place)), np.int64)
    for n, (f, i) in enumerate(zip(froms, ids, strict=True), 1):
        slot = free[f]
        length[slot], piece[slot] = n if n < len(froms) else 1, i
        free[f] += 1
    node = place + unit[place]  # each unit has one node more than characters
    weight = np.where(piece >= 0, vocab.weights[np.maximum(piece, 0)], 0.0)
    raw = np.flatnonzero(piece < 0)
    if len(raw):
        weight[raw] = [sum(vocab.weights[vocab.byte0 + b] for b in chr(c).encode("utf-8", "surrogatepass")) for c in -1 - piece[raw]]
    total = len(points) + len(size)
    start = np.cumsum(np.append(0, size[:-1] + 1))
    edge_of = np.append(0, np.cumsum(np.bincount(node, minlength=total)))
    to_end = np.repeat(start + size, size + 1) - np.arange(total)
    return Lattices(start, edge_of, node, node + length, piece, weight, to_end)


def piece_ids(pieces: np.ndarray, edges: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each edge has, and all ids: one of a piece, the bytes of a character that is none."""
    size = np.where(pieces < 0, bytes_of(np.maximum(-1 - pieces, 0)), 1)
    times, piece = size[edges], pieces[edges]
    out = np.repeat(piece, times)
    raw = np.flatnonzero(piece < 0)
    at, found = (np.cumsum(times) - times)[raw], piece[raw]
    for c in np.unique(found):
        here = at[found == c]
        for k, byte in enumerate(chr(-1 - c).encode("utf-8", "surrogatepass")):
            out[here + k] = vocab.byte0 + byte
    return times, out


def decode(ids: np.ndarray | list[int], vocab: Vocabulary) -> str:
    """The text of piece ids: bytes joined, the blank mark as a space, without the space set before the text."""
    return b"".join(map(vocab.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")[1:]
