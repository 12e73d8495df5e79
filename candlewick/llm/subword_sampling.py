"""SentencePiece encoding and decoding (operator 2): distinct sampled segmentations by Gumbel top-k over the lattice.

Each text has a lattice of all its segmentations, each weighing the product of its pieces' probabilities.  Adding a Gumbel
variable to every segmentation's log probability and taking the k largest sums draws k segmentations without replacement.
A* search finds them without listing any others: the largest perturbed value below a lattice node is a Gumbel variable at
the log of the node's total mass, so the search descends from the root by drawing each next piece in proportion to its mass
(the value stays), and at every node that it passes the other edges together hold one truncated Gumbel value, their bound.
The largest open bound is where the next segmentation branches off.

The (k+1)-th value is the threshold of the draw: a segmentation of log probability p has the inclusion score
1 - exp(-exp(p - threshold)), the probability that it exceeds it.

Pieces never cross a blank or a line end, so the lattice of a text is a chain of unit lattices, built once for each
distinct unit of a batch.  Random numbers are hashes of (seed, row key, place), so reruns agree wherever a row is.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from candlewick.llm.bytehash import mix
from candlewick.llm.common import as_bytes, slices, texts_of
from candlewick.llm.lattice import SPACE, Lattices, Vocabulary, decode, piece_ids, point_lattices, vocabulary

SLICE = 1 << 19
#: Units hashed in one go.
PART = 1 << 12
BLANK = ord(SPACE)


def cut_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct units of the texts (their code points, one unit after the other, and how many each has), the unit numbers of all
    texts one after the other, and how many each text has.

    A space is set before a text that is not empty.  A unit is a run of spaces with the run of other characters after it, or
    a line end.  Spaces are blank marks in the units.
    """
    marked = [" " + t.decode("utf-8", "replace") if t else "" for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).copy()
    if not len(points):
        return points, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    lengths = np.array([len(m) for m in marked])
    ends = np.cumsum(lengths)
    points[points == 32] = BLANK
    space, line = points == BLANK, points == 10
    first = line.copy()
    first[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    first[(ends - lengths)[lengths > 0]] = True
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(points)))
    # in parts, so that the arrays stay in the cache
    hashes = np.concatenate([_hashes(points, start[a : a + PART], size[a : a + PART]) for a in range(0, len(start), PART)])
    number = pa.array(hashes).dictionary_encode().indices.to_numpy()
    at = np.empty(int(number.max()) + 1, np.int64)
    at[number[::-1]] = np.arange(len(number))[::-1]  # the first of each stays
    return spans(points, start[at], size[at]), size[at], number, np.diff(np.searchsorted(start, np.append(0, ends)))


def spans(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start : start + size] of all spans, one after the other."""
    return values[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]


def _hashes(points: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of 64-bit hashes of the characters with their places in the unit."""
    begin, end = start[0], start[-1] + size[-1]
    place = np.arange(begin, end) - np.repeat(start, size)
    return np.add.reduceat(mix(points[begin:end].astype(np.uint64) | place.astype(np.uint64) << np.uint64(32)), start - begin)


def uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in (0, 1) for 64-bit keys."""
    return ((mix(keys, seed) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Sampler:
    """Draws paths through the unit lattices of a batch."""

    def __init__(self, lattice: Lattices) -> None:
        self.lattice = lattice
        mass = lattice.from_end()
        self.log_p = np.minimum(lattice.weight + mass[lattice.target] - mass[lattice.node], 0.0)
        p = np.exp(self.log_p)
        total = np.cumsum(p)
        first = lattice.edge_of[lattice.node]
        self.cumulative = total - (total - p)[first]
        self.cumulative[lattice.edge_of[1:][np.diff(lattice.edge_of) > 0] - 1] = 2.0  # the last edge takes what is left

    def log_rest(self, edges: np.ndarray) -> np.ndarray:
        """Log of what the other edges of each edge's node have together."""
        log_p = self.log_p[edges]
        with np.errstate(divide="ignore"):
            return np.where(log_p < -1e-12, np.log(-np.expm1(log_p)), -np.inf)

    def paths(self, nodes: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a drawn path from each node to its unit's end, one after the other, and the start each belongs to."""
        edges, owners, active, step = [], [], np.arange(len(nodes)), 0
        active = active[self.lattice.left[nodes] > 0]
        at = nodes[active]
        while len(active):
            u = uniform(keys[active] + np.uint64(step * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF), seed)
            edge = self.lattice.edge_of[at]
            going = np.flatnonzero(u > self.cumulative[edge])
            while len(going):
                edge[going] += 1
                going = going[u[going] > self.cumulative[edge[going]]]
            edges.append(edge)
            owners.append(active)
            at = self.lattice.target[edge]
            more = self.lattice.left[at] > 0
            active, at, step = active[more], at[more], step + 1
        if not edges:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        size = np.zeros(len(nodes), np.int64)
        for step, own in enumerate(owners, 1):
            size[own] = step
        begin = np.cumsum(size) - size
        out = np.empty(size.sum(), np.int64)
        for step, (edge, own) in enumerate(zip(edges, owners, strict=True)):
            out[begin[own] + step] = edge
        return out, np.repeat(np.arange(len(nodes)), size)


def truncated(free: float, bound: float) -> float:
    """The Gumbel variable `free` given that it is below `bound`: its truncation keeps the order of variables."""
    return min(free, bound) - math.log1p(math.exp(-abs(free - bound))) if free > -math.inf else free


class Search:
    """The k best perturbed segmentations of one text: its units, found paths, and the open bounds."""

    def __init__(self, occurrences: np.ndarray, key: int, k: int, seed: int) -> None:
        self.occurrences, self.key, self.k, self.seed = occurrences, key, k, seed
        self.found: list[tuple[np.ndarray, float, float]] = []  # edges, log probability, perturbed value
        self.open: list[tuple[float, int, int, int, tuple[int, ...]]] = []  # -bound, draw number, path, step, edges taken

    def add(self, edges: np.ndarray, fresh: int, value: float, log_p: float, free: np.ndarray) -> None:
        """Records a found path whose edges from `fresh` on are new.  free: at each new edge, a Gumbel variable at the mass of
        all that branches off there."""
        number = len(self.found)
        self.found.append((edges, log_p, value))
        most = self.k - number  # so many more can be taken from here, the threshold included
        if most == 1 and len(free):
            top = [int(free.argmax())]
        else:
            top = np.argpartition(-free, most)[:most].tolist() if len(free) > most else range(len(free))
        for i in top:
            if free[i] > -np.inf:
                heapq.heappush(self.open, (-truncated(float(free[i]), value), len(self.open) + 1000 * number, number, fresh + i, (int(edges[fresh + i]),)))

    def branch(self, sampler: Sampler) -> tuple[np.ndarray, int, int, float] | None:
        """Takes the largest bound: the edges up to and with the branch, the unit it is in, the next node, the value."""
        if not self.open:
            return None
        bound, draw, path, step, taken = heapq.heappop(self.open)
        edges = self.found[path][0]
        lattice = sampler.lattice
        node = lattice.node[edges[step]]
        others = np.array([e for e in range(lattice.edge_of[node], lattice.edge_of[node + 1]) if e not in taken], np.int64)
        mass = np.exp(sampler.log_p[others])
        spot = np.uint64((self.key + 0x9E3779B9 * draw + 31 * step) & 0xFFFFFFFFFFFFFFFF)
        u = uniform(np.array([spot, spot + np.uint64(1)]), self.seed + 104729)
        pick = int(others[min(int(np.searchsorted(np.cumsum(mass), u[0] * mass.sum())), len(others) - 1)])
        if len(others) > 1:
            left = mass.sum() - np.exp(sampler.log_p[pick])
            free = sampler.log_p[edges[:step]].sum() + math.log(max(left, 1e-300)) - math.log(-math.log(u[1]))
            heapq.heappush(self.open, (-truncated(free, -bound), draw + 500_000_000, path, step, (*taken, pick)))
        done = int((lattice.left[lattice.target[edges[:step]]] == 0).sum())  # units before this one
        return np.append(edges[:step], pick), done, int(lattice.target[pick]), -bound

    def threshold(self) -> float:
        return -self.open[0][0] if self.open else -np.inf


def sample_batch(texts: list[bytes], keys: list[int], vocab: Vocabulary, k: int, seed: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text, up to k (piece ids, log probability, inclusion score), the largest perturbed value first."""
    points, size, numbers, counts = cut_units(texts)
    if not len(numbers):
        return [[(np.empty(0, np.int64), 0.0, 1.0)] for _ in texts]
    sampler = Sampler(point_lattices(points, size, vocab))
    start = sampler.lattice.start
    wrapped = [key & 0xFFFFFFFFFFFFFFFF for key in keys]
    searches = [Search(o, key, k, seed) for o, key in zip(np.split(numbers, np.cumsum(counts)[:-1]), wrapped, strict=True)]
    gumbel = -np.log(-np.log(uniform(np.array(wrapped, np.uint64), seed + 1)))
    todo = [(i, np.empty(0, np.int64), 0, -1, gumbel[i]) for i, s in enumerate(searches) if len(s.occurrences)]
    for draw in range(k):
        nodes, places, counts = [], [], []
        for i, _, done, node, _ in todo:
            s = searches[i]
            tail = start[s.occurrences[done + (node >= 0) :]]
            nodes.append(np.append(node, tail) if node >= 0 else tail)
            places.append(np.arange(len(s.occurrences) - len(nodes[-1]), len(s.occurrences), dtype=np.uint64))
            counts.append(len(nodes[-1]))
        if not todo:
            break
        own = np.array([searches[i].key for i, *_ in todo], np.uint64)
        marks = mix(np.concatenate(places) * np.uint64(0xE7037ED1A0B428DB) + np.repeat(own, counts), seed + draw)
        edges, owner = sampler.paths(np.concatenate(nodes), marks, seed + 31 * draw)
        ends = np.searchsorted(owner, np.cumsum(counts))
        begins = np.append(0, ends[:-1])
        # at every new edge, a Gumbel variable at the mass of all that branches off there
        log_p, size = sampler.log_p[edges], ends - begins
        total = np.append(0.0, np.cumsum(log_p))
        known = np.array([sampler.log_p[prefix].sum() for _, prefix, *_ in todo])
        before = total[:-1] + np.repeat(known - total[begins], size)
        place = np.arange(len(edges)) + np.repeat(np.array([len(prefix) for _, prefix, *_ in todo]) - begins, size)
        u = uniform(place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.repeat(own, size), seed + 7919 * (draw + 1))
        free = before + sampler.log_rest(edges) - np.log(-np.log(u))
        whole = known + total[ends] - total[begins]
        for n, (i, prefix, _, _, value) in enumerate(todo):
            new = slice(begins[n], ends[n])
            # the branching edge is new itself, but its node's bound is open already
            searches[i].add(np.concatenate([prefix, edges[new]]), len(prefix), value, float(whole[n]), free[new])
        if draw + 1 < k:
            todo = [(i, *b) for i, s in enumerate(searches) if len(s.found) == draw + 1 and (b := s.branch(sampler)) is not None]
    paths = [e for s in searches for e, _, _ in s.found]
    times, ids = piece_ids(sampler.lattice.piece, np.concatenate(paths), vocab)
    ends = np.cumsum(np.add.reduceat(times, np.cumsum([0, *map(len, paths[:-1])])))
    ids_of = iter(np.split(ids, ends[:-1]))
    out = []
    for s in searches:
        limit = s.threshold()
        rows = [(next(ids_of), p, float(-np.expm1(-np.exp(min(p - limit, 700.0))))) for _, p, _ in s.found]
        out.append(rows or [(np.empty(0, np.int64), 0.0, 1.0)])
    return out


def comes_back(texts: list[bytes], encodings: list[list[np.ndarray]], vocab: Vocabulary) -> list[bool]:
    """For each encoding of each text, whether its ids, decoded, are the text.  What all ids write is joined in one step; where its
    bytes are not the text's (as in a text that is not UTF-8), the decoded characters are compared."""
    each = [ids for rows in encodings for ids in rows]
    written = vocab.spaced.take(pa.array(np.concatenate(each)))
    ends = np.frombuffer(written.buffers()[1], np.int32, len(written) + 1)[np.cumsum([0, *map(len, each)])].tolist()
    data = written.buffers()[2].to_pybytes() if ends[-1] else b""
    row, out = 0, []
    for text, rows in zip(texts, encodings, strict=True):
        due = b" " + text.replace(SPACE.encode(), b" ") if text else b""
        for ids in rows:
            out.append(data[ends[row] : ends[row + 1]] == due or decode(ids.tolist(), vocab) == text.decode("utf-8", "replace").replace(SPACE, " "))
            row += 1
    return out


def sample_encodings(docs: DataFrame, model: str, k: int = 2, seed: int = 0, check: bool = False) -> DataFrame:
    """doc_id, rank (from 1), n_pieces, log_prob, inclusion, ids: up to k distinct segmentations of each row's whole text.

    log_prob is the natural log of the segmentation's share of all segmentations.  Fewer than k rows come from a text with
    fewer segmentations.  A null or empty text has one row without pieces, probability and inclusion 1.  A null doc_id is
    kept; repeated rows give equal rows each.  Other columns are ignored.  decoded() gives the text back, except that the
    blank mark U+2581 comes back as a space, as with the library; with check=True a column round_trip says of each row
    whether its ids, decoded, are that text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in slices(batches, "text", SLICE):
            drawn = sample_batch(texts_of(batch), batch.column("doc_key").to_pylist(), vocab, k, seed)
            flat = [(doc, r, *row) for doc, rows in zip(batch.column("doc_id").to_pylist(), drawn, strict=True) for r, row in enumerate(rows, 1)]
            doc, rank, ids, log_p, score = zip(*flat, strict=True)
            size = [len(x) for x in ids]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *size]), pa.array(np.concatenate(ids).astype(np.int32), pa.int32()))
            columns = [pa.array(doc, pa.int64()), pa.array(rank, pa.int32()), pa.array(size, pa.int64()), pa.array(log_p, pa.float64()), pa.array(score, pa.float64()), lists.cast(pa.list_(pa.int32()))]
            if check:
                columns.append(pa.array(comes_back(texts_of(batch), [[row[0] for row in rows] for rows in drawn], vocab)))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "rank", "n_pieces", "log_prob", "inclusion", "ids", *["round_trip"] * check]
    schema = "doc_id long, rank int, n_pieces long, log_prob double, inclusion double, ids array<int>" + ", round_trip boolean" * check
    return as_bytes(docs, F.xxhash64("doc_id", "text").alias("doc_key")).mapInArrow(run, schema)


def decoded(encodings: DataFrame, model: str) -> DataFrame:
    """The rows with a column `text` decoded from `ids`; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            texts = [None if ids is None else decode(ids, vocab) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    rest = encodings.drop("text")
    return rest.mapInArrow(run, StructType([*rest.schema, StructField("text", StringType())]))
