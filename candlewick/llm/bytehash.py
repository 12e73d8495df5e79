"""Vectorised hashing of byte buffers: every window, word or span of a buffer in a few numpy passes.

A buffer's prefix sums of ``TABLE[byte] * BASE**position`` modulo the prime 2**61 - 1 give the hash of any span in constant time: the
difference of two sums, moved back to position 0 by the inverse power.  Modulo a prime, spans that differ have equal values for few
bases only; modulo 2**64 there are words of a thousand letters (Thue and Morse's and its complement) that are equal for every base.
The result is finished by a mixing step, so hashes of different spans behave as independent 64-bit values.

quick_hashes() is the form modulo 2**64, half the work: for choosing places by content, where equal hashes of different spans do no
harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PRIME = (1 << 61) - 1
BASE = 0x1A3D5C7F92B4E681
INVERSE = pow(BASE, -1, PRIME)
QUICK, QUICK_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
TABLE = np.random.default_rng(20240607).choice(np.arange(1, 1 << 32, 16_777_213, dtype=np.uint64), 256, replace=False)
#: The bytes 9 to 13 and 32 end a word.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z become a-z, all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE = 1 << 20
#: Bytes hashed in one go: so few that the arrays stay in the cache.
SMALL = 1 << 16

_powers: dict[tuple[int, int], np.ndarray] = {}
_U = {n: np.uint64(n) for n in (8, 29, 32, 61, PRIME, (1 << 29) - 1, (1 << 32) - 1)}


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**64."""
    x = (x & _U[PRIME]) + (x >> _U[61])
    return np.minimum(x, x - _U[PRIME])  # below PRIME the difference wraps round to a large number


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for a and b below PRIME, by halves of 32 bits."""
    ah, al, bh, bl = a >> _U[32], a & _U[(1 << 32) - 1], b >> _U[32], b & _U[(1 << 32) - 1]
    middle, low = ah * bl + al * bh, al * bl
    return reduced(ah * bh * _U[8] + ((middle & _U[(1 << 29) - 1]) << _U[32]) + (middle >> _U[29]) + (low & _U[PRIME]) + (low >> _U[61]))


def powers(base: int, n: int, prime: int = PRIME) -> np.ndarray:
    """base**0 .. base**(n-1), modulo PRIME or (with prime 0) 2**64; grown on demand, kept for the worker's life."""
    have = _powers.get((base, prime))
    if have is None or len(have) < n:
        size = max(n, PIECE + 4096)
        if prime:
            have = np.ones(1, np.uint64)
            while len(have) < size:
                have = np.concatenate([have, times(have, np.full(len(have), pow(base, len(have), prime), np.uint64))])
        else:
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 8 * PIECE:
            _powers[base, prime] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    value, power = TABLE[buf], powers(BASE, len(buf))
    high = value * (power >> _U[32])
    # below 2**62 each; the sums of their halves stay below 2**64
    term = ((high & _U[(1 << 29) - 1]) << _U[32]) + (high >> _U[29])
    low = value * (power & _U[(1 << 32) - 1])
    term += (low & _U[PRIME]) + (low >> _U[61])
    top = np.cumsum(term >> _U[32], dtype=np.uint64)
    bottom = np.cumsum(term & _U[(1 << 32) - 1], dtype=np.uint64)
    out[1:] = reduced(((top & _U[(1 << 29) - 1]) << _U[32]) + (top >> _U[29]) + reduced(bottom))
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of buf[start:end]; the length takes part."""
    gap = sums[end] + _U[PRIME] - sums[start]
    raw = times(np.minimum(gap, gap - _U[PRIME]), powers(INVERSE, len(sums))[start])
    return mix(raw + (end - start).astype(np.uint64), seed)


def quick_hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of the buffer, modulo 2**64."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(TABLE[buf] * powers(QUICK, len(buf), 0), out=sums[1:])
    return mix((sums[width:] - sums[: len(sums) - width]) * powers(QUICK_INVERSE, len(sums), 0)[: len(sums) - width])


def grouped(sizes: list[int], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes stay within the limit together; a larger item is alone."""
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            yield first, i
            first = i
            total = 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def word_hashes(data: bytes, lower: bool = True) -> np.ndarray:
    """Hashes of the words (runs of bytes other than 9-13 and 32) of one text, in order; long texts are taken in pieces cut
    at a white space."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + SMALL)
        buf = np.frombuffer(data, np.uint8, end - at, at)
        if end < len(data) and not SPACE[data[end]]:  # the piece would end inside a word
            gaps = np.flatnonzero(SPACE[buf])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                end = next((i for i in range(end, len(data)) if SPACE[data[i]]), len(data))
            buf = np.frombuffer(data, np.uint8, end - at, at)
        out.append(_words(buf, lower)[2])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _words(buf: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~SPACE[buf]
    turns = np.diff(inside)
    start, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    sums = prefix_sums(LOWER[buf] if lower else buf)
    return start, end, span_hashes(sums, start, end)


def batch_word_hashes(texts: list[bytes], lower: bool = True) -> Iterator[np.ndarray]:
    """word_hashes of each text, with small texts hashed together."""
    for a, b in grouped([len(t) + 1 for t in texts], SMALL):
        if b == a + 1:
            yield word_hashes(texts[a], lower)
            continue
        joined = b" ".join(texts[a:b])
        start, _, hashes = _words(np.frombuffer(joined, np.uint8), lower)
        ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
        yield from np.split(hashes, np.searchsorted(start, ends[:-1]))
