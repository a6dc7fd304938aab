"""Word shingles and HyperMinHash sketches of one text (numpy helpers, run inside tasks).

Words are the runs of bytes outside space, tab, LF, VT, FF and CR after A-Z has been
lower-cased; that is exactly ``bytes.lower().split()`` on the UTF-8 form. A shingle is a
64-bit hash of ``k`` consecutive words (the whole sequence if a text has fewer), so a
set of shingles is a sorted, distinct ``uint64`` array.

HyperMinHash: every shingle hash picks one of ``m`` buckets, and a bucket keeps, of its
smallest remainder, the count of leading zeros and the ``MANTISSA`` bits that follow
them, together one 16-bit register. An empty bucket borrows the register of the first
occupied one in a fixed pseudo-random order, so that two registers of one position agree
with probability J (plus chance collisions) for sets of any size.
"""

from __future__ import annotations

import functools
import re

import numpy as np

MANTISSA = 10
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 20


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_P**i and _P**-i for i < n, modulo 2**64."""
    both = []
    for base in (_P, pow(_P, -1, 1 << 64)):
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        both.append(np.multiply.accumulate(out, dtype=np.uint64))
    return both[0], both[1]


def _chunk_hashes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    up, down = _powers(max(_CHUNK + 1, 1 << (len(b) + 1).bit_length()))
    inside = np.zeros(len(b) + 2, dtype=bool)
    np.logical_not((b == 32) | (b - np.uint8(9) < 5), out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64, out=sums[1:])
    start, end = edges[::2], edges[1::2]
    return mix64((sums[end] - sums[start]) * down[start])


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash per word, in order; a prefix sum of powers hashes all words at once.

    Long texts go chunk by chunk, cut at white space, so memory stays bounded by the chunk
    (or by the longest word). The hash of a word doesn't depend on where it stands.
    """
    if len(data) <= _CHUNK:
        return _chunk_hashes(data)
    out, at = [], 0
    space = re.compile(rb"[\x20\x09-\x0D]")
    while at < len(data):
        cut = space.search(data, at + _CHUNK) if at + _CHUNK < len(data) else None
        to = cut.start() if cut else len(data)
        out.append(_chunk_hashes(data[at:to]))
        at = to
    return np.concatenate(out)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text; none without words."""
    h = word_hashes(text.encode("utf-8", "surrogatepass").lower()) if text else np.empty(0, dtype=np.uint64)
    n = len(h)
    if not n:
        return h
    width = min(k, n)
    acc = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        acc = (acc ^ h[i : n - width + 1 + i]) * _MIX[i % len(_MIX)]
        acc ^= acc >> np.uint64(29)
    return np.unique(mix64(acc))


@functools.lru_cache(maxsize=4)
def _borrow(m: int) -> tuple[np.ndarray, np.ndarray]:
    """order[t, p]: the bucket that position p tries t-th; ranks[p, q]: when p tries q."""
    order = np.random.Generator(np.random.PCG64(20240229)).permuted(np.tile(np.arange(m, dtype=np.int16), (m, 1)), axis=1)
    return np.ascontiguousarray(order.T), np.argsort(order, axis=1).astype(np.int16)


def registers(sh: np.ndarray, m: int) -> np.ndarray:
    """HyperMinHash registers (uint16[m]) of a non-empty shingle set."""
    hi = (sh >> np.uint64(32)).astype(np.uint64)
    bucket = ((hi * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
    # the hash is sorted, so buckets ascend; the remainder must not depend on the bucket bits
    rest = mix64(sh ^ np.uint64(0x5851F42D4C957F2D))
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    low = np.minimum.reduceat(rest, starts)
    # frexp of the 53 leading bits gives the position of the first one and what follows it
    frac, exp = np.frexp((low >> np.uint64(11)).astype(np.float64))
    zeros = np.where(low >> np.uint64(11) == 0, 53, 53 - exp)
    mantissa = ((frac * 2 - 1) * (1 << MANTISSA)).astype(np.int64).clip(0)
    reg = (np.minimum(zeros, 63) << MANTISSA | mantissa).astype(np.uint16)
    out, full = np.zeros(m, dtype=np.uint16), np.zeros(m, dtype=bool)
    at = bucket[starts]
    out[at], full[at] = reg, True
    if len(at) < m:
        order, ranks = _borrow(m)
        empty = np.flatnonzero(~full)
        if 4 * len(at) < m:
            out[empty] = reg[ranks[np.ix_(empty, at)].argmin(axis=1)]
        t = 0
        while 4 * len(at) >= m and len(empty):  # the same choice, quicker where most tries succeed
            src = order[t, empty]
            hit = full[src]
            out[empty[hit]] = out[src[hit]]
            empty = empty[~hit]
            t += 1
    return out


def band_keys(reg: np.ndarray, rows: int) -> np.ndarray:
    """One int64 per band of ``rows`` registers; the band's number is mixed in."""
    bands = reg.reshape(-1, rows).astype(np.uint64)
    acc = np.arange(len(bands), dtype=np.uint64) * _MIX[4]
    for i in range(rows):
        acc = (acc ^ bands[:, i]) * _MIX[i % len(_MIX)]
        acc ^= acc >> np.uint64(31)
    return mix64(acc).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates from register arrays (the last axis).

    Different minima still give equal registers by chance: leading-zero counts agree with
    probability sum 4^-i = 1/3 and then MANTISSA bits with 2^-MANTISSA. The share of equal
    registers is J + (1 - J) * chance, solved here for J.
    """
    chance = 2.0**-MANTISSA / 3
    return np.maximum(0.0, ((a == b).mean(axis=-1) - chance) / (1 - chance))


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| on sorted distinct arrays, in whole numbers."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small)) if len(large) else 0
    return 100 * both >= percent * (len(a) + len(b) - both)
