"""HyperMinHash registers: leading-zero counts plus mantissa bits of bucketed minima.

A 64-bit element hash names a bucket by its top bits; the rest is a number whose minimum in
the bucket is kept as a register of 16 bits: the leading-zero count and the ``MANTISSA`` bits
behind the leading one. Buckets that a small set leaves empty borrow the register of the
first filled bucket in an order of their own, so registers of two sets agree with probability
near their Jaccard similarity at any set size.
"""

from __future__ import annotations

import numpy as np

REGISTERS = 128
BUCKET_BITS = 7
REST_BITS = 64 - BUCKET_BITS
MANTISSA = 10
_ORDER = np.stack([np.random.default_rng([9, i]).permutation(REGISTERS) for i in range(REGISTERS)])


def _registers_of(rest: np.ndarray) -> np.ndarray:
    """Leading-zero count (6 bits) and mantissa of values of REST_BITS bits."""
    x = rest.copy()
    length = np.zeros(len(x), np.int64)          # bit length by halving
    for step in (32, 16, 8, 4, 2, 1):
        big = x >= np.uint64(1) << np.uint64(step)
        length[big] += step
        x[big] >>= np.uint64(step)
    length += (rest > 0)
    zeros = REST_BITS - length
    below = np.maximum(length - 1, 0).astype(np.uint64)
    fraction = rest & ((np.uint64(1) << below) - np.uint64(1))
    shift = below.astype(np.int64) - MANTISSA
    mantissa = np.where(shift >= 0, fraction >> np.maximum(shift, 0).astype(np.uint64),
                        fraction << np.maximum(-shift, 0).astype(np.uint64))
    return ((zeros << MANTISSA) | mantissa.astype(np.int64)).astype(np.uint16)


def registers(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, REGISTERS) uint16 of sets given as sorted hashes with row offsets. Rows of
    empty sets are zeros."""
    count = np.diff(offsets)
    row = np.repeat(np.arange(len(count)), count)
    bucket = (values >> np.uint64(REST_BITS)).astype(np.int64)
    first = np.ones(len(values), bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])     # sorted: the first is the least
    out = np.zeros((len(count), REGISTERS), np.uint16)
    filled = np.zeros((len(count), REGISTERS), bool)
    rest = values[first] & np.uint64((1 << REST_BITS) - 1)
    out[row[first], bucket[first]] = _registers_of(rest)
    filled[row[first], bucket[first]] = True
    r, i = np.nonzero(~filled & (count > 0)[:, None])
    for k in range(REGISTERS):
        if not len(r):
            break
        src = _ORDER[i, k]
        hit = filled[r, src]
        out[r[hit], i[hit]] = out[r[hit], src[hit]]
        r, i = r[~hit], i[~hit]
    return out


def _collisions() -> np.ndarray:
    """Chance that registers of different minima agree, by the set sizes' powers of two."""
    sizes = 2.0 ** np.arange(0, 41) / REGISTERS
    edges = np.concatenate([[0.0], *(2.0 ** -(e + 1) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))
                                     for e in range(48, -1, -1)), [1.0]])
    # the least of k uniform numbers exceeds x with probability (1 - x)**k
    cells = np.stack([-np.diff(np.exp(np.log1p(-np.minimum(edges, 1 - 1e-16)) * max(k, 1.0))) for k in sizes])
    return cells @ cells.T


COLLISIONS = _collisions()


def estimate(agree: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of agreeing registers and the set sizes, corrected for
    registers that agree by collision."""
    size = [np.minimum(np.log2(np.maximum(x, 1)).astype(np.int64), len(COLLISIONS) - 1) for x in (a, b)]
    chance = COLLISIONS[size[0], size[1]]
    return np.clip((agree / REGISTERS - chance) / (1 - chance), 0, 1)
