"""64-bit hashes of words and word shingles of whole texts, vectorised over Arrow buffers.

Words are runs of bytes other than the separators (by default space and tab to carriage
return); A-Z count as a-z. All of these bytes are ASCII, so working on UTF-8 bytes equals
working on characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes between words: white space, or every ASCII byte that is not a letter.
WHITE_SPACE = np.zeros(256, bool)
WHITE_SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_LETTER = np.array([c < 128 and not chr(c).isalpha() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_CODE = _BYTE[_LOWER]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes hashed at once; a window ends at a word's end.
WINDOW = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit sums so that every bit depends on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS


def _window(data: np.ndarray, cuts: np.ndarray, separator: np.ndarray, prefixes: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(start, hashes) of the words of a byte window; no word crosses a cut. Hashes are those of
    the whole words or, in a second axis, of the words and their first bytes."""
    n = len(data)
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[data] * power[:n], out=sums[1:])
    out = []
    for stop in [ends] + [np.minimum(ends, starts + k) for k in prefixes]:
        h = (sums[stop] - sums[starts]) * inverse[starts] + (stop - starts).astype(np.uint64)
        h[stop < ends] += _PLACE[0]          # a prefix is not the word spelled like it
        out.append(mix(h))
    return starts, np.stack(out, axis=1) if prefixes else out[0]


def words(texts: pa.Array, separator: np.ndarray = WHITE_SPACE,
          prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the rows' offsets into them (null: no words). With ``prefixes``
    each word has a row of hashes: its own and those of its first bytes of these lengths."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    rows = (offsets - offsets[0])[:-1]
    at, got, lo = [], [], 0
    while lo < len(data):
        hi = min(len(data), lo + WINDOW)
        if hi < len(data):      # move the end to the next separator or row start
            nxt = np.searchsorted(rows, hi)
            limit = int(rows[nxt]) if nxt < len(rows) else len(data)
            while hi < limit and not separator[data[hi]]:
                hi += 1
        a, b = np.searchsorted(rows, [lo, hi])
        starts, hashes = _window(data[lo:hi], rows[a:b] - lo, separator, prefixes)
        at.append(starts + lo)
        got.append(hashes)
        lo = hi
    if not at:
        shape = (0, 1 + len(prefixes)) if prefixes else 0
        return np.zeros(shape, np.uint64), np.zeros(len(texts) + 1, np.int64)
    at = np.concatenate(at)
    return np.concatenate(got), np.searchsorted(at, offsets - offsets[0])


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row and the rows' offsets into them. A row of fewer
    than ``width`` words has its whole sequence as one shingle, a row without words none."""
    count = np.diff(offsets)
    n = len(hashes)
    sums = np.zeros(n, np.uint64)
    for k in range(width):
        if n > k:
            sums[:n - k] += hashes[k:] * _PLACE[k]
    row = np.repeat(np.arange(len(count)), count)
    left = offsets[1:][row] - np.arange(n)          # words from here to the row's end
    keep = left >= width
    for r in np.flatnonzero((count > 0) & (count < width)).tolist():
        a, k = offsets[r], count[r]
        sums[a] = np.append(hashes[a:a + k] * _PLACE[:k], _PLACE[width + k]).sum(dtype=np.uint64)
        keep[a] = True
    values, row = mix(sums[keep]), row[keep]
    edges = np.searchsorted(row, np.arange(len(count) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[edges[:-1][edges[:-1] < len(values)]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return values[fresh], kept[edges]
