"""Words of whole texts as Arrow arrays, found on UTF-8 bytes.

The bytes between words are all ASCII, so cutting bytes equals cutting characters. Words stay
Arrow strings: they are compared, numbered and joined exactly, without Python strings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def separators(keep: str = "", space: bool = False) -> np.ndarray:
    """Which of 256 bytes lie between words: with ``space`` white space only (space, tab to
    carriage return), else every ASCII byte that is not in ``keep``."""
    out = np.zeros(256, bool)
    if space:
        out[[0x20, *range(0x09, 0x0E)]] = True
        return out
    out[:128] = True
    out[[ord(c) for c in keep]] = False
    return out


@dataclass
class Words:
    """All words of some texts. Row r has the words rows[r] to rows[r + 1]; word k lies at the
    bytes starts[k] to stops[k] of ``data``, the texts' bytes one after another, where row r's
    text begins at text_at[r]."""

    words: pa.LargeStringArray
    rows: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    data: np.ndarray
    text_at: np.ndarray

    def codes(self) -> np.ndarray:
        """A number per word, equal for equal words only."""
        return self.words.dictionary_encode().indices.to_numpy().astype(np.int32)


def find(texts: pa.Array, separator: np.ndarray, lower: bool = False) -> Words:
    """The words of texts (null: none); with ``lower`` A-Z become a-z."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[at[0]:at[-1]] if body is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(pa.array([], pa.large_string()), np.zeros(len(texts) + 1, np.int64), none, none, data, at)
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    kept = data[inside]
    size = np.append(np.flatnonzero(first[inside]), len(kept))
    if lower:
        kept = LOWER[kept]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(size.astype(np.int64)), pa.py_buffer(kept))
    return Words(words, np.searchsorted(starts, at), starts, starts + np.diff(size), data, at)


def joined(words: pa.Array, rows: np.ndarray, keep: np.ndarray | None = None) -> pa.Array:
    """A text per row: its (kept) words joined by one space."""
    if keep is not None:
        words = words.filter(pa.array(keep))
        rows = np.concatenate([[0], np.cumsum(keep)])[rows]
    each = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), words)
    return pc.binary_join(each, pa.scalar(" ", pa.large_string())).cast(pa.string())
