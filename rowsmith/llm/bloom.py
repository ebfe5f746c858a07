"""Two-pass Bloom filtering of 64-bit hashes: which of them may occur more than once.

Pass one sets, for every hash, ``PROBES`` bits of a filter; a second plane marks bits that
were set twice or more. Tasks build partial planes, cut into segments; segments are OR-ed
by number on executors (a bit set once on two sides was set twice). Pass two looks hashes
up in the second plane: a hash that occurs twice has all its bits there, so none is missed;
about 0.3 % of the others pass by chance. The filter has ``BITS_PER_KEY`` bits a row and at
most ``MAX_BITS`` (a bounded 16 MB when broadcast): more rows are split by hash into slices
that are filtered one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBES = 4
BITS_PER_KEY = 16
MAX_BITS = 1 << 27
SEGMENT_BYTES = 1 << 16


def slice_count(rows: int) -> int:
    return max(1, -(-rows * BITS_PER_KEY // MAX_BITS))


def filter_bits(rows: int) -> int:
    """A power of two of about BITS_PER_KEY bits a row, within one segment and MAX_BITS."""
    need = max(SEGMENT_BYTES * 8, rows * BITS_PER_KEY)
    return min(MAX_BITS, 1 << (need - 1).bit_length())


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)], axis=1)


def repeated_plane(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """The packed second plane for all values of a 64-bit hash column."""
    return _planes(hashes, column, bits, "twice")


def member_plane(hashes: DataFrame, column: str, rows: int) -> np.ndarray:
    """The packed first plane: a common Bloom filter of at most ``rows`` values."""
    return _planes(hashes, column, filter_bits(rows), "once")


def _planes(hashes: DataFrame, column: str, bits: int, wanted: str) -> np.ndarray:

    def build(batches):
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for batch in batches:
            at = np.sort(_places(batch.column(0).to_numpy(), bits).ravel())
            twice[at[1:][at[1:] == at[:-1]]] = True
            twice[at[once[at]]] = True
            once[at] = True
        planes = [np.packbits(x).reshape(-1, min(SEGMENT_BYTES, bits // 8)) for x in (once, twice)]
        for i in np.flatnonzero(planes[0].any(axis=1)).tolist():
            yield pa.RecordBatch.from_pydict({
                "segment": pa.array([i], pa.int32()), "once": pa.array([planes[0][i].tobytes()], pa.binary()),
                "twice": pa.array([planes[1][i].tobytes()], pa.binary())})

    def merge(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = None
        for batch in parts:
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
        yield pa.RecordBatch.from_pydict({
            "segment": pa.array([key[0].as_py()], pa.int32()),
            "plane": pa.array([(twice if wanted == "twice" else once).tobytes()], pa.binary())})

    parts = hashes.select(column).mapInArrow(build, "segment int, once binary, twice binary")
    merged = parts.groupBy("segment").applyInArrow(merge, "segment int, plane binary").collect()
    out = np.zeros((bits // 8 // min(SEGMENT_BYTES, bits // 8), min(SEGMENT_BYTES, bits // 8)), np.uint8)
    for row in merged:
        out[row["segment"]] = np.frombuffer(row["plane"], np.uint8)
    return out.ravel()


def lookup(plane: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether all bits of each hash are set in a packed plane."""
    at = _places(hashes, len(plane) * 8)
    return (plane[(at >> np.uint64(3)).astype(np.int64)]
            >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def in_plane(plane: np.ndarray, column: Column, df: DataFrame) -> Column:
    """True where all bits of a hash are set; only the hash goes through Python."""
    shared = df.sparkSession.sparkContext.broadcast(plane)

    @F.pandas_udf("boolean")
    def look(h: pd.Series) -> pd.Series:
        return pd.Series(lookup(shared.value, h.to_numpy()))

    return look(column)
