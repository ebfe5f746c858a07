"""Patched frame-of-reference coding of unsigned 32-bit ids (numpy, vectorised by width).

Ids are cut into blocks of ``BLOCK``. A block stores its minimum; the differences to it are
packed at the width that holds ``SHARE`` of them, and larger ones (outliers) go to the
block's exception list of (position, difference). The index holds each block's byte start,
so any block can be decoded alone.

Byte layout, little-endian: ``PFR1``, block size u4, documents u8, ids u8, blocks u8; per
document id i8, id-is-null u1, id count u8; per block start u8, minimum u4, width u1,
exceptions u2; then the blocks: packed bits (the last block padded with zeros), exception
positions u1, exception differences u4.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 128
#: Share of a block's differences that its width must hold.
SHARE = 0.9
MAGIC = b"PFR1"
HEAD = struct.Struct("<4sIQQQ")


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Bits needed for each value (0 for 0)."""
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values as rows of packed bytes."""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """Rows of packed bytes as rows of BLOCK values."""
    bits = np.unpackbits(packed, axis=1, bitorder="little")[:, :BLOCK * width].reshape(-1, width)
    wide = np.zeros((len(bits), 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1, BLOCK)


def encode(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file image of documents (ids may be None) with ``counts`` ids each."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    if n:
        padded[n:] = ids[-1]
    rows = padded.reshape(-1, BLOCK)
    low = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = rows - low[:, None]
    k = max(0, int(np.ceil(SHARE * BLOCK)) - 1)
    width = _bit_length(np.partition(diff, k, axis=1)[:, k]) if blocks else np.zeros(0, np.int64)
    over = (diff >> np.minimum(width, 31).astype(np.uint32)[:, None] != 0) & (width < 32)[:, None]
    n_over = over.sum(axis=1)
    size = BLOCK // 8 * width + 5 * n_over
    start = np.cumsum(size) - size
    body = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        if w:
            body[start[at][:, None] + np.arange(BLOCK // 8 * w)] = _pack(diff[at], int(w))
    b, pos = np.nonzero(over)
    if len(b):
        first = np.cumsum(n_over) - n_over
        nth = np.arange(len(b)) - first[b]
        lists = start + BLOCK // 8 * width
        body[lists[b] + nth] = pos
        body[(lists + n_over)[b][:, None] + 4 * nth[:, None] + np.arange(4)] = \
            np.ascontiguousarray(diff[b, pos], "<u4").view(np.uint8).reshape(-1, 4)
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([
        HEAD.pack(MAGIC, BLOCK, len(doc_ids), n, blocks),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), null.tobytes(),
        np.asarray(counts, "<u8").tobytes(), start.astype("<u8").tobytes(), low.astype("<u4").tobytes(),
        width.astype(np.uint8).tobytes(), n_over.astype("<u2").tobytes(), body.tobytes()])


def decode(image: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, ids per document, all ids) of a file image."""
    magic, block, docs, n, blocks = HEAD.unpack_from(image)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a file of this format")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(image, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, null, counts = take("<i8", docs), take("u1", docs), take("<u8", docs)
    start, low, width, n_over = take("<u8", blocks), take("<u4", blocks), take("u1", blocks), take("<u2", blocks)
    body = np.frombuffer(image, np.uint8, offset=at)
    start, width, n_over = start.astype(np.int64), width.astype(np.int64), n_over.astype(np.int64)
    out = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            out[rows] = _unpack(body[start[rows][:, None] + np.arange(BLOCK // 8 * w)], int(w))
    if n_over.sum():
        b = np.repeat(np.arange(blocks), n_over)
        nth = np.arange(len(b)) - (np.cumsum(n_over) - n_over)[b]
        lists = start + BLOCK // 8 * width
        pos = body[lists[b] + nth]
        values = np.ascontiguousarray(body[(lists + n_over)[b][:, None] + 4 * nth[:, None] + np.arange(4)]).view("<u4")
        out[b, pos] = values.ravel()
    out += low[:, None]
    ids = [None if z else int(d) for d, z in zip(doc_ids, null)]
    return ids, counts.astype(np.int64), out.ravel()[:n]
