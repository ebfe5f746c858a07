"""Token ids of whole texts with a ``tokenizers`` file, encoding each distinct word once.

White space never lies inside a token of the tokenizers used here (their pre-tokenizer
drops it), so a text's ids are its words' ids in order. Words are found with vectorised Arrow
kernels and matched to known ones by sorted hashes that are kept between slices, each match
compared as text; only new words reach the tokenizer. Words made
of basic and Latin-1 letters with ASCII punctuation behind are two pieces to the
pre-tokenizer (letters, punctuation) and so are looked up as a lower-case stem and a
tail; every other word goes through the whole tokenizer unchanged.
The memo is bounded (``MEMO_BYTES``) and lives as long as the Python worker.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rowsmith.llm.common import gather_ranges

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of memoised words and ids at which a worker starts its memo anew.
MEMO_BYTES = 48 << 20
#: Bytes of text encoded at once: larger slices repeat fewer distinct words.
SLICE_BYTES = 2 << 20
#: Words put into one call of the tokenizer.
CALL_WORDS = 256

STEM = "^[a-zà-öø-ÿß]+$"
PLAIN = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-/:-@\[-`{-~]*)$"
_ENCODERS: dict[tuple[str, int], "TextEncoder"] = {}


def tokenizer_path() -> str:
    """Place of the installed word-level BPE file."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str, end_id: int) -> "TextEncoder":
    """This worker's encoder for a tokenizer file."""
    key = (path, end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(path, end_id)
    return _ENCODERS[key]


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words: their bytes weighed by powers of an odd number and summed."""
    edges = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4) if len(words) else np.zeros(1, np.int32)
    size = np.diff(edges)
    total = int(edges[-1] - edges[0])
    data = np.frombuffer(words.buffers()[2], np.uint8, total, edges[0]) if total else np.zeros(0, np.uint8)
    powers = np.cumprod(np.full(int(size.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64))
    starts = edges[:-1] - edges[0]
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers[np.arange(total, dtype=np.int32) - np.repeat(starts, size)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return sums[starts + size] - sums[starts]


class TextEncoder:
    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers
        self.full = Tokenizer.from_file(path)
        self.stems = Tokenizer(self.full.model)
        self.stems.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.end_id = end_id
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.hashes = np.zeros(0, np.uint64)         # of the known words, sorted
        self.places = np.zeros(0, np.int64)          # and their places in known
        self.starts = np.zeros(1, np.int64)          # ids of known word i: flat[starts[i]:starts[i + 1]]
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, words: pa.Array) -> pa.Array:
        """Add words (distinct, unknown) to the memo; returns them in memo order."""
        plain = pc.match_substring_regex(words, STEM)
        stems = words.filter(plain).to_pylist()
        others = words.filter(pc.invert(plain)).to_pylist()
        flats, counts = [self.flat], []
        for i in range(0, len(stems), CALL_WORDS):
            part = stems[i:i + CALL_WORDS]
            got = self.stems.encode(part, is_pretokenized=True, add_special_tokens=False)
            flats.append(np.array(got.ids, np.uint32))
            counts.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))
        for i in range(0, len(others), CALL_WORDS):
            each = [x.ids for x in self.full.encode_batch_fast(others[i:i + CALL_WORDS], add_special_tokens=False)]
            flats.append(np.array([t for ids in each for t in ids], np.uint32))
            counts.append(np.array([len(ids) for ids in each], np.int64))
        self.flat = np.concatenate(flats)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(counts))])
        new = pa.array(stems + others, pa.string())
        own = word_hashes(new)
        order = np.argsort(own)
        at = np.searchsorted(self.hashes, own[order])
        self.hashes = np.insert(self.hashes, at, own[order])
        self.places = np.insert(self.places, at, len(self.known) + order)
        self.known = pa.concat_arrays([self.known, new])
        return new

    def _places(self, words: pa.Array) -> np.ndarray:
        """Memo places of distinct words, learning the unknown ones. Words are found by hash and compared whole, so of
        two that share a hash the later is learned again each time."""
        if self.known.nbytes + self.flat.nbytes + self.hashes.nbytes + self.places.nbytes > MEMO_BYTES:
            self._forget()
        base, hashes = len(self.known), word_hashes(words)
        lost = np.ones(len(words), bool)
        out = np.zeros(len(words), np.int64)
        if base:
            at = np.minimum(np.searchsorted(self.hashes, hashes), base - 1)
            out = self.places[at]
            lost = ~pc.equal(self.known.take(pa.array(out)), words).to_numpy(zero_copy_only=False)
        if lost.any():
            missing = words.filter(pa.array(lost))
            new = self._learn(missing)
            out[lost] = base + pc.index_in(missing, value_set=new).to_numpy(zero_copy_only=False)
        return out

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and id counts of distinct words: each one's stem, then its tail."""
        parts = pc.extract_regex(words, PLAIN)
        stem = pc.if_else(pc.is_valid(parts), pc.utf8_lower(pc.struct_field(parts, "stem")), words)
        tail = pc.fill_null(pc.struct_field(parts, "tail"), "")
        pieces = pa.concat_arrays([stem, tail]).dictionary_encode()
        at = self._places(pieces.dictionary)[pieces.indices.to_numpy(zero_copy_only=False)].reshape(2, -1).T.ravel()
        size = self.starts[at + 1] - self.starts[at]
        return self.flat[gather_ranges(self.starts[at], size)], size.reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), each ended by the end id, and the row offsets."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = pc.list_flatten(lists).dictionary_encode()
        flat, count = self._word_ids(words.dictionary)
        starts = np.cumsum(count) - count
        at = words.indices.to_numpy(zero_copy_only=False)
        per_word = count[at]
        word_end = np.concatenate([[0], np.cumsum(per_word)])
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        row_ids = np.diff(word_end[edges])               # ids of each text without the end id
        offsets = np.concatenate([[0], np.cumsum(row_ids + 1)])
        out = np.full(int(offsets[-1]), self.end_id, np.uint32)
        ends = np.zeros(len(out), bool)
        ends[offsets[1:] - 1] = True
        out[~ends] = flat[gather_ranges(starts[at], per_word)]
        return out, offsets


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").view(np.uint8))
