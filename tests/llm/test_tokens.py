"""Token ids, files and packing: exact round trips."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from llm.conftest import texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowsmith.llm import packing, pfor, tokenbin, tokens
from rowsmith.session import scratch_path


def _reference():
    tok = Tokenizer.from_file(tokens.tokenizer_path())
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids + [2]


def test_memo_equals_the_tokenizer(monkeypatch):
    ref = _reference()
    odd = texts() + ["Hello, WORLD. it's a<|ENDOFTEXT|>b <|startoftext|>.", "J̌o é x́ ΣΑΣ Ÿ ſ K Å", "...,,, a.. ,c 3.14 don't 's x'", "a­b %%% of%%%"]
    enc = tokens.TextEncoder(tokens.tokenizer_path(), 2)
    for _ in range(2):
        ids, offsets = enc.encode(pa.array(odd, pa.string()))
        for i, t in enumerate(odd):
            assert ids[offsets[i]:offsets[i + 1]].tolist() == ref(t)
        monkeypatch.setattr(tokens, "MEMO_BYTES", 0)      # forgetting changes nothing


def test_known_words_are_not_indexed_anew_for_each_slice(monkeypatch):
    sets, index_in = [], tokens.pc.index_in
    monkeypatch.setattr(tokens.pc, "index_in", lambda words, value_set: sets.append(len(value_set)) or index_in(words, value_set=value_set))
    enc, ref = tokens.TextEncoder(tokens.tokenizer_path(), 2), _reference()
    for i in range(12):
        text = " ".join(f"w{j:x}q, Word" for j in range(i * 40, i * 40 + 60))
        ids, _ = enc.encode(pa.array([text, "word"]))
        assert ids.tolist() == ref(text) + ref("word")
    assert len(enc.known) > 480 and max(sets) < 100


def test_words_that_share_a_hash_keep_their_ids(monkeypatch):
    ref = _reference()
    monkeypatch.setattr(tokens, "word_hashes", lambda words: np.full(len(words), 7, np.uint64))
    enc = tokens.TextEncoder(tokens.tokenizer_path(), 2)
    for t in texts() * 2:
        assert enc.encode(pa.array([t], pa.string()))[0].tolist() == ref(t)


def test_word_hashes_see_slices_and_empty_words():
    words = pa.array(["", "a", "aa", "ab", "ba", "é", "a" * 300, ""])
    h = tokens.word_hashes(words)
    assert h[0] == h[7] and len(set(h.tolist())) == 7
    assert tokens.word_hashes(words.slice(2, 3)).tolist() == h[2:5].tolist()
    assert len(tokens.word_hashes(words.slice(0, 0))) == 0 and tokens.word_hashes(pa.array(["", ""])).tolist() == h[[0, 0]].tolist()


def test_pfor_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 5000):
        for ids in (rng.integers(0, 49408, n), np.full(n, 7), rng.choice([1, 2, 3, 2**32 - 1], n), (rng.pareto(0.3, n) % 2**32)):
            ids = ids.astype(np.uint32)
            counts = np.array([n // 2, n - n // 2])
            names, c, got = pfor.decode(pfor.encode([None, -5], counts, ids))
            assert names == [None, -5] and c.tolist() == counts.tolist() and (got == ids).all()


def test_pfor_stores_outliers_apart():
    ids = np.full(12800, 3, np.uint32)
    ids[::64] = 49000
    assert len(pfor.encode([1], np.array([len(ids)]), ids)) < 12800     # two outliers a block, width 0


def test_files_round_trip(spark, odd, monkeypatch):
    ref = _reference()
    for size in (tokenbin.FILE_IDS, 50):
        monkeypatch.setattr(tokenbin, "FILE_IDS", size)
        path = scratch_path(spark, "t")
        tokenbin.write_ids(odd, path, partitions=4)
        rows = tokenbin.read_ids(spark, path, with_ids=True).collect()
        want = Counter((r["doc_id"], tuple(ref(r["text"]))) for r in odd.collect())
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
        rows.sort(key=lambda r: r["start"])
        ids = [r["doc_id"] for r in rows]
        assert ids[0] is None and ids[1:] == sorted(ids[1:])
        at = 0
        for r in rows:
            assert r["start"] == at and r["n_tokens"] == len(r["ids"])
            assert r["ids_crc32"] == tokens.crc_of(np.array(r["ids"], np.uint32))
            at += r["n_tokens"]


def test_pieces_cover_documents_and_sequences_have_no_gaps(odd):
    ref = _reference()
    rows = packing.pack(odd, capacity=256, group_docs=20, with_ids=True).collect()
    want = Counter((r["doc_id"], tuple(ref(r["text"]))) for r in odd.collect())
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) <= 256
        assert r["ids_crc32"] == tokens.crc_of(np.array(r["ids"], np.uint32))
        docs[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
    got = Counter()
    for (name, size), parts in docs.items():
        by_start = defaultdict(list)
        for p in parts:
            by_start[p["start"]].append(tuple(p["ids"]))
        copies = len(by_start[0])
        for c in range(copies):
            whole = sum((sorted(by_start[s])[c] for s in sorted(by_start)), ())
            assert len(whole) == size
            got[name, whole] += 1
    assert got == want
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256


def test_repeated_rows_spread_over_groups(spark):
    docs = spark.range(6000).select(F.when(F.col("id") >= 2000, F.when(F.col("id") < 4000, 7).otherwise(F.col("id"))).alias("doc_id"),
                                    F.when(F.col("id") < 4000, "same text").otherwise(F.col("id").cast("string")).alias("text"))
    rows = packing.pack(docs, group_docs=200).collect()
    ids = Counter(r["doc_id"] for r in rows)
    assert len(rows) == 6000 and ids[None] == ids[7] == 2000
    assert max(Counter(r["sequence_id"] >> 32 for r in rows).values()) < 300


def test_tree_equals_plain_first_fit():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 300):
        sizes = np.sort(rng.integers(1, 101, n))[::-1]
        room, want = [], []
        for s in sizes:
            k = next((i for i, r in enumerate(room) if r >= s), len(room))
            if k == len(room):
                room.append(100)
            want.append((k, 100 - room[k]))
            room[k] -= s
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        assert list(zip(bins.tolist(), offsets.tolist())) == [(int(a), int(b)) for a, b in want]


def test_empty_tables(spark, empty):
    path = scratch_path(spark, "t")
    tokenbin.write_ids(empty, path, partitions=2)
    assert tokenbin.read_ids(spark, path).collect() == []
    assert packing.pack(empty).collect() == []
