"""Periodic runs against a brute-force scan of all lags."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import texts

from rowsmith.llm import periodicruns as pr
from rowsmith.llm import wordlist

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w, least=24, repeats=3):
    """(start, length, period) by scanning every lag word by word."""
    found = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, repeats * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def runs_of(listed, **how):
    n, runs, collapsed = pr._work(pa.array(listed, pa.string()), how.get("least", 24), how.get("repeats", 3))
    return [(k, [tuple(r.values()) for r in rs], c) for k, rs, c in zip(n.to_pylist(), runs.to_pylist(), collapsed.to_pylist())]


def check(listed, **how):
    for text, (n, runs, collapsed) in zip(listed, runs_of(listed, **how)):
        w = words_of(text)
        want = brute_runs(w, **how)
        assert (n, runs, collapsed) == (len(w), want, collapse(w, want))


def repetitive(rnd):
    """Words of few kinds, with stretches that repeat, nest and overlap."""
    w = []
    while len(w) < rnd.randint(0, 300):
        unit = [rnd.choice("abcdefgh"[:rnd.randint(1, 8)]) for _ in range(rnd.randint(1, 14))]
        w += (unit * rnd.randint(1, 9))[:rnd.randint(1, 90)]
        if rnd.random() < 0.4:
            w += [f"x{rnd.randint(0, 60)}"] * rnd.randint(1, 3)
        if rnd.random() < 0.2:
            w += w[-rnd.randint(1, 60):] * rnd.randint(1, 3)
    return " ".join(w)


def test_all_runs_of_repetitive_texts():
    rnd = random.Random(5)
    listed = [repetitive(rnd) for _ in range(300)]
    check(listed)
    check(listed[:80], least=6, repeats=2)
    check(listed[:80], least=1, repeats=4)
    assert sum(len(r) for _, r, _ in runs_of(listed)) > 200


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("aabbc"), max_size=90).map(" ".join), max_size=4))
def test_few_words(listed):
    check(listed)


def test_odd_texts():
    listed = texts() + ["a " * 24, "a " * 23, "a\tA\n" * 12, "é " * 30, None, "", " ", "a b c " * 8 + "a b", "q" + " a b c" * 8]
    listed = [t if t is None or len(t) < 50000 else t[:3000] for t in listed]      # the brute force is quadratic
    check(listed)


def test_splitting_is_stable_and_loses_no_run(monkeypatch):
    """Every surviving segment has no rare word, segments are what one-by-one settling gives."""
    rnd = random.Random(9)
    listed = [repetitive(rnd) for _ in range(120)]
    w = wordlist.find(pa.array(listed), pr.SPACE)
    codes = w.codes()
    want = sorted(map(tuple, pr.split(codes, w.rows).tolist()))
    for lo, hi in want:
        assert hi - lo >= 24 and min(np.unique(codes[lo:hi], return_counts=True)[1]) >= 3
    for rounds in (0, 1):
        monkeypatch.setattr(pr, "ROUNDS", rounds)
        assert sorted(map(tuple, pr.split(codes, w.rows).tolist())) == want


def test_long_texts_end_soon():
    """One word a million times; a period of a third; a text that loses a few words a round."""
    began = time.time()
    assert runs_of(["a " * 300_000])[0][1] == [(0, 300_000, 1)]
    unit = " ".join(f"w{i}" for i in range(50_000))
    assert runs_of([f"{unit} {unit} {unit}"])[0][1] == [(0, 150_000, 50_000)]
    chain = [f"c{k}" for k in range(40_000) for _ in (0,)]
    peel = " ".join(chain + chain + chain[1:])          # c0 is rare; each cut leaves the rest alone
    assert runs_of([peel])[0][1] == []
    assert time.time() - began < 60


def test_peeling_from_the_end_ends_soon():
    """Each cut makes one more word rare, so rounds are as many as words."""
    n = 4000
    w = [x for k in range(n) for x in (f"p{k}", f"p{k + 1}", f"p{k}", f"p{k + 1}", "z")]
    w = ["p0"] + w[2:]
    began = time.time()
    check_one = runs_of([" ".join(w)])[0]
    assert check_one[1] == [] and time.time() - began < 20


def expected(doc_id, text):
    w = words_of(text)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(collapse(w, runs)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark):
    out = pr.q_periodic_runs(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted(expected(r["doc_id"], r["text"]) for r in docs if len(words_of(r["text"])) < 3000)
    have = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in out.collect()}
    assert len(have) == len(docs)
    assert [have[w[0]] for w in want] == want
    assert sum(w[1] for w in want) > 5
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_odd_rows_and_empty_tables(spark, odd, empty, monkeypatch, tmp_path):
    found = pr.find_runs(odd)
    assert found.columns == ["doc", "n_words", "runs", "collapsed"]
    rows = found.collect()
    assert sorted(str(r["doc"]) for r in rows) == sorted(str(r) for r in odd.collect())
    for r in rows:
        if len(r["doc"]["text"] or "") < 50000:
            w = words_of(r["doc"]["text"])
            assert [tuple(x) for x in r["runs"]] == brute_runs(w) and r["collapsed"] == collapse(w, brute_runs(w))
    assert pr.find_runs(empty).collect() == []
    planted = pr.with_planted_runs(odd).collect()
    assert len(planted) == odd.count()
    monkeypatch.setattr(pr, "documents", lambda s, d: odd.filter("text is null or length(text) < 50000"))
    have = sorted((tuple(r[c] for c in COLUMNS) for r in pr.q_periodic_runs(spark, "").collect()), key=str)
    want = sorted((expected(r["doc_id"], r["text"]) for r in odd.collect() if len(r["text"] or "") < 50000), key=str)
    assert have == want
    with pytest.raises(ValueError):
        pr.find_runs(odd, repeats=1)
