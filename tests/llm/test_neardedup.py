"""Near-duplicates against brute force, on odd rows and on chains of edits."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from llm.conftest import SCHEMA, odd_rows

from rowsmith.llm import hyperminhash, neardedup, wordhash
from rowsmith.llm.components import components


def _set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else [tuple(w[i:i + width]) for i in range(len(w) - width + 1)])


def _brute(rows, width):
    """component and set size of every row index."""
    sets = [_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    group = defaultdict(list)
    for i in range(len(rows)):
        group[find(i)].append(rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in group[find(i)] if x is not None]
        out.append((d, len(sets[i]), d if not sets[i] else min(ids, default=None)))
    return sorted(out, key=str)


def _check(spark, rows, width, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardedup.groups(df, neardedup.Threshold(width)).collect()]
    assert sorted(got, key=str) == _brute([(r[0], r[1]) for r in rows], width)


def _edits():
    """Chains of edits (each step links, the ends do not), near copies of one text, and texts that share a passage."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for size in (6, 40, 150):
        for _ in range(3):
            w = [word() for _ in range(size)]
            for step in range(8):
                rows.append((n, " ".join(w)))
                n += 1
                w = list(w)
                w[step * 4 % size] = word()
    base = [word() for _ in range(60)]
    for _ in range(120):
        w = list(base)
        w[rnd.randrange(60)] = word()
        rows.append((n, " ".join(w)))
        n += 1
    passage = " ".join(word() for _ in range(50))
    for _ in range(60):
        rows.append((n, passage + " " + " ".join(word() for _ in range(rnd.randrange(5, 30)))))
        n += 1
    return rows


def test_odd_rows(spark):
    _check(spark, odd_rows(), 4, SCHEMA)


def test_chains_copies_and_passages(spark):
    _check(spark, _edits(), 4)


def test_small_cells_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(neardedup, "CELL", 8)
    _check(spark, _edits(), 4)


def test_dedup_keeps_one_of_each_group_and_all_columns(spark, odd):
    want = _brute([(r["doc_id"], r["text"]) for r in odd.collect()], 5)
    out = neardedup.dedup(odd)
    assert out.columns == odd.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    groups = {c for d, n, c in want if n}
    empty = sum(1 for _, n, _ in want if not n)
    assert len(got) == len(groups) + empty


def test_empty_table(empty):
    assert neardedup.groups(empty).collect() == []
    assert neardedup.dedup(empty).collect() == []


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(4)
    for n in (5, 60, 4000):
        errors = []
        for _ in range(60):
            a = rng.integers(0, 2**64, n, np.uint64)
            b = np.concatenate([a[: n * 4 // 5], rng.integers(0, 2**64, n - n * 4 // 5, np.uint64)])
            regs = hyperminhash.registers(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, n, 2 * n]))
            j = (n * 4 // 5) / (2 * n - n * 4 // 5)
            errors.append(hyperminhash.estimate(np.array([(regs[0] == regs[1]).sum()]), np.array([n]), np.array([n]))[0] - j)
        assert abs(np.mean(errors)) < 0.03


def test_collisions_of_unlike_sets_are_corrected():
    rng = np.random.default_rng(5)
    agree = []
    for _ in range(300):
        regs = hyperminhash.registers(np.sort(rng.integers(0, 2**64, 2000, np.uint64).reshape(2, -1), axis=1).ravel(),
                                      np.array([0, 1000, 2000]))
        agree.append((regs[0] == regs[1]).mean())
    assert abs(np.mean(agree) - hyperminhash.COLLISIONS[9, 9]) < 5e-4


def test_word_hashes_do_not_depend_on_windows(monkeypatch):
    texts = pa.array([r[1] for r in odd_rows()])
    want = [x.tolist() for x in wordhash.words(texts)]
    monkeypatch.setattr(wordhash, "WINDOW", 64)
    assert [x.tolist() for x in wordhash.words(texts)] == want
    part = wordhash.words(texts.slice(4, 10))
    assert part[0].tolist() == want[0][want[1][4]:want[1][14]]


def test_components_of_a_path_a_star_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 if n < 100 else 100 if n < 200 else 200 for e in edges for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
