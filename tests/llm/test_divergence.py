"""Source divergence against brute force, and its run-length columns against dense ones."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from rowsmith.llm import divergence as dv

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return [w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, least=3, top=200):
    """docs: (text, lang, source); the audit with Python's integers."""
    df, whole, own = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = terms_of(text)
        df[lang].update(set(words))
        whole[lang].update(words)
        own[lang, source].update(words)
    out = []
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= least]
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept})(sum(c[t] for t in kept))
        p = share(own[lang, source])
        pairs = []
        for lang2, other in groups:
            if lang2 == lang and other != source:
                q = share(own[lang, other])
                pairs.append((other, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)))
        q = share(whole[lang])
        found = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if own[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", found, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, t, v, i + 1) for i, (t, v) in enumerate(items[:most])]
    return sorted(out)


def rows(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def corpus(rnd, n=300):
    words = [f"{a}{b}" for a in "abcdéß漢" for b in ["x", "Y", "zz", "q", ""]]
    out = []
    for i in range(n):
        k = rnd.choice([0, 0, 0, 1, 2, 3, 4])         # one source has many rows
        own = words[k * 4:k * 4 + 14] + words[:6]
        out.append((" ".join(rnd.choice(own) for _ in range(rnd.randint(0, 40))), rnd.choice(["en", "en", "de", None]), ["s0", "s1", "", "é", None][k]))
    return out + [("rare words once", "xx", "a"), (None, "xx", "b"), ("", "xx", "c"), ("solo solo", "yy", "only"), ("solo", "yy", "only"),
                  ("SOLO pair", "yy", "only"), ("12 34 _ !", "zz", "digits"), (None, None, None)]


def test_equals_brute_force(spark):
    docs = corpus(random.Random(1))
    df = spark.createDataFrame([(i, *d, 5, "x") for i, d in enumerate(docs)],
                               "doc_id long, text string, lang string, source string, n long, term string").repartition(4)
    assert rows(dv.audit(df)) == brute(docs)
    assert rows(dv.audit(df, least=1, top=3)) == brute(docs, 1, 3)
    assert rows(dv.audit(df.union(df))) == brute(docs * 2)           # repeated rows count each


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = dv.q_divergence(spark, sf)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows(out) == brute(docs)


def test_odd_rows_and_empty_tables(spark, odd, empty):
    assert rows(dv.audit(odd)) == brute([(r["text"], r["lang"], r["source"]) for r in odd.collect()])
    assert rows(dv.audit(empty)) == []
    wordless = spark.createDataFrame([(None, "a", "s"), ("1 2", "a", "t"), ("", None, None)], "text string, lang string, source string")
    assert rows(dv.audit(wordless)) == [("a", "s", "pair", "t", 0, 1), ("a", "t", "pair", "s", 0, 1)]


def test_run_length_columns(monkeypatch):
    """A column's runs expand to its dense counts, and pairs need fewer pieces than terms."""
    rnd = random.Random(4)
    sources = ["a", "b", "c", "d"]
    listed = sorted([(s, rnd.randint(1, 3)) for s in sources if rnd.random() < 0.4] for _ in range(400))
    m = np.array([rnd.randint(1, 50) for _ in listed])
    dense = {s: np.repeat([dict(x).get(s, 0) for x in listed], m) for s in sources}
    kind = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
    counts = pa.array([[{"source": s, "n": n} for s, n in x] for x in listed], kind)
    pieces, inner = [], dv._column

    def column(place, count, total):
        starts, values = inner(place, count, total)
        pieces.append(len(starts))
        expanded = np.repeat(values, np.diff(np.append(starts, total)))
        assert any((expanded == d).all() for d in dense.values()) and (values[1:] != values[:-1]).all() and starts[0] == 0
        return starts, values

    monkeypatch.setattr(dv, "_column", column)
    whole = [10_000, 20_000, 500, 10**13]
    got = dv.pair_sums(counts, m, sources, whole)
    p = {s: [1 + 10**9 * (int(c) + 1) // w for c in dense[s]] for s, w in zip(sources, whole)}
    assert sorted(got) == sorted((a, b, sum((x - y) ** 2 // y for x, y in zip(p[a], p[b]))) for a in sources for b in sources if a != b)
    assert max(pieces) < m.sum() / 10
    assert dv.pair_sums(counts[:0], m[:0], ["x", "y"], [0, 0]) == [("x", "y", 0), ("y", "x", 0)]


def test_shares_are_exact(spark):
    """Counts beyond 2^63 / 10^9."""
    cases = [(0, 1, 1), (9_300_000_000, 99_999_999_999, 12_345_678), (2 * 10**14, 2 * 10**14, 77), (10**13 - 1, 3 * 10**13, 10**9)]
    got = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", dv.share("c", "n").alias("p")).collect()
    for r in got:
        want = 1 + 10**9 * (r["c"] + 1) // (r["n"] + r["v"])
        assert r["p"] == want == int(dv._shares(np.array([r["c"]]), r["n"] + r["v"])[0])


def test_long_text_and_hot_source(spark):
    """A text of very many words; one source with most rows; cells of few rows."""
    docs = [("word other " * 60_000, "en", "hot")] + [(f"word t{i % 7} other", "en", "hot") for i in range(500)] + [("word cold other", "en", "cold")]
    assert rows(dv.audit(spark.createDataFrame(docs, "text string, lang string, source string"))) == brute(docs)
