"""Benchmark decontamination against a brute-force scan of all windows."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from llm.conftest import odd_rows

from rowsmith.llm import decontaminate as dc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def windows_of(items, width):
    out = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            out.setdefault(tuple(w[i:i + width]), set()).add("" if item is None else str(item))
    return out


def brute(text, windows, width):
    """(n_words, hit words, items) of one text."""
    w = words_of(text)
    hit, items = set(), set()
    for m in {len(k) for k in windows}:
        for i in range(len(w) - m + 1):
            if (found := windows.get(tuple(w[i:i + m]))):
                hit.update(range(i, i + m))
                items |= found
    return len(w), hit, sorted(items)


def corpus(rnd):
    word = lambda: rnd.choice(["alpha", "Beta", "gamma", "DELTA", "é", "x1", "漢字", "of", "the"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rnd.randint(10, 40))) for i in range(30)]
    items += [(40, text(3)), (41, "short ONE"), (42, ""), (43, None), (44, "?!"), (None, text(15)), (7, text(12)), (46, items[3][1]),
              (47, " ".join(f"w{i}" for i in range(2000))), (-5, "unique word list that nobody else will ever write down here ok")]
    docs = []
    for i in range(200):
        parts = [text(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            w = words_of(rnd.choice(items)[1])
            a = rnd.randint(0, max(0, len(w) - 5))
            parts += ["; ".join(w[a:a + rnd.randint(1, 40)]).upper() if rnd.random() < 0.3 else ", ".join(w[a:a + rnd.randint(1, 40)]), text(3)]
        docs.append((i, "\n".join(parts)))
    return items, docs


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").repartition(2)


@pytest.mark.parametrize("payload_bytes, width", [(8 << 20, 10), (400, 10), (1 << 20, 4)])
def test_equals_brute_force(spark, monkeypatch, payload_bytes, width):
    """Whole, and with the benchmark dealt into many payloads."""
    monkeypatch.setattr(dc, "PAYLOAD_BYTES", payload_bytes)
    items, docs = corpus(random.Random(payload_bytes))
    bench = table(spark, items)
    if payload_bytes == 400:
        items, docs = items[:12] + items[30:38], docs[:60]
        bench = table(spark, items)
        assert len(list(dc.payloads(bench, width))) > 3
    windows = windows_of(items, width)
    rows = dc.annotate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench, width).collect()
    assert len(rows) == len(docs)
    hits = 0
    for r in rows:
        n, hit, found = brute(r["doc"]["text"], windows, width)
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, len(hit), found)
        assert {i for s in r["spans"] for i in range(s["first"], s["first"] + s["words"])} == hit
        raw, w = r["doc"]["text"].encode(), words_of(r["doc"]["text"])
        for s in r["spans"]:
            assert words_of(raw[s["begin"]:s["stop"]].decode()) == w[s["first"]:s["first"] + s["words"]]
            assert s["first"] - 1 not in hit and s["first"] + s["words"] not in hit
        hits += len(hit)
    assert hits > 100


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """With a hash of two values, hits are still verified word by word."""
    monkeypatch.setattr(dc, "_hashes", lambda codes, at, width: (codes[at] % 2).astype("uint64") << dc.np.uint64(63))
    items, docs = corpus(random.Random(2))
    p = dc.payload([(str(i), " ".join(words_of(t))) for i, t in items if words_of(t) and len(words_of(t)) < 500], 10)
    windows = windows_of([x for x in items if len(words_of(x[1])) < 500], 10)
    w, hit, row, item = dc._scan(pa.array([t for _, t in docs[:40]]), p)
    for r, (_, text) in enumerate(docs[:40]):
        n, want, found = brute(text, windows, 10)
        assert hit[w.rows[r]:w.rows[r + 1]].nonzero()[0].tolist() == sorted(want)
        assert sorted({p.names[i].as_py() for i in item[row == r]} - {"None", ""}) == [x for x in found if x]


def test_removal(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"Before, {passage.upper()}! After."), (2, "clean text"), (3, None), (4, passage), (5, f"é {passage} {passage} ü")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([("b", passage)], "item_id string, text string")
    clean = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs, bench).collect()}
    assert clean == {1: "Before, ! After.", 2: "clean text", 3: None, 4: "", 5: "é  ü"}
    assert {r[0] for r in dc.decontaminate(docs, bench, remove="documents").collect()} == {2, 3}
    assert {r[0] for r in dc.decontaminate(docs, bench, remove="documents", from_share=0.9).collect()} == {1, 2, 3}
    with pytest.raises(ValueError):
        dc.decontaminate(docs, bench, remove="all")


def test_odd_rows_and_empty_tables(spark, odd, empty):
    items = [(i, r[1][:5000] if r[1] else r[1]) for i, r in enumerate(odd_rows())] + [(None, "one two three"), (3, "ONE")]
    bench = table(spark, items)
    windows = windows_of(items, 10)
    rows = dc.annotate(odd, bench).collect()
    assert sorted(str(r["doc"]) for r in rows) == sorted(str(r) for r in odd.collect())
    for r in rows:
        n, hit, found = brute(r["doc"]["text"], windows, 10)
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, len(hit), found)
    assert dc.annotate(empty, bench).collect() == []
    none = dc.annotate(odd, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r["n_hit"] or r["items"] or r["spans"] for r in none)
    assert dc.decontaminate(odd, bench).columns == odd.columns
    assert dc.decontaminate(odd, bench).count() == len(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    out = dc.q_decontaminate(spark, sf)
    windows = windows_of([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], 10)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, hit, found = brute(docs[r["doc_id"]], windows, 10)
        sha = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, len(hit), len(found), sha, bool(hit))
    assert any(r["contaminated"] for r in rows)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
