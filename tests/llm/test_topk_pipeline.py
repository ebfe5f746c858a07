"""Exact top-k against brute force, and the pipeline's stages against plain Python."""

import math

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from rowsmith.llm import langid, topk
from rowsmith.llm.common import documents, stored


def _brute(rows, k, is_query):
    vec = {}
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [(i, [math.floor(np.float32(x).astype(float) * 1024) for x in v]) for i, v in ok]
    for i, v in ok:
        if is_query(i):
            vec[i] = min(vec.get(i, v), v)
    out = []
    for q, v in vec.items():
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])]
    return sorted(out)


def _got(df, k, cond):
    return sorted(tuple(r) for r in topk.search(topk.valid_vectors(df), cond, k).select("query_id", "rank", "vec_id", "score").collect())


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6))]) for i in range(300)]
    rows += [(300, None), (400, []), (301, [1.0, None, 2.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [9.0] * 6),
             (500, [1.0, 2.0]), (700, [0.0] * 6), (701, rows[5][1]), (702, rows[5][1]), (703, rows[5][1]), (100, rows[7][1]), (55, rows[9][1])]
    df = spark.createDataFrame([(*r, 3, 4) for r in rows], "vec_id long, embedding array<float>, rank int, score int").repartition(4)
    assert _got(df, 10, F.col("vec_id") % 100 == 0) == _brute(rows, 10, lambda i: i % 100 == 0)


@pytest.mark.parametrize("cell_bytes", [300, 3000, 1 << 20])
def test_cells_ties_and_few_candidates(spark, monkeypatch, cell_bytes):
    monkeypatch.setattr(topk, "CELL_BYTES", cell_bytes)
    rows = [(i, [float(i % 3), 1.0]) for i in range(25)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k in (4, 30):
        assert _got(df, k, F.col("vec_id") % 2 == 0) == _brute(rows, k, lambda i: i % 2 == 0)


def test_empty_and_without_queries(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert _got(df.limit(0), 3, F.lit(True)) == [] and _got(df, 3, F.col("vec_id") == 0) == []


def test_vectors_without_components(spark):
    df = spark.createDataFrame([(i, []) for i in range(4)], "vec_id long, embedding array<float>")
    assert _got(df, 2, F.col("vec_id") == 0) == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_queries_arrive_in_several_batches(spark, monkeypatch):
    """A cell's candidates and queries both span Arrow batches and tasks hold several cells."""
    monkeypatch.setattr(topk, "CELL_BYTES", 20_000)
    monkeypatch.setattr(topk, "text_session", lambda s: None)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=5))]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert _got(df, 5, F.col("vec_id") % 4 == 0) == _brute(rows, 5, lambda i: i % 4 == 0)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_bounds_hold_and_eliminate():
    rng = np.random.default_rng(3)
    centre = rng.integers(-2000, 2000, (8, 16)) * 8
    x = (centre[rng.integers(0, 8, 2000)] + rng.integers(-40, 40, (2000, 16))).astype(np.int64)
    pivots = topk._spread_out(x[:200], 16)
    far = topk._distances(x, pivots)
    for q in (0, 50):
        low = np.abs(far - far[q]).max(axis=1)
        square = (x.astype(float) ** 2).sum(axis=1)
        bound = (square[q] + square - low * low) / 2 + 1e-9 * (square[q] + square) + 1
        scores = x @ x[q]
        assert (bound >= scores).all()
        assert (bound >= np.sort(scores)[-10]).mean() < 0.5


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = documents(spark, SF_SMALL)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF_SMALL), "t")
        if name != "packing":
            assert out.columns == docs.columns
            ids = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all(ids[r["doc_id"]] == r["text"] for r in out.collect())
        seen.append(out.count())
        if name == "exact_dedup":
            best = {}
            for r in docs.collect():
                best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
            assert {r["doc_id"] for r in out.collect()} == set(best.values())
        if name == "packing":
            tokens = {}
            for r in docs.collect():
                tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + 1
            whole = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("one")).collect()
            assert {r["doc_id"]: r["n"] // r["one"] for r in whole} == tokens
        docs = out
    assert seen[0] == 200 and seen[1] <= seen[0] and seen[2] <= seen[1]


def test_run_equals_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    docs = documents(spark, SF_SMALL)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_SMALL), "t")
    assert sorted(map(str, rows)) == sorted(map(str, docs.collect()))


def test_stages_on_odd_and_empty_rows(spark, odd, empty):
    for table in (odd, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF_SMALL), "t")
            if name == "language_id" and table is odd:
                letters = [r["text"] for r in odd.collect() if any(c.isalpha() for c in r["text"] or "")]
                assert docs.count() >= len(letters) - 3 and langid.REJECT_BELOW < 0.1
