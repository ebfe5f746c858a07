"""Mergeable co-moments and sketches; exact sorted temporal columns."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowsmith.operators import moments, quality

SF = "/root/testdata/sf0.001"


def numbers(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a = rnd.gauss(0, 1)
        out.append((1e9 + a, rnd.choice([None, float("nan"), 3 * a + rnd.gauss(0, 1)]), 7.25, i if rnd.random() < 0.5 else None, rnd.random() < 0.3, None))
    return out


SCHEMA = "a double, b double, const double, i long, flag boolean, none double"
NAMES = ["a", "b", "const", "i", "flag", "none"]


def brute(rows, a, b):
    pairs = [(float(r[a]), float(r[b])) for r in rows if r[a] is not None and r[b] is not None and not math.isnan(r[a]) and not math.isnan(r[b])]
    if len(pairs) < 2:
        return None
    x, y = np.array(pairs).T
    x, y = x - x[0], y - y[0]
    if np.ptp(x) == 0 or np.ptp(y) == 0:
        return None
    return round(float(np.corrcoef(x, y)[0, 1]), 4)


def test_one_scan_equals_pairwise_correlation(spark):
    rows = numbers(1, 3000)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in quality.correlation_matrix(df).collect()}
    assert len(got) == 36
    for (a, b), v in got.items():
        want = brute(rows, NAMES.index(a), NAMES.index(b))
        assert v == want or abs(v - want) <= 1.01e-4, (a, b, v, want)
    plan = quality.correlation_matrix(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_stored_state_and_new_rows_equal_a_full_run(spark, tmp_path):
    rows = numbers(2, 2000)
    old, new = spark.createDataFrame(rows[:1500], SCHEMA), spark.createDataFrame(rows[1500:], SCHEMA)
    moments.comoments(old, NAMES).write.parquet(str(tmp_path / "state"))
    merged = moments.merge_comoments(spark.read.parquet(str(tmp_path / "state")), moments.comoments(new, NAMES))
    full = {(r["col_a"], r["col_b"]): r for r in moments.comoments(old.unionByName(new), NAMES).collect()}
    assert len(full) == 21
    for r in merged.collect():
        f = full[r["col_a"], r["col_b"]]
        assert (r["rows"], r["n"]) == (f["rows"], f["n"]) and f["rows"] == 2000
        for k in ("mean_a", "mean_b", "m2_a", "m2_b"):      # doubles near 1e9 lie 1e-7 apart
            assert math.isclose(r[k], f[k], rel_tol=1e-8, abs_tol=1e-6)
        assert abs(r["c"] - f["c"]) <= 1e-8 * math.sqrt(f["m2_a"] * f["m2_b"])
        if "const" in (r["col_a"], r["col_b"]):
            assert r["c"] == 0 and (r["m2_a"] == 0 or r["m2_b"] == 0)


def test_no_rows_and_many_columns(spark):
    empty = quality.correlation_matrix(spark.createDataFrame([], SCHEMA)).collect()
    assert len(empty) == 36 and {r["corr"] for r in empty} == {None}
    wide = spark.range(50).select(*[(F.col("id") * (i % 7) + F.pmod(F.col("id") * 31, F.lit(i + 2))).alias(f"c.{i}") for i in range(60)])
    assert quality.correlation_matrix(wide).count() == 3600
    assert quality.correlation_matrix(wide.select("`c.1`")).collect() == []


def test_sketches_merge_and_are_near_the_exact_counts(spark, tmp_path):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    by_flag = moments.profile_state(li, "lineitem", by=["l_returnflag"])
    by_flag.where("l_returnflag <> 'R'").write.parquet(str(tmp_path / "state"))
    stored = spark.read.parquet(str(tmp_path / "state"))
    state = moments.merge_profiles(stored, by_flag.where("l_returnflag = 'R'"))
    got = {r["column_name"]: r for r in moments.profile(state).collect()}
    exact = {r["column_name"]: r for r in quality.column_profile(li.drop("l_returnflag"), "lineitem", with_rows=True).collect()}
    assert set(got) == set(exact)
    for c, e in exact.items():
        assert (got[c]["rows"], got[c]["null_fraction"]) == (e["rows"], e["null_fraction"])
        assert abs(got[c]["distinct_count"] - e["distinct_count"]) <= 0.03 * e["distinct_count"]
    plan = by_flag._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("FileScan") == 1


def test_sketches_take_integers_computed_before_them(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    plan = moments.profile_state(li, "lineitem", by=["l_returnflag"])._jdf.queryExecution().optimizedPlan().toString()
    head = next(line for line in plan.splitlines() if "Aggregate" in line)
    assert "hll_sketch_agg(__v0#" in head and "xxhash64" not in head and "cast(" not in plan.split("Aggregate", 1)[1]
    rows = [("", 0.0, "a", b"", 1), ("x", -0.0, "A", b"\0", 2), ("x", float("nan"), "b", None, 3), (None, 1e-300, None, b"", None)]
    odd = spark.createDataFrame(rows, "s string, f double, c string, b binary, i int").withColumns({
        "c": F.collate("c", "UTF8_LCASE"), "t": F.timestamp_seconds("i"), "n": F.col("i").cast("decimal(30,2)"),
        "__v1": F.col("i").cast("tinyint")})
    got = {r["column_name"]: r for r in moments.profile(moments.profile_state(odd, "t")).collect()}
    exact = {r["column_name"]: r for r in quality.column_profile(odd, "t").collect()}
    assert {c: (r["distinct_count"], r["null_fraction"]) for c, r in got.items()} == \
        {c: (r["distinct_count"], r["null_fraction"]) for c, r in exact.items()}
    assert [got[c]["distinct_count"] for c in ("s", "f", "c", "b")] == [2, 2, 2, 2]


def test_report_with_named_exact_columns(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").withColumn("x", F.when(F.col("o_orderkey") % 2 == 0, float("nan")).otherwise(-0.0))
    exact = {r["column_name"]: r for r in quality.quality_report({"orders": o}).collect()}
    some = quality.quality_report({"orders": o}, exact={"orders": ["o_custkey"]})
    got = {r["column_name"]: r for r in some.collect()}
    assert set(got) == set(exact) and some.columns == quality.quality_report({"orders": o}).columns
    for c, e in exact.items():
        assert abs(got[c]["distinct_count"] - e["distinct_count"]) <= (0 if c == "o_custkey" else 0.03 * e["distinct_count"])
        assert (got[c]["null_fraction"], got[c]["rows"], got[c]["columns"]) == (e["null_fraction"], e["rows"], e["columns"])
    assert got["x"]["distinct_count"] == 1 and got["x"]["null_fraction"] == 0.5
    nested = spark.createDataFrame([([1.0, 2.0], True, None), ([1.0, 2.0], False, None), (None, None, None)], "v array<float>, b boolean, d date")
    counts = {r["column_name"]: r["distinct_count"] for r in quality.quality_report({"t": nested}, exact={}).collect()}
    assert counts == {"v": 1, "b": 2, "d": 0}
    empty = {r["column_name"]: r for r in quality.quality_report({"t": nested.limit(0)}, exact={}).collect()}
    assert all((r["rows"], r["distinct_count"], r["null_fraction"]) == (0, 0, 0.0) for r in empty.values())


@pytest.mark.parametrize("batched", [True, False])
def test_exact_order_equals_numpys_sorted_draws(spark, batched):
    from rowsmith.functions.fields import DAYS_BACK, GenContext, field_column
    from rowsmith.spec import FieldSpec
    n, size = 2500, 700
    rows = spark.range(1, n + 1).withColumnRenamed("id", "_row").repartition(4)
    ctx = GenContext("v", 42, datetime(2024, 2, 1), "portable", n, size, batched, exact=True)
    date, time = field_column(FieldSpec("signup_date", "date"), ctx), field_column(FieldSpec("created_at", "timestamp"), ctx)
    out = ctx.finish(ctx.prepare(rows).select("_row", date.alias("d"), time.alias("t"), *[c for c in ctx.sorted_draws.values()],
                                              *[u for u in ctx.sorted_draws]))
    us = ctx.prepare(rows).select("_row", *ctx.sorted_draws, *ctx.sorted_draws.values()).orderBy("_row").collect()
    step = size if batched else n
    for u, s in ctx.sorted_draws.items():
        for at in range(0, n, step):
            part = us[at:at + step]
            assert [r[s] for r in part] == np.sort([r[u] for r in part]).tolist()
    got = out.orderBy("_row").collect()
    assert len(got) == n and set(out.columns) == {"_row", "d", "t"}
    first = next(iter(ctx.sorted_draws.values()))
    days = [(datetime(2024, 2, 1).date() - r["d"]).days for r in got]
    assert days == [DAYS_BACK - 1 - math.floor(r[first] * DAYS_BACK) for r in us]
