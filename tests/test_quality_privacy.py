"""Metrics, masking, retention, repairs on small frames."""

from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rowsmith.operators import constraints, privacy, quality, retention
from rowsmith.spec import FieldSpec, TableSpec, load_spec


def test_fk_integrity_counts_missing(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "k long")
    parent = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    r = quality.fk_integrity(child, parent, "k", "id", "c", "p").first()
    assert (r.child_distinct, r.missing_distinct, r.valid_fk_rate) == (3, 1, round(1 - 1 / 3, 4))
    empty = spark.createDataFrame([(None,)], "k long")
    assert quality.fk_integrity(empty, parent, "k", "id", "c", "p").first().valid_fk_rate == 1.0


def test_profile_treats_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "a"), (2.0, "b")], "x double, s string")
    got = {r.column_name: (r.null_fraction, r.distinct_count) for r in quality.column_profile(df, "t").collect()}
    assert got == {"x": (0.5, 2), "s": (0.25, 2)}


def test_correlation_matrix_shape(spark):
    df = spark.createDataFrame([(1, 2.0, True), (2, 4.0, False), (3, 6.5, True)], "a long, b double, c boolean")
    m = quality.correlation_matrix(df)
    assert m.count() == 9
    assert quality.correlation_matrix(df.select("a")).count() == 0


def test_masks(spark, duck):
    df = spark.createDataFrame([("Ann Lee", "ann@x.org", "12345")], "name string, email string, zip string")
    r = privacy.mask(df, ["name", "email", "zip"]).first()
    exp = duck.execute("SELECT sha256('Ann Lee'), 'user+' || substr(sha256('ann@x.org'), 1, 12) || '@example.com'").fetchall()[0]
    assert (r.name, r.email, r.zip) == (exp[0], exp[1], "123XX")
    audit = {x.column_name: x for x in privacy.mask_audit(df, ["name", "zip"]).collect()}
    assert audit["zip"].unchanged_rows == 0 and audit["name"].distinct_masked == 1


def test_pii_inventory(spark):
    from rowsmith.plans.registry import MEMBER_VISITS
    inv = {(r.table_name, r.column_name) for r in privacy.pii_inventory(spark, load_spec(MEMBER_VISITS)).collect()}
    assert inv == {("members", "member_name"), ("members", "email"), ("members", "zip_code")}


def test_metrics_fold_nan_and_take_all_columns(spark):
    rows = [(float(i), float(2 * i), *[float((i * k) % 7) for k in range(3, 16)]) for i in range(20)] + [(1.0, float("nan"), *[0.0] * 13)]
    cols = ["a", "b"] + [f"c{k}" for k in range(3, 16)]
    df = spark.createDataFrame(rows, cols)
    m = {(r.col_a, r.col_b): r["corr"] for r in quality.correlation_matrix(df).collect()}
    assert len(m) == 15 * 15 and m["a", "b"] == 1.0 and m["b", "b"] == 1.0


def test_fk_keys_of_unlike_types(spark):
    child = spark.createDataFrame([(1,), (2,)], "k int")
    big = spark.createDataFrame([(1,), (2**40,)], "id long")
    assert quality.fk_integrity(child, big, "k", "id", "c", "p").first().valid_fk_rate == 0.5
    part = spark.createDataFrame([(1.5,), (2.0,)], "id double")
    assert quality.fk_integrity(child, part, "k", "id", "c", "p").first().missing_distinct == 1
    text = spark.createDataFrame([("1",), ("x",)], "id string")
    assert quality.fk_integrity(child, text, "k", "id", "c", "p").first().missing_distinct == 1


def test_no_tables_is_an_error():
    for call in (lambda: quality.fk_integrity_all({}, []), lambda: quality.quality_report({}), lambda: quality.schema_profile({})):
        with pytest.raises(ValueError):
            call()


def test_profile_reads_a_table_once(spark):
    plan = quality.column_profile(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "orders")
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_masking_follows_flags_and_fails_closed(spark):
    df = spark.createDataFrame([("Ann", "a@x.org", 3)], "name string, email string, n int")
    spec = TableSpec("t", (FieldSpec("id", "integer"), FieldSpec("email", pii=True), FieldSpec("n", "integer")))
    out = privacy.mask(df, spec).first()
    assert out.name == "Ann" and out.email.startswith("user+") and out.n == 3
    with pytest.raises(ValueError):
        privacy.mask(df, ["e_mail"])
    with pytest.raises(ValueError):
        privacy.mask_audit(df, ["e_mail"])


def test_retention_does_not_depend_on_the_os_zone(spark):
    import os
    import time
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    before, counts = os.environ.get("TZ"), []
    try:
        for zone in ("UTC", "America/New_York"):
            os.environ["TZ"] = zone
            time.tzset()
            counts.append([retention.retain(x, "ts", datetime(2024, 1, 15, 12), 60).count()
                           for x in (e, e.withColumn("ts", F.col("ts").cast("timestamp")))])
    finally:
        os.environ.pop("TZ") if before is None else os.environ.update(TZ=before)
        time.tzset()
    assert counts[0] == counts[1] and counts[0][0] == counts[0][1]


def test_retain_boundary_is_expired(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 10, 0),), (datetime(2024, 1, 1, 10, 1),)], "created timestamp_ntz")
    out = retention.retain(df, "created", datetime(2024, 1, 1, 11, 0), 60).collect()
    assert [r.created for r in out] == [datetime(2024, 1, 1, 10, 1)]
    plan = retention.retain(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "ts",
                            datetime(2024, 1, 15), 60)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in plan


def test_conform_and_temporal_repair(spark):
    t = TableSpec("t", (FieldSpec("id", "integer"), FieldSpec("n", "integer"), FieldSpec("when", "datetime"),
                        FieldSpec("extra", "string")))
    raw = spark.createDataFrame([("1", "12.7", "2024-01-01 10:00:00", "zz")], "id string, n string, `when` string, junk string")
    r = constraints.conform(raw, t).first()
    assert (r.id, r.n, r.when, r.extra) == (1, 12, datetime(2024, 1, 1, 10, 0), None)
    df = spark.createDataFrame([(1, datetime(2024, 1, 2), datetime(2024, 1, 1)), (2, datetime(2024, 1, 1), datetime(2024, 1, 3))],
                               "id long, created_date timestamp, closed_date timestamp")
    out = {x.id: x for x in constraints.repair_temporal_order(df).collect()}
    gap = (out[1].closed_date - out[1].created_date).total_seconds() / 3600
    assert 1 <= gap <= 95 and out[2].closed_date == datetime(2024, 1, 3)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.floats(allow_nan=True, allow_infinity=False, width=32), st.none()), min_size=1, max_size=20),
       st.integers(-50, 0), st.integers(1, 50))
def test_integer_repair_clips(spark, values, lo, hi):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    out = [r.y for r in df.select(constraints.repair_integer_col("x", lo, hi).alias("y")).collect()]
    assert all(lo <= y <= hi for y in out)
    for v, y in zip(values, out):
        if v is None or v != v:
            assert y == max(lo, min(hi, 0))
        else:
            assert y == max(lo, min(hi, int(v)))   # exact integer, then clipped


def test_partitioned_write_compaction_and_registration(spark, tmp_path):
    import os
    from rowsmith.sources import io
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    src, dst = str(tmp_path / "part"), str(tmp_path / "compact")
    key = io.write_partitioned(li, src, "parquet", "l_shipdate", grain="year")
    assert key == "l_shipdate_year"
    io.compact(spark, src, dst, 64 << 20, "parquet", key)
    back = io.read_table(spark, dst).drop(key)
    assert back.exceptAll(li).count() == 0 and li.exceptAll(back).count() == 0
    for d in os.listdir(dst):
        if d.startswith(key + "="):
            assert 1 <= len([f for f in os.listdir(os.path.join(dst, d)) if f.endswith(".parquet")]) <= 1
    io.create_schema(spark, "rowsmith_t", str(tmp_path / "db"))
    name = io.register_table(spark, "slv_lineitem", dst, "parquet", "rowsmith_t")
    assert spark.table(name).count() == li.count()


def test_export_all_gzip_and_inferred_csv(spark, tmp_path):
    import os
    from rowsmith.sources import io
    tables = {"nation": spark.read.parquet("/root/testdata/sf0.001/nation.parquet"),
              "region": spark.read.parquet("/root/testdata/sf0.001/region.parquet")}
    paths = io.export_all(tables, str(tmp_path / "out"))
    for name, path in paths.items():
        assert any(f.endswith(".csv.gz") for f in os.listdir(path))
        typed = io.read_csv(spark, path, tables[name].schema)
        assert typed.exceptAll(tables[name]).count() == 0
        inferred = io.read_csv(spark, path)            # schema inference path
        assert inferred.count() == tables[name].count() and inferred.columns == tables[name].columns
    s = io.sample(tables["nation"], 500, ["n_nationkey"])
    assert s.count() == 25 and [r.n_nationkey for r in s.collect()] == sorted(r.n_nationkey for r in s.collect())


def test_csv_keeps_texts_and_microseconds(spark, tmp_path):
    from rowsmith.sources import io
    rows = [(1, 'say "hi"\n, \\ end\\', datetime(2024, 1, 1, 1, 2, 3, 123456)), (2, "", None), (3, None, datetime(2024, 1, 1)),
            (4, "  blanks ", None), (5, "a\r\nb\n\n", None), (6, '"', None), (7, "é😀,;|", None)]
    df = spark.createDataFrame(rows, "id long, t string, ts timestamp_ntz")
    for codec in (None, "gzip"):
        back = io.read_csv(spark, io.export_table(df, str(tmp_path / f"c{codec}"), "csv", codec), df.schema)
        assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_registration_follows_a_schema_change(spark, tmp_path):
    from rowsmith.sources import io
    path = str(tmp_path / "t")
    io.create_schema(spark, "rowsmith_r", str(tmp_path / "r"))
    spark.range(3).write.parquet(path)
    name = io.register_table(spark, "t", path, "parquet", "rowsmith_r")
    assert spark.table(name).columns == ["id"]
    spark.range(5).withColumn("more", F.lit("x")).write.mode("overwrite").parquet(path)
    io.register_table(spark, "t", path, "parquet", "rowsmith_r")
    assert spark.table(name).columns == ["id", "more"] and spark.table(name).count() == 5


def test_gold_keeps_a_column_named_like_a_partition_key(spark, tmp_path):
    from rowsmith.plans import medallion
    from rowsmith.sources import io
    df = spark.createDataFrame([(1, "a", datetime(2024, 1, 1).date(), 2.0), (2, "b", datetime(2024, 1, 2).date(), 4.0)],
                               "id long, ship string, ship_date date, cost double")
    ts = df.withColumn("at", F.col("ship_date").cast("timestamp_ntz")).withColumn("at_date", F.lit("mine")).select(
        "id", "at", "at_date", "cost")
    tables = {"x": df, "y": ts}
    csv = io.export_all(tables, str(tmp_path / "in"))
    outs = medallion.run_medallion(spark, csv, str(tmp_path / "m"), schemas={k: v.schema for k, v in tables.items()},
                                   primary_keys={"x": "id", "y": "id"}, compact_bytes=1 << 20, register_schema="rowsmith_m")
    assert set(spark.table("rowsmith_m.slv_x").columns) >= {"ship", "ship_date", "cost"}
    assert [r.at_date for r in spark.table("rowsmith_m.slv_y").collect()] == ["mine", "mine"]
    assert spark.read.parquet(outs["gld_x_summary"]).first().row_count == 2


def test_failed_registration_keeps_the_old_entry(spark, tmp_path):
    import pytest
    from rowsmith.sources import io
    io.create_schema(spark, "rowsmith_f", str(tmp_path / "f.db"))
    path, other = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(3).write.parquet(path)
    spark.range(4).selectExpr("id", "id AS x").write.parquet(other)
    name = io.register_table(spark, "t", path, schema_name="rowsmith_f")
    with pytest.raises(Exception):
        io.register_table(spark, "t", other, fmt="no_such_format", schema_name="rowsmith_f")
    assert spark.table(name).count() == 3
    assert spark.table(io.register_table(spark, "t", other, schema_name="rowsmith_f")).columns == ["id", "x"]
    assert [r["tableName"] for r in spark.sql("SHOW TABLES IN rowsmith_f").collect()] == ["t"]
    spark.sql("DROP SCHEMA rowsmith_f CASCADE")
