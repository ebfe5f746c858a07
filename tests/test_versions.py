"""Compaction and purge by versions, evolving schemas."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F, types as T

from rowsmith.operators.retention import retain
from rowsmith.sources import evolve, io, versions

SF = "/root/testdata/sf0.001"


def same(a, b):
    b = b.select(*a.columns)
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def loose_table(spark, path, n=3):
    """Events by day in two appends of n files a day."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    keyed, key, _ = io.with_partition_key(e, "ts")
    for half in range(2):
        keyed.where(F.col("event_id") % 2 == half).repartition(n).write.mode("append").partitionBy(key).parquet(path)
    return e


def test_pack_fills_bins_and_leaves_large_files():
    f = lambda folder, name, size: ("/t", f"file:/t/p={folder}/{name}", size, "")
    files = [f("a", "1", 60), f("a", "2", 40), f("a", "3", 30), f("a", "4", 90), f("b", "5", 10), f("c", "6", 20), f("c", "7", 5)]
    bins = [sorted(x[1][-1] for x in b) for b in versions.pack(files, 100)]
    assert bins == [["1", "2"], ["6", "7"]]              # 3 stands alone, 4 is large enough, 5 is alone in its folder
    assert versions.partition_of(("/t", "file:/t/p=a%20b/q=2024-01-01/x", 1, "")) == {"p": "a b", "q": "2024-01-01"}


def test_compaction_touches_small_files_only(spark, tmp_path):
    path = str(tmp_path / "events")
    e = loose_table(spark, path)
    before = versions.entries(spark, path)
    target = int(sorted(f[2] for f in before)[-1] * 3)
    big = [f for f in before if f[2] >= 0.75 * target]
    assert versions.current_version(spark, path) == 0 and len(before) > 4
    assert versions.compact_in_place(spark, path, target) == 1
    after = versions.entries(spark, path)
    assert len(after) < len(before) and {f[1] for f in big} <= {f[1] for f in after}
    assert all(f[2] <= 1.3 * target for f in after)
    assert same(e, versions.read_version(spark, path)) and same(e, versions.read_version(spark, path, 0))
    assert same(e, spark.read.parquet(path).drop("ts_date"))            # plain scans keep version 0
    # later versions build on it (merged files of this size shed their footers, so a few more fit together)
    assert versions.compact_in_place(spark, path, 50 * target) == 2
    assert versions.compact_in_place(spark, path, 50 * target) == 2     # nothing is left to merge
    days = {str(versions.partition_of(f)) for f in after}
    assert len(versions.entries(spark, path)) == len(days)
    assert same(e, versions.read_version(spark, path))


def test_large_files_are_untouched(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(20_000).coalesce(1).write.parquet(path)
    spark.range(20_000, 20_030).repartition(3).write.mode("append").parquet(path)
    files = versions.entries(spark, path)
    large = max(files, key=lambda f: f[2])
    versions.compact_in_place(spark, path, large[2])
    after = versions.entries(spark, path)
    assert len(after) == 2 and large[1] in {f[1] for f in after}
    assert versions.read_version(spark, path).distinct().count() == 20_030


def test_failure_between_the_steps_keeps_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "events")
    e = loose_table(spark, path)
    commit = versions._commit
    monkeypatch.setattr(versions, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("executor driver lost")))
    with pytest.raises(RuntimeError):
        versions.compact_in_place(spark, path, 1 << 30)
    assert versions.current_version(spark, path) == 0 and same(e, versions.read_version(spark, path))
    (tmp_path / "events" / "_versions" / "1").mkdir(parents=True)        # a list that was begun, not completed
    assert versions.current_version(spark, path) == 0
    (tmp_path / "events" / "_versions" / "1").rmdir()
    monkeypatch.setattr(versions, "_commit", commit)
    assert versions.compact_in_place(spark, path, 1 << 30) == 1 and same(e, versions.read_version(spark, path))
    gone = versions.vacuum(spark, path, keep=1)
    assert len(gone) > 5 and same(e, versions.read_version(spark, path))
    assert versions.vacuum(spark, path, keep=2) == []


def test_partition_values_of_any_spelling(spark, tmp_path):
    path = str(tmp_path / "odd")
    df = spark.createDataFrame([(i, ["a b", "x/y=z", "50%", "é:ü", None][i % 5]) for i in range(50)], "id long, p string")
    for _ in range(2):
        df.where(F.col("id") % 2 == _).repartition(2).write.mode("append").partitionBy("p").parquet(path)
    assert versions.compact_in_place(spark, path, 1 << 30) == 1
    assert len(versions.entries(spark, path)) == 5 and same(df, versions.read_version(spark, path))


@pytest.mark.parametrize("grain", ["day", "month"])
def test_purge_rewrites_one_partition(spark, tmp_path, grain):
    path = str(tmp_path / "events")
    e = spark.read.parquet(f"{SF}/events.parquet")
    e = e.unionByName(e.limit(3).withColumn("ts", F.lit(None).cast(e.schema["ts"].dataType)))
    io.write_partitioned(e, path, column="ts", grain=grain)
    key = "ts_date" if grain == "day" else "ts_month"
    as_of = datetime(2024, 1, 15, 12)
    before = {f[1] for f in versions.entries(spark, path)}
    assert versions.purge(spark, path, "ts", as_of, 60, key, grain) == 1
    got, want = versions.read_version(spark, path), retain(e, "ts", as_of, 60)
    assert same(want, got)
    fresh = [f for f in versions.entries(spark, path) if f[1] not in before]
    assert len({str(versions.partition_of(f)) for f in fresh}) <= 1
    assert versions.purge(spark, path, "ts", datetime(2000, 1, 1), 60, key, grain) == 1          # nothing has expired
    versions.purge(spark, path, "ts", datetime(2100, 1, 1), 60, key, grain)
    assert versions.read_version(spark, path).count() == 0 and versions.read_version(spark, path).columns == [*e.columns, key]


def test_widening_rules():
    w = evolve.widened
    assert w(T.IntegerType(), T.LongType()) == w(T.LongType(), T.ByteType()) == T.LongType()
    assert w(T.FloatType(), T.DoubleType()) == w(T.IntegerType(), T.DoubleType()) == T.DoubleType()
    assert w(T.DecimalType(10, 2), T.DecimalType(8, 4)) == T.DecimalType(12, 4)
    assert w(T.DateType(), T.TimestampNTZType()) == T.TimestampNTZType()
    for a, b in ((T.LongType(), T.DoubleType()), (T.StringType(), T.LongType()), (T.BooleanType(), T.IntegerType()),
                 (T.DecimalType(38, 0), T.DecimalType(38, 10))):
        with pytest.raises(evolve.SchemaConflict):
            w(a, b, "c")


def test_loads_add_and_widen_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, datetime(2024, 1, 1), 1.5), (2, datetime(2024, 2, 1), 2.5)], "id int, ts timestamp_ntz, x float")
    b = spark.createDataFrame([(2**40, datetime(2024, 2, 1, 5), "n"), (3, datetime(2024, 3, 1), None)], "ID long, ts timestamp_ntz, note string")
    evolve.load(a, path, "ts", "month")
    evolve.load(b, path, "ts", "month", mode="partitions")       # February is replaced, January stays
    rows = {r["id"]: (r["x"], r["note"]) for r in evolve.read(spark, path).collect()}
    assert rows == {1: (1.5, None), 2**40: (None, "n"), 3: (None, None)}
    c = spark.createDataFrame([(7, 0.1)], "id long, x double").withColumn("ts", F.lit(datetime(2024, 3, 2)).cast("timestamp_ntz"))
    evolve.load(c, path, "ts", "month")
    got = evolve.read(spark, path)
    assert got.count() == 4 and dict(got.dtypes)["x"] == "double" and got.where("id = 7").first()["x"] == 0.1
    assert [len(s.fields) for s in evolve.schema_log(spark, path)] == [4, 5, 5]
    assert evolve.read(spark, path, 1).columns == ["id", "ts", "x", "ts_month"]
    with pytest.raises(evolve.SchemaConflict):
        evolve.load(c.withColumn("id", F.lit("text")), path, "ts", "month")
    with pytest.raises(evolve.SchemaConflict):
        evolve.load(c, path, "ts", "day")
    assert evolve.read(spark, path).count() == 4                 # a refused load wrote nothing
    evolve.load(a, path, "ts", "month", mode="overwrite")
    assert evolve.read(spark, path).columns == ["id", "ts", "x", "ts_month"] and evolve.read(spark, path).count() == 2
    assert len(evolve.schema_log(spark, path)) == 4
