"""Dense index and foreign-key sampling."""

import pytest
from pyspark.sql import Window, functions as F

from rowsmith.operators import keys

SF = "/root/testdata/sf0.01"


def test_dense_index_equals_row_number(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey")
    idx, total = keys.dense_index(o, "o_orderkey", num_partitions=7)
    ref = o.withColumn("_rn", F.row_number().over(Window.orderBy("o_orderkey")))
    assert total.first()._n == 15000
    assert idx.join(ref, "o_orderkey").where(F.col("_idx") != F.col("_rn")).count() == 0
    plan = idx._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan


def test_sampling_closed_and_uniform(spark):
    child = spark.range(1, 20001).withColumnRenamed("id", "_row")
    parent = spark.createDataFrame([(i * 3,) for i in range(20)], "k long")
    out = keys.sample_foreign_key(child, parent, "fk", "k", "_row", 11, "c")
    counts = [r["count"] for r in out.groupBy("fk").count().collect()]
    assert out.count() == 20000 and len(counts) == 20
    assert min(counts) > 850 and max(counts) < 1150


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("n", [2, 4, 16, 200])
def test_sampling_loses_and_doubles_no_row(spark, partitions, n):
    """More parents than the range sample holds: the index is the rank and each child comes back once."""
    partitions(n)
    parent = spark.range(100_000).select((F.col("id") * 7 + 3).alias("k"), (F.col("id") % 13).alias("c"),
                                         F.lit("unread").alias("x"))
    idx, total = keys.dense_index(parent, "k")
    assert idx.where(F.col("_idx") != (F.col("k") - 3) / 7 + 1).isEmpty()
    assert total.first()._n == idx.select("_idx").distinct().count() == 100_000
    child = spark.range(1, 50_001).withColumnRenamed("id", "_row")
    for context in ((), ("c",)):
        out = keys.sample_foreign_key(child, parent, "fk", "k", "_row", 11, "c", context=context)
        got = out.agg(F.count("fk").alias("n"), F.countDistinct("_row").alias("d"), F.min((F.col("fk") - 3) % 7).alias("lo"),
                      F.max((F.col("fk") - 3) % 7).alias("hi")).first()
        assert (got.n, got.d, got.lo, got.hi) == (50_000, 50_000, 0, 0)
        if context:
            assert out.where(F.col("fk__c") != (F.col("fk") - 3) / 7 % 13).isEmpty()


@pytest.mark.parametrize("n", [2, 16])
def test_index_of_ties_and_null_keys(spark, partitions, n):
    """A key holding a third of the rows, and NULL keys: indexes are 1..n without gaps, in key order."""
    partitions(n)
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 5000).when(F.col("id") % 100 == 1, None)
                                    .otherwise(F.col("id")).alias("k"), "id")
    idx, total = keys.dense_index(df, "k")
    rows = idx.orderBy("_idx").collect()
    assert [r._idx for r in rows] == list(range(1, 30_001)) and total.first()._n == 30_000
    order = [-1 if r.k is None else r.k for r in rows]
    assert order == sorted(order)
    assert len({r.id for r in rows}) == 30_000
    out = keys.sample_foreign_key(spark.range(1, 9001).withColumnRenamed("id", "_row"), df, "fk", "k", "_row", 3, "c")
    assert out.count() == 9000 and out.where("fk is null").isEmpty()
    hot = out.where("fk = 5000").count()
    assert 2700 < hot < 3400        # its rows are a third of those that can be drawn, and a little more


def test_no_parent_with_a_key_draws_nothing(spark):
    child = spark.range(1, 10).withColumnRenamed("id", "_row")
    for rows in ([], [(None,)]):
        assert keys.sample_foreign_key(child, spark.createDataFrame(rows, "k long"), "fk", "k", "_row", 1, "c").isEmpty()
