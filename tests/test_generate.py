"""Generation: statistical checks, reproducibility, batching, keys."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rowsmith.operators import quality
from rowsmith.operators.generate import Generated, generate_table, generate_tables
from rowsmith.plans.registry import MEMBER_VISITS
from rowsmith.spec import FieldSpec, TableSpec, load_spec

AS_OF = datetime(2024, 2, 1)


def members_and_visits(spark, rows=3000, **kw):
    doc = {"tables": [dict(t) for t in MEMBER_VISITS["tables"]]}
    return generate_tables(spark, load_spec(doc), rows, seed=42, as_of=AS_OF, **kw)


def test_correlations_and_integrity(spark):
    tables = members_and_visits(spark)
    members, visits = tables["members"].cache(), tables["visits"].cache()
    assert members.count() == 3000 and visits.count() == 3000
    assert visits.join(members, visits.member_id == members.id, "left_anti").count() == 0
    merged = visits.alias("c").join(members.alias("p"), F.col("c.member_id") == F.col("p.id"))
    r = merged.agg(F.corr("p.age", "c.cost").alias("a"), F.corr("p.age", "c.length_of_stay").alias("b"),
                   F.corr("p.comorbidity_count", "c.readmission_risk_score").alias("c")).first()
    assert r.a > 0.10 and r.b > 0.08 and r.c > 0.10
    rates = {x.check_name: x.pass_rate for x in quality.pattern_rates(
        members, quality.standard_checks("zip_code", "member_name", "email")).collect()}
    assert rates["zip_5_digits"] == 1.0
    assert rates["name_has_space"] > 0.9 and rates["email_has_at"] > 0.95


def test_same_output_for_any_partitioning(spark):
    t = load_spec(MEMBER_VISITS).table("members")
    a = generate_table(spark, t, 5000, seed=7, as_of=AS_OF, rows_per_partition=5000)
    b = generate_table(spark, t, 5000, seed=7, as_of=AS_OF, rows_per_partition=700)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_bounds_and_distributions(spark):
    t = TableSpec("x", (FieldSpec("id", "integer"), FieldSpec("age", "integer", min_value=18, max_value=20),
                        FieldSpec("item_count", "integer", min_value=0, max_value=12),
                        FieldSpec("success_rate", "float", min_value=0, max_value=1),
                        FieldSpec("unit_price", "float", min_value=5, max_value=50),
                        FieldSpec("is_fraud", "boolean"), FieldSpec("plan", allowed_values=("a", "b")),
                        FieldSpec("fixed", "float", min_value=3, max_value=3)))
    df = generate_table(spark, t, 20000, seed=1, as_of=AS_OF, rules=[])
    r = df.agg(F.min("age"), F.max("age"), F.countDistinct("age"), F.min("item_count"), F.max("item_count"),
               F.avg("item_count"), F.min("success_rate"), F.max("success_rate"), F.avg("success_rate"),
               F.min("unit_price"), F.max("unit_price"), F.avg(F.col("is_fraud").cast("double")),
               F.countDistinct("plan"), F.min("fixed"), F.max("fixed")).first()
    assert (r[0], r[1], r[2]) == (18, 20, 3)
    assert r[3] >= 0 and r[4] <= 12 and 1.8 < r[5] < 2.2            # Poisson(2) clipped
    assert 0 <= r[6] and r[7] <= 1 and abs(r[8] - 2.2 / 5.8) < 0.01  # Beta(2.2, 3.6) mean
    assert r[9] >= 5 and r[10] <= 50
    assert 0.16 < r[11] < 0.20
    assert r[12] == 2 and r[13] == r[14] == 3.0


def test_batched_table_and_ordered_dates(spark):
    t = TableSpec("ev", (FieldSpec("id", "integer"), FieldSpec("created_at", "timestamp"),
                         FieldSpec("signup_date", "date"), FieldSpec("amount", "float")))
    df = generate_table(spark, t, 120_000, seed=3, as_of=AS_OF, keep_batch=True, rules=[])
    assert df.select("_batch").distinct().count() == 5
    from pyspark.sql import Window
    w = Window.partitionBy("_batch").orderBy("id")
    bad = df.withColumn("prev", F.lag("created_at").over(w)).where(F.col("prev") > F.col("created_at")).count()
    assert bad == 0
    r = df.agg(F.min("signup_date"), F.max("signup_date"), F.max("created_at")).first()
    assert (AS_OF.date() - r[0]).days <= 729 and r[1] <= AS_OF.date() and r[2] <= AS_OF


def test_fk_to_arbitrary_parent_key(spark):
    parent = spark.createDataFrame([(f"k{i}", i * 10) for i in range(50)], "code string, age long")
    t = TableSpec("child", (FieldSpec("id", "integer"), FieldSpec("code", "string"), FieldSpec("cost", "float")),
                  foreign_keys=(__import__("rowsmith.spec", fromlist=["ForeignKey"]).ForeignKey("code", "p", "code"),))
    df = generate_table(spark, t, 2000, parents={"p": parent}, seed=5, as_of=AS_OF)
    assert df.count() == 2000
    assert df.join(parent, "code", "left_anti").count() == 0
    assert df.select("code").distinct().count() > 40


def test_self_reference_falls_back(spark):
    spec = load_spec({"tables": [{"name": "emp", "fields": [
        {"name": "id", "type": "integer"}, {"name": "boss", "type": "integer", "foreign_key": "emp.id"}]}]})
    df = generate_tables(spark, spec, 100, as_of=AS_OF)["emp"]
    assert df.count() == 100 and df.where(F.col("boss").isNull()).count() == 0


def test_generated_parent_context_needs_no_join(spark):
    from rowsmith.operators.generate import generate
    spec = load_spec(MEMBER_VISITS)
    pat = generate(spark, spec.table("members"), 3000, seed=42, as_of=AS_OF)
    assert pat.modified == frozenset()
    visits = generate_table(spark, spec.table("visits"), 3000, parents={"members": pat}, seed=42, as_of=AS_OF)
    plan = visits._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan      # no join, no shuffle of rows
    w = generate_table(spark, spec.table("visits"), 3000, parents={"members": pat}, seed=42, as_of=AS_OF,
                       rule_method="window")
    assert visits.exceptAll(w).count() == 0 and w.exceptAll(visits).count() == 0
    # the re-evaluated context equals the joined parent values
    a = visits.select("member_id").join(pat.df.select(F.col("id").alias("member_id"), "age"), "member_id")
    assert a.count() == 3000


def test_plain_generation_is_one_projection(spark):
    t = TableSpec("x", (FieldSpec("id", "integer"), FieldSpec("age", "integer"), FieldSpec("email"),
                        FieldSpec("created_at", "timestamp")))
    plan = generate_table(spark, t, 1000, as_of=AS_OF, rules=[])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_chain_with_joined_parent_falls_back_and_matches_windows(spark):
    from rowsmith.spec import ForeignKey
    parent = spark.range(0, 300).select(F.col("id").alias("pid"), (F.col("id") % 90).alias("age"))
    t = TableSpec("visits", (FieldSpec("id", "integer"), FieldSpec("pid", "integer"), FieldSpec("cost", "float"),
                             FieldSpec("risk_score", "float"), FieldSpec("visit_count", "integer")),
                  foreign_keys=(ForeignKey("pid", "people", "pid"),))
    a = generate_table(spark, t, 130_000, parents={"people": parent}, seed=9, as_of=AS_OF)
    b = generate_table(spark, t, 130_000, parents={"people": parent}, seed=9, as_of=AS_OF, rule_method="window")
    assert "MapInPandas" not in a._jdf.queryExecution().executedPlan().toString()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_partition_chain_equals_windows_when_batched(spark):
    spec = load_spec(MEMBER_VISITS)
    from rowsmith.operators.generate import generate
    pat = generate(spark, spec.table("members"), 60_000, seed=3, as_of=AS_OF)
    a = generate_table(spark, spec.table("visits"), 130_000, parents={"members": pat}, seed=3, as_of=AS_OF)
    b = generate_table(spark, spec.table("visits"), 130_000, parents={"members": pat}, seed=3, as_of=AS_OF,
                       rule_method="window")
    assert "Exchange" not in a._jdf.queryExecution().executedPlan().toString()
    diff = a.alias("a").join(b.alias("b"), "id").agg(
        F.max(F.abs(F.col("a.cost") - F.col("b.cost"))), F.max(F.abs(F.col("a.length_of_stay") - F.col("b.length_of_stay")))).first()
    assert diff[0] <= 1e-4 and diff[1] == 0


def test_batches_are_one_scope_at_every_size(spark):
    t = TableSpec("ev", (FieldSpec("id", "integer"), FieldSpec("created_at", "timestamp")))
    small, large = (generate_table(spark, t, n, seed=3, as_of=AS_OF, batch_rows=1000, keep_batch=True, rules=[]) for n in (2500, 200_000))
    assert small.select("_batch").distinct().count() == 3 and large.select("_batch").distinct().count() == 200
    assert small.where("id <= 2000").exceptAll(large).count() == 0


def test_no_rows(spark):
    spec = load_spec(MEMBER_VISITS)
    assert generate_table(spark, spec.table("members"), 0, as_of=AS_OF).count() == 0


def test_given_rows_and_parents_are_read(spark):
    from rowsmith.plans import registry as R
    df = R.q_gen_claims(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    # parents are ranked and written once, before the plan that joins them
    assert "orders.parquet" in plan and "rowsmith-ranked" in plan and "Range (" not in plan
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    assert df.join(customers, df.customer_id == customers.c_custkey, "left_anti").isEmpty()
    assert df.select("customer_id").distinct().count() > 0.9 * customers.count()
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_unknown_provider_is_refused(spark):
    with pytest.raises(ValueError):
        generate_table(spark, TableSpec("x", (FieldSpec("id", "integer"), FieldSpec("c", faker="no_such"))), 3, as_of=AS_OF)
    names = ("company", "street_address", "state", "job", "sentence", "currency_code")
    t = TableSpec("x", (FieldSpec("id", "integer"), *[FieldSpec(n, faker=n) for n in names], FieldSpec("born", "date", faker="date_of_birth")))
    rows = generate_table(spark, t, 200, seed=2, as_of=AS_OF, rules=[]).collect()
    assert all(r[n] for r in rows for n in names) and len({r.company for r in rows}) > 50
    assert all(18 <= (AS_OF.date() - r.born).days / 365.25 <= 91 for r in rows)
