"""Rule chain: window and grouped-pandas forms agree; plan shape; single rules."""

from pyspark.sql import functions as F

from rowsmith.operators import correlate
from rowsmith.plans import registry as R

SF = "/root/testdata/sf0.001"


def test_window_and_pandas_forms_agree(spark):
    uniq = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy(*R.LINE_KEY).count().where("count = 1").drop("count")
    w = R.q_rule_chain(spark, SF, method="window").join(uniq, list(R.LINE_KEY), "left_semi").alias("w")
    p = R.q_rule_chain(spark, SF, method="pandas").join(uniq, list(R.LINE_KEY), "left_semi").alias("p")
    keys = [F.col(f"w.{k}") == F.col(f"p.{k}") for k in R.LINE_KEY]
    cond = keys[0]
    for k in keys[1:]:
        cond = cond & k
    j = w.join(p, cond)
    r = j.agg(F.count(F.lit(1)), F.max(F.abs(F.col("w.l_extendedprice") - F.col("p.l_extendedprice"))),
              F.max(F.abs(F.col("w.l_tax") - F.col("p.l_tax"))),
              F.sum((F.col("w.is_large") != F.col("p.is_large")).cast("int"))).first()
    assert r[0] >= 5990 and r[1] <= 1e-3 and r[2] <= 1e-3 and r[3] <= 2


def test_window_chain_shares_one_exchange(spark):
    df = R.q_rule_chain(spark, SF, method="window")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_batch") == 1
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def test_no_rules_returns_input(spark):
    df = spark.range(5)
    assert correlate.apply_rules(df, [], R.LINE_SPEC) is df


def test_default_rules_from_names():
    from rowsmith.spec import load_spec
    visits = load_spec(R.MEMBER_VISITS).table("visits")
    rules = correlate.default_rules(visits)
    assert correlate.Rule("readmission_risk_score", "cost", "num_num", 0.35) in rules
    assert all(r.target not in ("id", "member_id") for r in rules)
    assert len(correlate.default_rules(visits, extra=[correlate.higher("x", "y")])) == len(rules)


def test_no_rule_is_cut():
    from rowsmith.spec import FieldSpec, TableSpec
    wide = TableSpec("w", (*[FieldSpec(f"age_{i}", "integer") for i in range(15)], *[FieldSpec(f"cost_{i}", "float") for i in range(15)]))
    own = correlate.higher("cost_1", "age_1")
    rules = correlate.default_rules(wide, extra=[own])
    assert len(rules) == 226 and rules[-1] == own


def test_presets_fit_the_table():
    from rowsmith.spec import FieldSpec, TableSpec
    t = TableSpec("o", (FieldSpec("age", "integer"), FieldSpec("order_value", "float"), FieldSpec("amount", "float")))
    assert correlate.preset_rules(t, "older_higher_value")[-1] == correlate.Rule("age", "order_value", "num_num", 0.50)
    assert correlate.preset_rules(t, "fraud_amount") == correlate.default_rules(t)


def test_whole_table_statistics_are_literals(spark):
    df = correlate.zscore(R.lineitem_keyed(spark, SF), "l_quantity")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Subquery" not in plan
    r = df.agg(F.avg("l_quantity_z"), F.stddev_samp("l_quantity_z")).first()
    assert abs(r[0]) < 1e-9 and abs(r[1] - 1) < 1e-9


def test_plan_grows_by_the_same_amount_per_rule(spark):
    base = R.lineitem_keyed(spark, SF).withColumn("l_tax", F.when(F.col("l_returnflag") != "R", F.col("l_tax")))
    rule = correlate.higher("l_quantity", "l_tax")
    scans = []
    for n in (1, 2, 4, 6):
        out = correlate.apply_rules(base, [rule] * n, R.LINE_SPEC, None, 42, "_k", "portable", repair_order=False)
        scans.append(out._jdf.queryExecution().analyzed().toString().count("Relation "))
    assert scans == [1, 1, 1, 1]


def test_whole_median_is_exact(spark, monkeypatch):
    import random
    import statistics
    monkeypatch.setattr(correlate, "MEDIAN_ROWS", 50)
    rnd = random.Random(4)
    cases = [[rnd.gauss(0, 1) for _ in range(n)] for n in (1, 2, 51, 3000)]
    cases += [[float(rnd.randrange(4)) for _ in range(2001)], [1.0] * 300 + [2.0] * 300, [1.0] * 299 + [5.0] * 301, [0.0] * 500 + [rnd.random() for _ in range(500)]]
    for values in cases:
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        assert correlate.whole_median(df, "x") == statistics.median(values)
    assert correlate.whole_median(spark.createDataFrame([], "x double"), "x") is None


def test_whole_table_chain_with_checkpoints_matches(spark):
    base = R.lineitem_keyed(spark, SF).withColumn("is_large", F.lit(False))
    rules = R.chain_rules()
    plain = correlate.apply_rules(base, rules, R.LINE_SPEC, None, 42, "_k", "portable", fill_median=False)
    cut = correlate.apply_rules(base, rules, R.LINE_SPEC, None, 42, "_k", "portable", fill_median=False,
                                checkpoint_every=2)
    cols = list(R.LINE_KEY) + ["l_extendedprice", "l_tax", "is_large"]
    assert plain.select(*cols).exceptAll(cut.select(*cols)).count() == 0


def jobs_of(spark, run):
    """Number of Spark jobs that ``run`` starts."""
    sc, group = spark.sparkContext, f"count-{id(run)}"
    sc.setJobGroup(group, "count")
    run()
    sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_ten_whole_table_rules_take_few_jobs(spark):
    assert jobs_of(spark, lambda: R.q_whole_table_rules(spark, SF).write.format("noop").mode("overwrite").save()) <= 12


def test_parent_influence_has_one_join(spark):
    out = R.q_parent_influence(spark, SF)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert jobs_of(spark, lambda: R.q_parent_influence(spark, SF)) <= 6


def _feeding():
    """Rules whose targets are sources of later ones, with flags, missing numbers and NaN."""
    from rowsmith.spec import FieldSpec, TableSpec
    spec = TableSpec("f", (FieldSpec("a", "float"), FieldSpec("b", "float", min_value=-2, max_value=40), FieldSpec("c", "integer"),
                           FieldSpec("d", "boolean"), FieldSpec("e", "string"), FieldSpec("n", "float")))
    rules = [correlate.higher("a", "b"), correlate.higher("b", "c"), correlate.more_likely("c", "d"),
             correlate.Rule("d", "a", "bool_num", 0.5), correlate.Rule("e", "b", "bool_num", 0.2, "negative"),
             correlate.higher("a", "b"), correlate.higher("n", "a"), correlate.higher("b", "n")]
    return spec, rules


def test_fused_chain_equals_the_window_form(spark):
    import random
    rnd = random.Random(8)
    spec, rules = _feeding()
    maybe = lambda x: None if rnd.random() < 0.2 else x
    rows = [(i, maybe(rnd.gauss(5, 3)), rnd.choice([float("nan"), rnd.gauss(20, 9)]), maybe(rnd.randint(0, 50)),
             maybe(rnd.random() < 0.5), rnd.choice(["", "x", None]), None, 1) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c long, d boolean, e string, n double, one int").repartition(3)
    for fill in (True, False):
        whole = correlate.apply_rules(df, rules, spec, None, 42, "id", "portable", fill, repair_order=False)
        window = correlate.apply_rules(df, rules, spec, ("one",), 42, "id", "portable", fill, repair_order=False)
        assert whole.columns == df.columns
        both = whole.alias("x").join(window.alias("y"), "id").collect()
        assert len(both) == 700
        for r in both:
            x, y = r[1:8], r[8:15]
            assert all(p == q or isinstance(p, (int, float)) and abs(p - q) <= 1.01e-4 for p, q in zip(x, y)), (x, y)
    empty = correlate.apply_rules(df.limit(0), rules, spec, None, 42, "id", "portable", repair_order=False)
    assert empty.collect() == []


def test_rounds_end_where_a_changed_column_is_needed():
    from rowsmith.operators import fused
    spec, rules = _feeding()
    steps = correlate.rule_steps(rules, spec)
    assert fused.rounds(steps) == [0, 1, 2, 5, 7]
    assert fused.rounds(correlate.rule_steps(R.whole_table_rules(), R.LINE_SPEC)) == [0, 2, 4, 6, 8]
    s = fused.Sums(10, 4, 2.5, 5.0).filled(0.0)          # 1, 2, 3, 4 and six zeros
    assert (s.n, s.missing, s.mean) == (10, 0, 1.0) and abs(s.squares - 20.0) < 1e-12 and fused.Sums(1, 1, 3.0, 0.0).deviation == 0
