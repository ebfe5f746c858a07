"""Registered queries over the given tables (``/root/testdata/sf*/<table>.parquet``).

Each entry is ``fn(spark, sf_dir) -> DataFrame`` and runs a library operator over
whole tables; ``rowsmith.plans.oracle`` holds the matching DuckDB SQL. Reported
averages and statistics are rounded to 6 digits (money-scale results to 4), the
same in both, so two engines' summation orders cannot flip a value.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowsmith.functions import rng
from rowsmith.functions.fields import GenContext, field_column
from rowsmith.operators import constraints, correlate, keys, moments, privacy, quality, retention
from rowsmith.operators.correlate import Rule
from rowsmith.operators.generate import generate_table
from rowsmith.plans import medallion
from rowsmith.session import scratch_path, written
from rowsmith.sources import evolve, io, versions
from rowsmith.spec import FieldSpec, ForeignKey, TableSpec, load_spec
from rowsmith.streaming import events as ev

SEED = 42
AS_OF = datetime(2024, 2, 1, 0, 0, 0)
RELATIONAL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
ALL_TABLES = RELATIONAL + ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
LINE_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
FK_EDGES = (
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("events", "user_id", "customer", "c_custkey"),
)
LINE_BATCH_ROWS = 25_000    # rows per statistics batch (hash buckets of the row key)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


BYTES_PER_TASK = 1 << 20     # a small file is dealt to more tasks only at a MB or more each


def scan(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A table for CPU-heavy row-level work. A single small file arrives in one partition, which is dealt to as
    many tasks as there are cores (at about 1 MB each); tables of more files come in many partitions and stay as
    they are."""
    df = t(spark, sf_dir, name)
    slots = spark.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    want = min(slots, size // BYTES_PER_TASK)
    if files >= slots or want <= files:
        return df
    return df.repartition(want, key) if key else df.repartition(want)


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def round_doubles(df: DataFrame, digits: int = 6, skip=()) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) and f.name not in skip else F.col(f.name)
                       for f in df.schema.fields])


def line_key() -> F.Column:
    return F.concat_ws("|", *[F.col(c) for c in LINE_KEY])


# --- E9/E10/F3/F4/J1 --------------------------------------------------------

def q_segment_order_value(spark, d):
    """Flagship: orders join customer, average order value and count by market segment
    (orders pre-aggregated per customer before the join)."""
    g = quality.fk_group_average(t(spark, d, "orders"), t(spark, d, "customer"), "o_custkey", "c_custkey",
                                 parent_dims=["c_mktsegment"], child_nums=["o_totalprice"])
    return round_doubles(g)


def q_gold_summary_orders(spark, d):
    return round_doubles(medallion.gold_summary(t(spark, d, "orders"), "o_orderkey"))


def q_gold_join_orders_customer(spark, d):
    g = medallion.gold_fk_join(t(spark, d, "orders"), t(spark, d, "customer"), "o_custkey", "c_custkey",
                               "orders", "customer", "o_orderkey", "c_custkey")
    return round_doubles(g)


def q_global_avg_lineitem(spark, d):
    g = medallion.gold_summary(t(spark, d, "lineitem"), dims=[],
                               nums=["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return round_doubles(g)


def q_silver_dedupe_lineitem(spark, d):
    li = t(spark, d, "lineitem")
    return quality.distinct_rows(li.unionByName(li.where(F.col("l_returnflag") == "R")))


# --- E1-E8, E12 -----------------------------------------------------------

def lineitem_with_gaps(spark, d) -> DataFrame:
    """All of lineitem with NULLs in two columns and NaN in one."""
    return t(spark, d, "lineitem").withColumns({
        "l_linenumber": F.nullif(F.col("l_linenumber"), F.lit(1)),
        "l_quantity": F.when(F.col("l_quantity") > 45, F.lit(float("nan"))).otherwise(F.col("l_quantity")),
        "l_returnflag": F.nullif(F.col("l_returnflag"), F.lit("R"))})


def q_null_fraction(spark, d):
    return round_doubles(quality.null_fractions(lineitem_with_gaps(spark, d), "lineitem"))


def q_distinct_counts(spark, d):
    return quality.distinct_counts(t(spark, d, "customer"), "customer")


def q_corr_matrix_lineitem(spark, d):
    """All numeric columns, with NaN in one of them (NaN counts as missing)."""
    li = t(spark, d, "lineitem")
    return quality.correlation_matrix(li.withColumn(
        "l_quantity", F.when(F.col("l_quantity") > 45, F.lit(float("nan"))).otherwise(F.col("l_quantity"))))


def q_corr_incremental_lineitem(spark, d):
    """The same from a stored co-moment state of the returned lines, merged with the other lines' state."""
    li = lineitem_with_gaps(spark, d)
    cols = quality.numeric_columns(li)
    back = F.coalesce(F.col("l_returnflag") == "A", F.lit(False))
    state = written(moments.comoments(li.where(back), cols), "moments")
    return moments.correlations(moments.merge_comoments(state, moments.comoments(li.where(~back), cols)))


def q_joined_corr(spark, d):
    return quality.joined_correlation(t(spark, d, "orders"), t(spark, d, "customer"), "o_custkey", "c_custkey",
                                      "orders", "customer", ["o_totalprice", "c_acctbal", "c_nationkey"])


def q_fk_integrity(spark, d):
    tables = {n: t(spark, d, n) for n in RELATIONAL + ("events",)}
    return quality.fk_integrity_all(tables, FK_EDGES)


def q_quality_report(spark, d):
    return round_doubles(quality.quality_report({n: t(spark, d, n) for n in ALL_TABLES}))


SKETCH_ERROR = 0.04         # five standard errors of the sketches


def q_quality_sketches(spark, d):
    """The report from sketches, one scan a table; lineitem's come from stored states per return flag. Estimates are
    held against exact counts."""
    tables = {n: t(spark, d, n) for n in ALL_TABLES}
    states = [moments.profile_state(df, n) for n, df in tables.items() if n != "lineitem"]
    by_flag = written(moments.profile_state(tables["lineitem"], "lineitem", by=["l_returnflag"]), "profile")
    states.append(moments.merge_profiles(by_flag))
    found = states[0]
    for s in states[1:]:
        found = found.unionByName(s)
    found = moments.profile(found).withColumnRenamed("distinct_count", "estimate")
    exact = quality.quality_report(tables).select("table_name", "column_name", "distinct_count")
    near = F.abs(F.col("estimate") - F.col("distinct_count")) <= SKETCH_ERROR * F.col("distinct_count")
    return round_doubles(found.join(exact, ["table_name", "column_name"]).select(
        "table_name", "column_name", "null_fraction", "rows", "distinct_count", near.alias("near")))


def q_schema_profile(spark, d):
    tables = {n: t(spark, d, n) for n in ALL_TABLES}
    return quality.schema_profile(tables, FK_EDGES, pii={"customer.c_name"})


def people(spark, d) -> DataFrame:
    """Customers with generated person columns (one synthetic person per customer row)."""
    cust = scan(spark, d, "customer", "c_custkey")
    ctx = GenContext(table="people", seed=SEED, as_of=AS_OF, mode="portable", row_col="c_custkey")
    gen = {f.name: field_column(f, ctx) for f in (FieldSpec("patient_name"), FieldSpec("email"),
                                                  FieldSpec("zip_code"))}
    base = ctx.prepare(cust)
    return ctx.finish(base.withColumns(gen))


def q_pattern_pass_rates(spark, d):
    """The three standard checks and one for each of customer's own columns."""
    p = people(spark, d)
    checks = quality.standard_checks("zip_code", "patient_name", "email")
    checks["customer_name_format"] = F.col("c_name").rlike(r"^Customer#\d{9}$")
    checks["nation_known"] = F.col("c_nationkey").between(0, 24)
    checks["balance_positive"] = F.col("c_acctbal") > 0
    checks["segment_upper"] = F.col("c_mktsegment").rlike("^[A-Z]+$")
    checks["key_positive"] = F.col("c_custkey") > 0
    return round_doubles(quality.pattern_rates(p, checks))


# --- H1-H6 ---------------------------------------------------------------

PII_COLUMNS = ("c_name", "patient_name", "email", "zip_code")


def q_mask_customer(spark, d):
    return privacy.mask(people(spark, d), PII_COLUMNS)


def q_mask_audit(spark, d):
    return privacy.mask_audit(people(spark, d), PII_COLUMNS)


# --- C1-C6 ---------------------------------------------------------------

def q_repair_int(spark, d):
    li = t(spark, d, "lineitem")
    raw = F.when(F.col("l_returnflag") == "N", F.lit("bad")).otherwise((F.col("l_quantity") * 1.5).cast("string"))
    return li.select(*LINE_KEY,
                     constraints.repair_integer_col(raw, 1, 50).alias("qty_fixed"),
                     constraints.repair_integer_col(F.col("l_extendedprice") / 100, None, 500).alias("price_units"))


def q_repair_float(spark, d):
    li = t(spark, d, "lineitem")
    raw = F.when(F.col("l_returnflag") == "A", F.lit(float("nan"))) \
           .otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return li.select(*LINE_KEY,
                     constraints.repair_float_col(raw, 1000.0, 50000.0).alias("net_fixed"),
                     constraints.repair_float_col(F.col("l_tax").cast("string"), None, 0.05).alias("tax_fixed"))


def q_repair_allowed(spark, d):
    o = t(spark, d, "orders")
    u = rng.uniform(F.col("o_orderkey"), SEED, "orders", "o_orderstatus#allowed")
    return o.select("o_orderkey", constraints.repair_allowed_col("o_orderstatus", ["F", "O"], u).alias("o_orderstatus"))


LINE_LIMITS = TableSpec("lineitem", (
    FieldSpec("l_orderkey", "integer"), FieldSpec("l_linenumber", "integer", max_value=5),
    FieldSpec("l_quantity", "float", min_value=1, max_value=40), FieldSpec("l_discount", "float", max_value=0.08),
    FieldSpec("l_returnflag", "string", allowed_values=("A", "N")), FieldSpec("l_tax", "integer", min_value=0)),
    primary_key="l_orderkey")


def q_enforce_constraints(spark, d):
    """C1-C3 applied from a spec to a whole table (keys untouched)."""
    li = lineitem_keyed(spark, d)
    out = constraints.enforce_constraints(li, LINE_LIMITS, SEED, "_k", "portable")
    return out.select(*LINE_KEY, "l_quantity", "l_discount", "l_returnflag", "l_tax")


EVENTS_SPEC = TableSpec("events", (FieldSpec("event_id", "bigint"), FieldSpec("ts", "timestamp"),
                                   FieldSpec("user_id", "int"), FieldSpec("event_type", "text"),
                                   FieldSpec("value", "decimal"), FieldSpec("props", "json"),
                                   FieldSpec("session_id", "uuid")), primary_key="event_id")


def q_conform_events(spark, d):
    e = t(spark, d, "events")
    as_text = e.select(*[F.col(c).cast("string").alias(c) for c in e.columns])
    return constraints.conform(as_text, EVENTS_SPEC)


def q_repair_temporal(spark, d):
    li = t(spark, d, "lineitem").select(*LINE_KEY, "l_shipdate")
    o = t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner").drop("o_orderkey").withColumn("_k", line_key())
    out = constraints.repair_temporal_order(j, "o_orderdate", "l_shipdate", SEED, "_k", "lineitem", "portable")
    return out.drop("_k")


# --- D1-D10 --------------------------------------------------------------

LINE_SPEC = TableSpec("lineitem", (
    FieldSpec("l_orderkey", "integer"), FieldSpec("l_partkey", "integer"), FieldSpec("l_suppkey", "integer"),
    FieldSpec("l_linenumber", "integer"), FieldSpec("l_quantity", "float"), FieldSpec("l_extendedprice", "float"),
    FieldSpec("l_discount", "float"), FieldSpec("l_tax", "float"), FieldSpec("l_returnflag", "string"),
    FieldSpec("l_linestatus", "string"), FieldSpec("l_shipdate", "datetime"), FieldSpec("is_large", "boolean")),
    primary_key="l_orderkey")


def lineitem_keyed(spark, d) -> DataFrame:
    return scan(spark, d, "lineitem").withColumn("_k", line_key())


def q_zscore(spark, d):
    z = correlate.zscore(lineitem_keyed(spark, d), "l_quantity", by=None, out="l_quantity_z")
    return z.select(*LINE_KEY, r6("l_quantity_z").alias("l_quantity_z"))


def _line_rule(spark, d, rule: Rule, out_cols, by=None, prep=None):
    df = lineitem_keyed(spark, d)
    if prep is not None:
        df = prep(df)
    res = correlate.apply_rule(df, rule, LINE_SPEC.field(rule.target), 0, by, SEED, "_k", "lineitem", "portable")
    return res.select(*LINE_KEY, *out_cols)


def q_num_num(spark, d):
    return _line_rule(spark, d, Rule("l_quantity", "l_extendedprice", "num_num", 0.35), ["l_extendedprice"])


def q_flag_num(spark, d):
    prep = lambda df: df.withColumn("is_returned", F.col("l_returnflag") == "R")
    spec_rule = Rule("is_returned", "l_extendedprice", "bool_num", 0.22)
    return _line_rule(spark, d, spec_rule, ["l_extendedprice"], prep=prep)


def q_num_flag(spark, d):
    prep = lambda df: df.withColumn("is_large", F.lit(False))
    return _line_rule(spark, d, Rule("l_quantity", "is_large", "num_bool", 0.42), ["is_large"], prep=prep)


def chain_rules() -> list[Rule]:
    """Name-derived rules for lineitem, then the two hint rules (same order as D6 + D7)."""
    return correlate.default_rules(LINE_SPEC, extra=[correlate.higher("l_discount", "l_tax"),
                                                    correlate.more_likely("l_extendedprice", "is_large")],
                                   exclude_keys=True)


def q_rule_chain(spark, d, method: str = "window"):
    li = lineitem_keyed(spark, d)
    n = li.count()     # one bounded scalar: the number of ~25,000-row batches
    df = li.withColumn("is_large", F.lit(False)) \
        .withColumn("_batch", correlate.hash_batches(F.col("_k"), n, LINE_BATCH_ROWS))
    out = correlate.apply_rules(df, chain_rules(), LINE_SPEC, ("_batch",), SEED, "_k", "portable",
                                fill_median=True, method=method)
    return out.select(*LINE_KEY, "l_extendedprice", "l_tax", "is_large")


def whole_table_rules() -> list[Rule]:
    """Ten rules over all of lineitem; two targets hold NULLs that the exact median fills."""
    sources = ("l_quantity", "l_discount", "l_linenumber", "l_suppkey", "l_partkey")
    return [r for s in sources for r in (correlate.higher(s, "l_tax"), Rule(s, "l_extendedprice", "num_num", 0.35))]


def q_whole_table_rules(spark, d):
    df = lineitem_keyed(spark, d)
    df = df.withColumn("l_tax", F.when(F.col("l_returnflag") != "R", F.col("l_tax"))) \
           .withColumn("l_extendedprice", F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")))
    out = correlate.apply_rules(df, whole_table_rules(), LINE_SPEC, None, SEED, "_k", "portable", repair_order=False)
    return out.select(*LINE_KEY, "l_extendedprice", "l_tax")


ORDERS_SPEC = TableSpec("orders", (
    FieldSpec("o_orderkey", "integer"), FieldSpec("o_custkey", "integer"), FieldSpec("o_totalprice", "float"),
    FieldSpec("priority_flag", "boolean"), FieldSpec("ship_cost", "float")),
    primary_key="o_orderkey", foreign_keys=(ForeignKey("o_custkey", "customer", "c_custkey"),))


def q_parent_influence(spark, d):
    o = t(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice",
        (F.col("o_orderpriority") == "1-URGENT").alias("priority_flag"),
        (F.col("o_totalprice") * 0.01).alias("ship_cost"))
    c = t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("tenure"),
                                       F.col("c_nationkey").alias("comorbidity_count"))
    j = keys.attach_parent(o, c, "o_custkey", "c_custkey", ["tenure", "comorbidity_count"])
    out = correlate.apply_parent_influence(j, ORDERS_SPEC, ["o_custkey__tenure", "o_custkey__comorbidity_count"],
                                           None, SEED, "o_orderkey", "portable")
    return out.select("o_orderkey", "o_totalprice", "priority_flag", "ship_cost")


# --- R1 ----------------------------------------------------------------------

TTL_AS_OF = datetime(2024, 1, 15, 12, 0, 0)


def q_ttl_filter(spark, d):
    return retention.retain(t(spark, d, "events"), "ts", TTL_AS_OF, 60)


# --- G1-G26 ----------------------------------------------------------------

def order_rows(spark, d) -> DataFrame:
    """One synthetic row per order: dense row key 1..n from the order key."""
    return scan(spark, d, "orders", "o_orderkey").select((F.col("o_orderkey") + 1).alias("_row"))


CLAIMS = TableSpec("claims", (FieldSpec("id", "integer"), FieldSpec("patient_id", "integer")),
                   foreign_keys=(ForeignKey("patient_id", "customer", "c_custkey"),))


def q_gen_keys_fk(spark, d):
    base = order_rows(spark, d).withColumn("id", F.col("_row"))
    out = keys.sample_foreign_key(base, t(spark, d, "customer"), "patient_id", "c_custkey", "_row",
                                  SEED, "claims", "portable")
    return out.select("id", "patient_id")


NUMBERS = (FieldSpec("visit_count", "integer"), FieldSpec("small_qty", "integer", min_value=0, max_value=12),
           FieldSpec("age", "integer", min_value=18, max_value=90), FieldSpec("risk_score", "float", min_value=0, max_value=1),
           FieldSpec("claim_amount", "float"), FieldSpec("weight", "float"), FieldSpec("fixed_rate_floor", "float", min_value=5, max_value=5))


def _gen_over(spark, d, table: str, fields, rows_df: DataFrame, rows: int = 0, batched: bool = False):
    ctx = GenContext(table=table, seed=SEED, as_of=AS_OF, mode="portable", rows=rows, batched=batched)
    cols = [field_column(f, ctx).alias(f.name) for f in fields]
    return ctx.prepare(rows_df).select(F.col("_row").alias("id"), *cols)


def q_gen_ints_floats(spark, d):
    return _gen_over(spark, d, "numbers", NUMBERS, order_rows(spark, d))


TEXT = (FieldSpec("plan", allowed_values=("basic", "plus", "pro")), FieldSpec("nick", faker="first_name"),
        FieldSpec("patient_name"), FieldSpec("email"), FieldSpec("postal_code"), FieldSpec("phone"),
        FieldSpec("session_id"), FieldSpec("order_status"), FieldSpec("payment_status"), FieldSpec("case_status"),
        FieldSpec("shipment_status"), FieldSpec("status"), FieldSpec("country"), FieldSpec("city"),
        FieldSpec("notes"))


def q_gen_text(spark, d):
    return _gen_over(spark, d, "people", TEXT, scan(spark, d, "customer", "c_custkey").select((F.col("c_custkey") + 1).alias("_row")))


TEMPORAL = (FieldSpec("service_date", "date"), FieldSpec("signup_date", "date"),
            FieldSpec("visit_time", "timestamp"), FieldSpec("created_at", "timestamp"))


def q_gen_temporal_exact(spark, d):
    """The same columns, the row-ordered ones by sorting each batch's draws."""
    rows_df = order_rows(spark, d)
    ctx = GenContext(table="visits", seed=SEED, as_of=AS_OF, mode="portable", rows=0, batch_rows=VISIT_BATCH, batched=True, exact=True)
    cols = [field_column(f, ctx).alias(f.name) for f in TEMPORAL]
    return ctx.prepare(rows_df).select(F.col("_row").alias("id"), *cols)


def q_gen_temporal(spark, d):
    rows_df = order_rows(spark, d)
    n = rows_df.count()   # one bounded scalar: the stratified order needs the table size
    return _gen_over(spark, d, "visits", TEMPORAL, rows_df, rows=n, batched=True)


FLAGS = (FieldSpec("is_fraud", "boolean"), FieldSpec("chronic_flag", "boolean"), FieldSpec("abnormal_lab", "bool"))


def q_gen_flags(spark, d):
    return _gen_over(spark, d, "visits", FLAGS, order_rows(spark, d))


#: Two generated tables with one foreign key, for the benchmark and the tests.
MEMBER_VISITS = {"tables": [
    {"name": "members", "primary_key": "id", "fields": [
        {"name": "id", "type": "bigint", "nullable": False}, {"name": "member_name", "pii": True},
        {"name": "email", "pii": True}, {"name": "zip_code", "pii": True}, {"name": "age", "type": "int"},
        {"name": "comorbidity_count", "type": "int"}, {"name": "is_chronic", "type": "bool"}]},
    {"name": "visits", "primary_key": "id", "fields": [
        {"name": "id", "type": "bigint", "nullable": False},
        {"name": "member_id", "type": "bigint", "foreign_key": "members.id"},
        {"name": "length_of_stay", "type": "int"}, {"name": "cost", "type": "double"},
        {"name": "readmission_risk_score", "type": "double"}, {"name": "visit_date", "type": "timestamp"}]}]}

#: Visits generated over the given orders, with the given customers as parents.
CUSTOMER_VISITS = {"tables": [
    {"name": "customer", "primary_key": "c_custkey", "fields": [
        {"name": "c_custkey", "type": "bigint"}, {"name": "tenure", "type": "double"},
        {"name": "comorbidity_count", "type": "int"}]},
    {"name": "visits", "primary_key": "id", "fields": [
        {"name": "id", "type": "bigint"}, {"name": "customer_id", "type": "bigint", "foreign_key": "customer.c_custkey"},
        {"name": "length_of_stay", "type": "int"}, {"name": "cost", "type": "double"},
        {"name": "readmission_risk_score", "type": "double"}, {"name": "visit_date", "type": "timestamp"}]}]}
VISIT_BATCH = 4000          # several batches at the smallest tables too


def visit_parents(spark, d) -> DataFrame:
    return t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("tenure"),
                                          F.col("c_nationkey").alias("comorbidity_count"))


def q_gen_claims(spark, d):
    """One visit per order, with a sampled customer as parent: keys, parent influence and
    rules in batches (the number of orders, one bounded scalar, is read first)."""
    rows = order_rows(spark, d)
    return generate_table(spark, load_spec(CUSTOMER_VISITS).table("visits"), rows.count(), ids=rows, seed=SEED,
                          as_of=AS_OF, mode="portable", batch_rows=VISIT_BATCH,
                          parents={"customer": visit_parents(spark, d)})


def q_gen_star_schema(spark, d):
    return round_doubles(quality.joined_correlation(
        q_gen_claims(spark, d), visit_parents(spark, d), "customer_id", "c_custkey", "visits", "customer",
        ["tenure", "cost", "length_of_stay", "comorbidity_count", "readmission_risk_score"]))


# --- S1-S14, F1-F6 ---------------------------------------------------------

def q_sample_rows(spark, d):
    return io.sample(t(spark, d, "orders"), 20, ["o_orderkey"])


def q_csv_roundtrip(spark, d):
    li = t(spark, d, "lineitem")
    path = io.export_table(li, scratch_path(spark, "csv"), "csv", "gzip")
    return io.read_csv(spark, path, li.schema)


def q_parquet_roundtrip(spark, d):
    o = t(spark, d, "orders")
    path = io.export_table(o, scratch_path(spark, "parquet"), "parquet")
    return io.read_table(spark, path)


def q_json_scan(spark, d):
    e = t(spark, d, "events")
    path = scratch_path(spark, "json")
    e.write.mode("overwrite").options(**ev.JSON_OPTIONS).json(path)
    return io.read_json(spark, path, e.schema, ev.JSON_OPTIONS)


def _csv_back(spark, d, name):
    """A table exported as CSV (line breaks, quotes and microseconds included) and read again."""
    df = t(spark, d, name)
    return io.read_csv(spark, io.export_table(df, scratch_path(spark, "csv"), "csv"), df.schema)


def q_csv_documents(spark, d):
    return _csv_back(spark, d, "documents")


def q_csv_pages(spark, d):
    return _csv_back(spark, d, "pages")


def q_csv_conversations(spark, d):
    return _csv_back(spark, d, "conversations")


def q_csv_events(spark, d):
    return _csv_back(spark, d, "events")


def q_compact_lineitem(spark, d):
    li = t(spark, d, "lineitem")
    src, dst = scratch_path(spark, "part"), scratch_path(spark, "compact")
    key = io.write_partitioned(li, src, "parquet", "l_shipdate", grain="month")
    io.compact(spark, src, dst, 64 << 20, "parquet", key)
    return io.read_table(spark, dst).drop(key)


def q_compact_in_place_lineitem(spark, d):
    """A table of many small files a month, written in three loads, is compacted in place; readers take the newest version."""
    li = t(spark, d, "lineitem")
    path = scratch_path(spark, "loads")
    keyed, key, _ = io.with_partition_key(li, "l_shipdate", "year")
    for k in range(3):
        keyed.where(F.col("l_linenumber") % 3 == k).write.mode("append").partitionBy(key).parquet(path)
    versions.compact_in_place(spark, path, 4 << 20)
    return versions.read_version(spark, path).drop(key)


def q_ttl_purge(spark, d):
    """Events by day; expired days leave the table unread, the day that holds the limit is rewritten."""
    path = scratch_path(spark, "purge")
    key = io.write_partitioned(t(spark, d, "events"), path, column="ts")
    versions.purge(spark, path, "ts", TTL_AS_OF, 60, key)
    return versions.read_version(spark, path).drop(key)


EVOLVED_FROM = datetime(1998, 1, 1)


def q_evolve_orders(spark, d):
    """All orders are loaded with few columns and a narrow key type; the years from 1998 on are then replaced by a load
    with all columns and full types."""
    o = t(spark, d, "orders")
    path = scratch_path(spark, "evolve")
    first = o.drop("o_orderpriority").withColumn("o_custkey", F.col("o_custkey").cast("int"))
    evolve.load(first, path, "o_orderdate", "year")
    evolve.load(o.where(F.col("o_orderdate") >= F.lit(EVOLVED_FROM).cast("timestamp_ntz")), path, "o_orderdate", "year", mode="partitions")
    return evolve.read(spark, path).drop("o_orderdate_year")


def q_catalog_orders(spark, d):
    """A schema is created, orders are registered in it, overwritten with other columns and registered anew; read by name."""
    o = t(spark, d, "orders")
    root = scratch_path(spark, "catalog")
    name = f"rowsmith_{root[-12:]}"
    io.create_schema(spark, name, f"{root}/{name}.db")
    io.export_table(o.select("o_orderkey"), f"{root}/orders", "parquet")
    io.register_table(spark, "orders", f"{root}/orders", schema_name=name)
    io.export_table(o, f"{root}/orders", "parquet")
    full = io.register_table(spark, "orders", f"{root}/orders", schema_name=name)
    return spark.table(full)


PEOPLE_SPEC = {"tables": [{"name": "customer", "primary_key": "c_custkey", "row_multiplier": 2.5, "fields": [
    {"name": "c_custkey", "type": "bigint"}, {"name": "c_name", "pii": True}, {"name": "patient_name", "pii": True},
    {"name": "email", "pii": True}, {"name": "zip_code", "pii": True}, {"name": "c_mktsegment"}]}]}


def q_pii_inventory(spark, d):
    """The flagged columns of a spec with the values they hold in the given customers."""
    spec = load_spec(PEOPLE_SPEC)
    profile = quality.column_profile(people(spark, d), "customer", with_rows=True)
    return privacy.pii_inventory(spark, spec).join(profile, ["table_name", "column_name"]).select(
        "table_name", "column_name", "distinct_count", "rows")


def q_scaled_rows(spark, d):
    """Rows of a table scaled to the number of given customers, with its generated text columns."""
    table = load_spec(PEOPLE_SPEC).table("customer")
    n = table.rows_for(t(spark, d, "customer").count())
    out = generate_table(spark, table, n, seed=SEED, as_of=AS_OF, mode="portable", rules=[])
    return out.select("c_custkey", "patient_name", "email", "zip_code")


def q_stream_publish(spark, d):
    """Events are published as a stream to JSON files in micro-batches, in two runs, and decoded again."""
    e = t(spark, d, "events")
    src, out, ck = (scratch_path(spark, x) for x in ("source", "topic", "ckpt"))
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).repartition(6, "event_id").write.mode("append").parquet(src)
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 4).parquet(src)
        ev.publish_stream(stream, "registry", ck, out)
    return ev.read_published(spark, out, e.schema)


def q_event_json_roundtrip(spark, d):
    e = t(spark, d, "events")
    return ev.from_events(ev.to_events(e), e.schema)


def q_stream_silver(spark, d):
    """Events spread over 24 files by a hash, then copies of some and malformed records, read
    four files at a time: every event comes out once."""
    e = t(spark, d, "events")
    src, out, ck = scratch_path(spark, "topic"), scratch_path(spark, "silver"), scratch_path(spark, "ckpt")
    ev.write_event_files(e.repartition(24, "event_id"), src)
    ev.write_event_files(e.where(F.col("event_type") == "click"), src)   # re-delivered copies
    e.where(F.col("event_type") == "view").select(F.concat(F.lit('{"event_id": '), F.col("event_id"))) \
        .write.mode("append").text(src)                                  # cut-off records
    stream = ev.read_event_stream(spark, src, e.schema, max_files_per_trigger=4, corrupt=ev.CORRUPT)
    ev.stream_silver(stream, ["event_id"], out, ck, ev.CORRUPT, scratch_path(spark, "bad"))
    return ev.read_silver(spark, out, e.schema)


def q_medallion_gold(spark, d):
    root = scratch_path(spark, "medallion")
    tables = {"orders": t(spark, d, "orders"), "customer": t(spark, d, "customer")}
    csv = io.export_all(tables, f"{root}/landing", "csv", "gzip")
    outs = medallion.run_medallion(spark, csv, root, [("orders", "o_custkey", "customer", "c_custkey")],
                                   schemas={k: v.schema for k, v in tables.items()},
                                   primary_keys={"orders": "o_orderkey", "customer": "c_custkey"},
                                   compact_bytes=64 << 20, grain="month")
    return round_doubles(io.read_table(spark, outs["gld_orders_customer_joined"]))


QUERIES = {
    "segment_order_value": q_segment_order_value,
    "gold_summary_orders": q_gold_summary_orders,
    "gold_join_orders_customer": q_gold_join_orders_customer,
    "global_avg_lineitem": q_global_avg_lineitem,
    "silver_dedupe_lineitem": q_silver_dedupe_lineitem,
    "null_fraction": q_null_fraction,
    "distinct_counts": q_distinct_counts,
    "corr_matrix_lineitem": q_corr_matrix_lineitem,
    "corr_incremental_lineitem": q_corr_incremental_lineitem,
    "joined_corr": q_joined_corr,
    "fk_integrity": q_fk_integrity,
    "quality_report": q_quality_report,
    "quality_sketches": q_quality_sketches,
    "schema_profile": q_schema_profile,
    "pii_inventory": q_pii_inventory,
    "pattern_pass_rates": q_pattern_pass_rates,
    "mask_customer": q_mask_customer,
    "mask_audit": q_mask_audit,
    "repair_int": q_repair_int,
    "repair_float": q_repair_float,
    "repair_allowed": q_repair_allowed,
    "enforce_constraints": q_enforce_constraints,
    "conform_events": q_conform_events,
    "repair_temporal": q_repair_temporal,
    "zscore": q_zscore,
    "num_num": q_num_num,
    "flag_num": q_flag_num,
    "num_flag": q_num_flag,
    "rule_chain": q_rule_chain,
    "whole_table_rules": q_whole_table_rules,
    "parent_influence": q_parent_influence,
    "ttl_filter": q_ttl_filter,
    "ttl_purge": q_ttl_purge,
    "gen_keys_fk": q_gen_keys_fk,
    "gen_ints_floats": q_gen_ints_floats,
    "gen_text": q_gen_text,
    "gen_temporal": q_gen_temporal,
    "gen_temporal_exact": q_gen_temporal_exact,
    "gen_flags": q_gen_flags,
    "scaled_rows": q_scaled_rows,
    "gen_star_schema": q_gen_star_schema,
    "gen_claims": q_gen_claims,
    "sample_rows": q_sample_rows,
    "csv_roundtrip": q_csv_roundtrip,
    "csv_documents": q_csv_documents,
    "csv_pages": q_csv_pages,
    "csv_conversations": q_csv_conversations,
    "csv_events": q_csv_events,
    "parquet_roundtrip": q_parquet_roundtrip,
    "evolve_orders": q_evolve_orders,
    "json_scan": q_json_scan,
    "catalog_orders": q_catalog_orders,
    "compact_lineitem": q_compact_lineitem,
    "compact_in_place_lineitem": q_compact_in_place_lineitem,
    "event_json_roundtrip": q_event_json_roundtrip,
    "stream_publish": q_stream_publish,
    "stream_silver": q_stream_silver,
    "medallion_gold": q_medallion_gold,
}
