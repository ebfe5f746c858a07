"""Data-quality and validation metrics as long-format DataFrames.

Each metric is one aggregation pass (partial aggregation before the shuffle), so
the shuffled volume is per-partition partial states, not rows. No rows are
collected: results are small DataFrames the caller may write or show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowsmith.operators import moments

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
# Whole-stage codegen is switched off for an aggregate whose buffer has more than
# spark.sql.codegen.maxFields (default 100) fields; a corr state has 6, avg 2,
# count 1, a Pearson coefficient 10. Aggregates are chunked to stay under it (each chunk is one extra
# column-pruned scan, far cheaper than one interpreted pass).
CODEGEN_FIELDS = 96
#: Columns profiled in one scan: the aggregate's buffer stays small enough for compiled code.
PROFILE_COLUMNS = 30


def chunked_long_aggregates(df: DataFrame, items: list, fields_each: int, entry, keep=()) -> DataFrame:
    """Aggregate many (name, Column) statistics in chunks whose buffers stay
    codegen-sized; each chunk's single row is exploded into long rows by
    ``entry(name) -> struct Column`` and the chunks are unioned (no joins).
    ``keep`` are extra aggregates (name, Column) computed in every chunk and kept
    as columns (e.g. a row count)."""
    per = max(1, (CODEGEN_FIELDS - len(keep)) // max(1, fields_each))
    parts = []
    for i in range(0, len(items), per):
        chunk = items[i:i + per]
        row = df.agg(*[a.alias(n) for n, a in chunk], *[a.alias(n) for n, a in keep])
        parts.append(row.select(F.explode(F.array(*[entry(n) for n, _ in chunk])).alias("e"),
                                *[n for n, _ in keep]).select("e.*", *[n for n, _ in keep]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _is_float(dt) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def _null_like(df: DataFrame, name: str) -> Column:
    """NULL or NaN (pandas treats both as missing)."""
    c = F.col(name)
    if _is_float(df.schema[name].dataType):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _nan_to_null(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if _is_float(df.schema[name].dataType):
        return F.nanvl(c, F.lit(None).cast("double"))
    return c


def _unpivot(row: DataFrame, names: list[str], suffixes: list[str], label: str = "column_name") -> DataFrame:
    """Turn one wide row of ``<suffix>__<i>`` columns into one row per column name."""
    entries = [F.struct(F.lit(n).alias(label), *[F.col(f"{s}__{i}").alias(s) for s in suffixes])
               for i, n in enumerate(names)]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def table_stats(df: DataFrame, table_name: str) -> DataFrame:
    """(table_name, rows, columns)."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("rows")).select(
        F.lit(table_name).alias("table_name"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"))


def _null_rows(df: DataFrame, names: list[str], with_rows: bool = False) -> DataFrame:
    items = [(f"nf_{i}", F.avg(_null_like(df, c).cast("double"))) for i, c in enumerate(names)]
    label = {f"nf_{i}": c for i, c in enumerate(names)}
    entry = lambda n: F.struct(F.lit(label[n]).alias("column_name"),
                               F.coalesce(F.col(n), F.lit(0.0)).alias("null_fraction"))
    keep = [("rows", F.count(F.lit(1)).cast("long"))] if with_rows else []
    return chunked_long_aggregates(df, items, 2, entry, keep)


def column_profile(df: DataFrame, table_name: str, approx: bool = False, rsd: float = 0.02,
                   with_rows: bool = False) -> DataFrame:
    """E2 + E3: (table_name, column_name, null_fraction, distinct_count).

    NaN counts as missing and is not a distinct value. All statistics of up to
    ``PROFILE_COLUMNS`` columns come from one scan; for exact distinct counts Spark
    expands rows per column and deduplicates partially before the shuffle. ``approx``
    swaps those for HyperLogLog++ sketches, which shuffle a few kB per task."""
    step = PROFILE_COLUMNS
    parts = [_profile_part(df, df.columns[at:at + step], approx, rsd) for at in range(0, len(df.columns), step)]
    return _profile_rows(parts, table_name, with_rows)


def exact_profile(df: DataFrame, table_name: str, with_rows: bool = False) -> DataFrame:
    """The same with exact counts from one aggregate per column: each reads its column only and deduplicates it
    before the shuffle, where one aggregate of several exact counts expands every row by their number. For
    tables as stored; a frame that is costly to compute is better written first."""
    return _profile_rows([_profile_part(df, [c], False, 0.0) for c in df.columns], table_name, with_rows)


def _profile_part(df: DataFrame, names: list[str], approx: bool, rsd: float) -> DataFrame:
    aggs = [F.count(F.lit(1)).cast("long").alias("rows")]
    for i, c in enumerate(names):
        distinct = F.approx_count_distinct(_nan_to_null(df, c), rsd) if approx else F.count_distinct(_nan_to_null(df, c))
        aggs += [F.coalesce(F.avg(_null_like(df, c).cast("double")), F.lit(0.0)).alias(f"null_fraction__{i}"),
                 distinct.cast("long").alias(f"distinct_count__{i}")]
    entries = [F.struct(F.lit(n).alias("column_name"), F.col(f"null_fraction__{i}").alias("null_fraction"),
                        F.col(f"distinct_count__{i}").alias("distinct_count"), "rows") for i, n in enumerate(names)]
    return df.agg(*aggs).select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def _profile_rows(parts: list[DataFrame], table_name: str, with_rows: bool) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(table_name).alias("table_name"), "column_name", "null_fraction", "distinct_count",
                      *(["rows"] if with_rows else []))


def null_fractions(df: DataFrame, table_name: str) -> DataFrame:
    """(table_name, column_name, null_fraction)."""
    return _null_rows(df, df.columns).select(F.lit(table_name).alias("table_name"), "column_name",
                                             "null_fraction")


def distinct_counts(df: DataFrame, table_name: str, approx: bool = False) -> DataFrame:
    """(table_name, column_name, distinct_count), NULL and NaN excluded."""
    return column_profile(df, table_name, approx).select("table_name", "column_name", "distinct_count")


def quality_report(tables: dict, exact: dict | None = None) -> DataFrame:
    """E5: per-column profile of every table with its row/column counts and the table count.

    Distinct counts are exact. With ``exact`` (table -> columns, ``{}`` for none) they are exact
    for these columns only, and others are sketch estimates: then each table is read once, without
    expanding its rows, and once more for its named columns."""
    if not tables:
        raise ValueError("no tables given")
    parts = []
    for name, df in tables.items():
        if exact is None:
            prof = exact_profile(df, name, with_rows=True)
        else:
            prof = moments.profile(moments.profile_state(df, name))
            named = [c for c in df.columns if c in exact.get(name, ())]
            if named:
                prof = prof.where(~F.col("column_name").isin(named)).unionByName(
                    exact_profile(df.select(*named), name, with_rows=True))
        parts.append(prof.withColumn("columns", F.lit(len(df.columns)).cast("long")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("table_count", F.lit(len(tables)).cast("long"))


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric and boolean columns in order (booleans count as numbers for correlation)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC + (T.BooleanType,)) and f.name not in exclude]


def correlation_matrix(df: DataFrame, columns=None, digits: int = 4) -> DataFrame:
    """Pearson correlation of every ordered pair among the given (or all numeric)
    columns: (col_a, col_b, corr). Empty with fewer than two columns. NaN counts as
    missing: a pair uses the rows where both values are there.

    One scan for any number of columns: tasks send a co-moment state
    (:mod:`rowsmith.operators.moments`), which callers may also store and merge."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    spark = df.sparkSession
    schema = "col_a string, col_b string, corr double"
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    return moments.correlations(moments.comoments(df, cols), digits).drop("rows")


def prefix_clashes(left: DataFrame, right: DataFrame, left_name: str, right_name: str,
                   keep=()) -> tuple[DataFrame, DataFrame]:
    """Rename columns present on both sides to ``<table>_<column>``."""
    clash = (set(left.columns) & set(right.columns)) - set(keep)
    l2 = left.select(*[F.col(c).alias(f"{left_name}_{c}" if c in clash else c) for c in left.columns])
    r2 = right.select(*[F.col(c).alias(f"{right_name}_{c}" if c in clash else c) for c in right.columns])
    return l2, r2


def join_child_parent(child: DataFrame, parent: DataFrame, fk: str, ref: str,
                      child_name: str, parent_name: str) -> DataFrame:
    """J1 + J2: inner equi-join on the foreign key with clashing names prefixed."""
    c2, p2 = prefix_clashes(child, parent, child_name, parent_name)
    fk2 = f"{child_name}_{fk}" if fk in parent.columns else fk
    ref2 = f"{parent_name}_{ref}" if ref in child.columns else ref
    return c2.join(p2, c2[fk2] == p2[ref2], "inner")


def joined_correlation(child: DataFrame, parent: DataFrame, fk: str, ref: str, child_name: str,
                       parent_name: str, columns) -> DataFrame:
    """Correlations of ``columns`` (those present after the join) plus the joined row count."""
    joined = join_child_parent(child, parent, fk, ref, child_name, parent_name)
    cols = [c for c in columns if c in joined.columns]
    if len(cols) < 2:
        cnt = joined.agg(F.count(F.lit(1)).alias("joined_row_count"))
        return cnt.select(F.lit(None).cast("string").alias("col_a"), F.lit(None).cast("string").alias("col_b"),
                          F.lit(None).cast("double").alias("corr"), "joined_row_count")
    return moments.correlations(moments.comoments(joined, cols), 4).withColumnRenamed("rows", "joined_row_count")


def comparable_keys(child: DataFrame, fk: str, parent: DataFrame, ref: str) -> tuple[Column, Column]:
    """Both key columns in one type that holds every value of either: numbers in the wider
    numeric type, other pairs of unlike types as text (so no value is cast away and values
    that cannot be equal are misses)."""
    a, b = child.schema[fk].dataType, parent.schema[ref].dataType
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if a == b:
        kind = a
    elif isinstance(a, whole) and isinstance(b, whole):
        kind = T.LongType()
    elif isinstance(a, NUMERIC) and isinstance(b, NUMERIC):
        kind = T.DoubleType() if _is_float(a) or _is_float(b) else T.DecimalType(38, 18)
    else:
        kind = T.StringType()
    return F.col(fk).cast(kind), F.col(ref).cast(kind)


def fk_integrity(child: DataFrame, parent: DataFrame, fk: str, ref: str, child_name: str,
                 parent_name: str) -> DataFrame:
    """E6 + J3: share of distinct child keys found among parent keys, to 4 digits.

    Both sides are reduced to distinct keys first (partial aggregation), and the
    left join reuses that hash partitioning on the key: no extra shuffle. A hot
    key costs one row after the distinct."""
    ours, theirs = comparable_keys(child, fk, parent, ref)
    ck = child.select(ours.alias("__k")).where(F.col("__k").isNotNull()).distinct()
    pk = parent.select(theirs.alias("__k")).distinct().withColumn("__hit", F.lit(1))
    agg = ck.join(pk, "__k", "left").agg(
        F.count(F.lit(1)).alias("child_distinct"),
        F.sum(F.when(F.col("__hit").isNull(), 1).otherwise(0)).cast("long").alias("missing_distinct"))
    return agg.select(
        F.lit(child_name).alias("child_table"), F.lit(fk).alias("fk_column"),
        F.lit(parent_name).alias("parent_table"), F.lit(ref).alias("parent_column"),
        F.col("child_distinct").cast("long").alias("child_distinct"),
        F.coalesce("missing_distinct", F.lit(0)).cast("long").alias("missing_distinct"),
        F.when(F.col("child_distinct") == 0, F.lit(1.0))
         .otherwise(F.round(F.lit(1.0) - F.col("missing_distinct") / F.col("child_distinct"), 4))
         .alias("valid_fk_rate"))


def fk_integrity_all(tables: dict, edges) -> DataFrame:
    """E6 for every (child, fk, parent, ref) edge whose tables and columns exist."""
    parts = []
    for child, fk, parent, ref in edges:
        if child not in tables or parent not in tables or fk not in tables[child].columns:
            continue
        pdf = tables[parent]
        ref_col = ref if ref in pdf.columns else pdf.columns[0]
        parts.append(fk_integrity(tables[child], pdf, fk, ref_col, child, parent))
    if not parts:
        raise ValueError("no foreign key joins two of the given tables")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _is_temporal(dt) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def schema_profile(tables: dict, fk_edges=(), pii=()) -> DataFrame:
    """One row per table: columns, foreign keys, date and PII columns, row count,
    plus schema-wide totals and the size tier (small < 50 columns < medium < 200)."""
    if not tables:
        raise ValueError("no tables given")
    total_cols = sum(len(df.columns) for df in tables.values())
    tier = "small" if total_cols < 50 else ("medium" if total_cols < 200 else "large")
    pii = set(pii)
    parts = []
    for name, df in tables.items():
        dates = [f.name for f in df.schema.fields if _is_temporal(f.dataType)]
        pcols = [c for c in df.columns if f"{name}.{c}" in pii]
        nfk = sum(1 for e in fk_edges if e[0] == name)
        parts.append(df.agg(F.count(F.lit(1)).cast("long").alias("rows")).select(
            F.lit(name).alias("table_name"), "rows",
            F.lit(len(df.columns)).cast("long").alias("columns"),
            F.lit(nfk).cast("long").alias("foreign_keys"),
            F.lit(",".join(dates)).alias("date_columns"),
            F.lit(",".join(pcols)).alias("pii_columns")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({
        "total_tables": F.lit(len(tables)).cast("long"),
        "total_columns": F.lit(total_cols).cast("long"),
        "foreign_key_count": F.lit(len(fk_edges)).cast("long"),
        "size_tier": F.lit(tier)})


def fk_group_average(child: DataFrame, parent: DataFrame, fk: str, ref: str, child_dims=(), parent_dims=(),
                     child_nums=(), parent_nums=(), child_names=None, parent_names=None) -> DataFrame:
    """Averages over ``child JOIN parent ON fk = ref`` grouped by child and/or parent
    dimensions, computed without joining row by row.

    The child is pre-aggregated by (key, child dims) into row counts and per-column
    sums and non-null counts, the parent by (key, parent dims) into multiplicities
    and sums/counts; the join then moves one row per key group, and the final
    group combines them weighted by the other side's count. Exact for any key
    multiplicity, and a key holding a third of all rows costs one row per map task.
    Output: the dims, ``avg_<name>`` per numeric column, ``row_count``. ``*_names``
    rename columns in the output (e.g. to ``<table>_<col>`` for clashing names)."""
    cn = dict(child_names or {})
    pn = dict(parent_names or {})
    ours, theirs = comparable_keys(child, fk, parent, ref)
    cagg = child.where(F.col(fk).isNotNull()).groupBy(
        ours.alias("__k"), *[F.col(d).alias(cn.get(d, d)) for d in child_dims]).agg(
        F.count(F.lit(1)).alias("__cn"),
        *[F.sum(F.col(c).cast("double")).alias(f"__cs{i}") for i, c in enumerate(child_nums)],
        *[F.count(F.col(c)).alias(f"__cc{i}") for i, c in enumerate(child_nums)])
    pagg = parent.where(F.col(ref).isNotNull()).groupBy(
        theirs.alias("__k"), *[F.col(d).alias(pn.get(d, d)) for d in parent_dims]).agg(
        F.count(F.lit(1)).alias("__pm"),
        *[F.sum(F.col(c).cast("double")).alias(f"__ps{i}") for i, c in enumerate(parent_nums)],
        *[F.count(F.col(c)).alias(f"__pc{i}") for i, c in enumerate(parent_nums)])
    j = cagg.join(pagg, "__k", "inner")
    aggs = [(F.sum(F.col(f"__cs{i}") * F.col("__pm")) / F.sum(F.col(f"__cc{i}") * F.col("__pm")))
            .alias(f"avg_{cn.get(c, c)}") for i, c in enumerate(child_nums)]
    aggs += [(F.sum(F.col(f"__ps{i}") * F.col("__cn")) / F.sum(F.col(f"__pc{i}") * F.col("__cn")))
             .alias(f"avg_{pn.get(c, c)}") for i, c in enumerate(parent_nums)]
    aggs.append(F.sum(F.col("__cn") * F.col("__pm")).alias("row_count"))
    dims = [cn.get(d, d) for d in child_dims] + [pn.get(d, d) for d in parent_dims]
    return j.groupBy(*dims).agg(*aggs) if dims else j.agg(*aggs)


def group_average(df: DataFrame, dims, nums) -> DataFrame:
    """``avg_<col>`` of each numeric column and ``row_count``, by ``dims`` (or global)."""
    aggs = [F.avg(F.col(c)).alias(f"avg_{c}") for c in nums] + [F.count(F.lit(1)).alias("row_count")]
    return df.groupBy(*dims).agg(*aggs) if dims else df.agg(*aggs)


def distinct_rows(df: DataFrame, columns=None) -> DataFrame:
    """Keep one row per distinct value of ``columns`` (all columns by default)."""
    return df.dropDuplicates(list(columns)) if columns else df.dropDuplicates()


# The pattern checks the generated person tables must pass.
ZIP_PATTERN = r"^\d{5}$"


def pattern_rates(df: DataFrame, checks: dict) -> DataFrame:
    """Pass rate of each boolean check (name -> Column); NULL counts as a failure."""
    names = list(checks)
    row = df.agg(*[F.avg(F.coalesce(checks[n], F.lit(False)).cast("double")).alias(f"pass_rate__{i}")
                   for i, n in enumerate(names)])
    return _unpivot(row, names, ["pass_rate"], label="check_name")


def standard_checks(zip_col=None, name_col=None, email_col=None) -> dict:
    """The three property checks: 5-digit ZIP, name with a space, email with '@'."""
    out = {}
    if zip_col:
        out["zip_5_digits"] = F.col(zip_col).rlike(ZIP_PATTERN)
    if name_col:
        out["name_has_space"] = F.col(name_col).contains(" ")
    if email_col:
        out["email_has_at"] = F.col(email_col).contains("@")
    return out
