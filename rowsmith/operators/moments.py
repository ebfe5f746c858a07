"""Mergeable statistics: co-moments of column pairs (E4, E7) and distinct-count sketches.

A *state* is a small DataFrame that can be written next to a table, and merged with the state of new rows; the
result is that of a run over all rows. Both kinds read a table once, whatever the number of columns.

Co-moments: for each pair of columns the rows where both are there, their means, summed squared deviations and
summed products of deviations. A task works on Arrow batches as matrices: with values moved by the batch's
means and missing ones as 0, five matrix products give the sums of all pairs. States merge by the pairwise update of
means and deviations (Chan, Golub and LeVeque), never by differences of large sums. A task emits one row per
pair, so the shuffle does not grow with the rows.

Sketches: one HyperLogLog sketch per column (``hll_sketch_agg``), with row and missing counts, from one
aggregation without expanding rows; sketches of any partitioning merge by ``hll_union_agg``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

MOMENTS = "col_a string, col_b string, rows long, n long, mean_a double, mean_b double, m2_a double, m2_b double, c double"
#: log2 of a sketch's buckets: a relative standard error of about 0.8 %.
LG_BUCKETS = 14


def _batch_state(x: np.ndarray) -> np.ndarray:
    """(n, mean_a, mean_b, m2_a, m2_b, c) of all ordered pairs of columns, NaN is missing; shape (6, columns, columns)."""
    there = ~np.isnan(x)
    count = there.sum(axis=0)
    with np.errstate(invalid="ignore"):
        middle = np.where(count > 0, np.where(there, x, 0.0).sum(axis=0) / np.maximum(count, 1), 0.0)
        low, high = np.where(there, x, np.inf).min(axis=0, initial=np.inf), np.where(there, x, -np.inf).max(axis=0, initial=-np.inf)
        middle = np.where(low == high, low, middle)          # a constant's deviations are exactly 0
        y = np.where(there, x - middle, 0.0)
    m = there.astype(float)
    n = m.T @ m
    total, squares, products = y.T @ m, (y * y).T @ m, y.T @ y
    some = np.maximum(n, 1)
    mean, m2 = middle[:, None] + total / some, np.maximum(squares - total * total / some, 0.0)
    return np.stack([n, mean, mean.T, m2, m2.T, products - total * total.T / some])


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state of two disjoint sets of rows."""
    n = a[0] + b[0]
    share = np.where(n > 0, b[0] / np.maximum(n, 1), 0.0)
    both = a[0] * share
    da, db = np.where(a[0] > 0, b[1] - a[1], 0.0), np.where(a[0] > 0, b[2] - a[2], 0.0)
    return np.stack([n, np.where(a[0] > 0, a[1] + da * share, b[1]), np.where(a[0] > 0, a[2] + db * share, b[2]),
                     a[3] + b[3] + da * da * both, a[4] + b[4] + db * db * both, a[5] + b[5] + da * db * both])


def comoments(df: DataFrame, columns: list[str]) -> DataFrame:
    """The co-moment state of ``columns`` over all rows (NULL and NaN are missing): a row per pair a <= b
    in the columns' order, with the number of all rows."""
    columns = list(columns)

    def work(batches):
        state, rows = None, 0
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(columns))])
                own = _batch_state(x)
                state, rows = own if state is None else _merge(state, own), rows + batch.num_rows
        if state is not None:
            a, b = np.triu_indices(len(columns))
            names = np.array(columns, object)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[a], pa.string()), pa.array(names[b], pa.string()), pa.array(np.full(len(a), rows)),
                 pa.array(state[0][a, b].astype(np.int64)), *[pa.array(state[k][a, b]) for k in range(1, 6)]],
                names=[f.split()[0] for f in MOMENTS.split(", ")])

    numbers = [F.col(f"`{c}`").cast("double").alias(str(i)) for i, c in enumerate(columns)]
    pairs = [(a, b, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0) for i, a in enumerate(columns) for b in columns[i:]]
    none = df.sparkSession.createDataFrame(pairs, MOMENTS)           # so that a table without rows has its pairs too
    return merge_comoments(none, df.select(*numbers).mapInArrow(work, MOMENTS))


def merge_comoments(*states: DataFrame) -> DataFrame:
    """One state of several states over disjoint rows."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    parts = rows.groupBy("col_a", "col_b").agg(F.sum("rows").alias("rows"), F.array_sort(F.collect_list(F.struct(
        "n", "mean_a", "mean_b", "m2_a", "m2_b", "c"))).alias("parts"))
    none = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(x) for x in ("mean_a", "mean_b", "m2_a", "m2_b", "c")])

    def step(s: Column, t: Column) -> Column:
        n = s["n"] + t["n"]
        share = F.when(n > 0, t["n"] / n).otherwise(0.0)
        both = F.when(s["n"] > 0, s["n"] * share).otherwise(0.0)
        da, db = t["mean_a"] - s["mean_a"], t["mean_b"] - s["mean_b"]
        mean = lambda k, d: F.when(s["n"] == 0, t[k]).otherwise(s[k] + d * share)
        return F.struct(n.alias("n"), mean("mean_a", da).alias("mean_a"), mean("mean_b", db).alias("mean_b"),
                        (s["m2_a"] + t["m2_a"] + da * da * both).alias("m2_a"), (s["m2_b"] + t["m2_b"] + db * db * both).alias("m2_b"),
                        (s["c"] + t["c"] + da * db * both).alias("c"))

    return parts.select("col_a", "col_b", "rows", F.aggregate(F.filter("parts", lambda p: p["n"] > 0), none, step).alias("s")).select(
        "col_a", "col_b", "rows", "s.*")


def correlations(state: DataFrame, digits: int = 4) -> DataFrame:
    """(col_a, col_b, corr, rows) for every ordered pair of a state; NULL where a column is constant or missing."""
    corr = F.round(F.try_divide(F.col("c"), F.sqrt(F.col("m2_a") * F.col("m2_b"))), digits)
    one = state.select("col_a", "col_b", corr.alias("corr"), "rows")
    both = F.array(F.struct("col_a", "col_b"), F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b")))
    pairs = F.when(F.col("col_a") == F.col("col_b"), F.slice(both, 1, 1)).otherwise(both)
    return one.select(F.explode(pairs).alias("p"), "corr", "rows").select("p.*", "corr", "rows")


def _sketchable(df: DataFrame, name: str) -> Column:
    """The column as integers, equal values alike: hashes of 64 bits where it holds none, so that no value is written
    out as text (collated strings stay, sketches know their equal forms)."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.IntegerType, T.LongType)) or isinstance(kind, T.StringType) and kind.collation != "UTF8_BINARY":
        return c
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0).cast(kind)                                           # -0.0 is 0.0
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        c = F.to_json(F.struct(c))
    elif not isinstance(kind, (T.StringType, T.BinaryType, T.BooleanType, T.NumericType, T.DatetimeType)):
        c = c.cast("string")
    return F.xxhash64(c)


def _missing(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else c.isNull()


def profile_state(df: DataFrame, table_name: str, by: list[str] = (), lg_buckets: int = LG_BUCKETS) -> DataFrame:
    """The profile state of a table: a row per column (and per value of ``by``) with table_name, column_name, rows,
    missing and a sketch of its distinct values. One aggregation over one scan: the values to sketch are computed in a
    projection before it, in compiled code, since sketches interpret their argument for every row."""
    names = [c for c in df.columns if c not in by]
    values = [F.when(~_missing(df, c), _sketchable(df, c)).alias(f"__v{i}") for i, c in enumerate(names)]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(names)):
        aggs += [F.count_if(F.col(f"__v{i}").isNull()).alias(f"m{i}"),
                 F.hll_sketch_agg(f"__v{i}", F.lit(lg_buckets)).alias(f"s{i}")]
    wide = df.select(*by, *values).groupBy(*by).agg(*aggs)
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing"), F.col(f"s{i}").alias("sketch"))
                     for i, c in enumerate(names)])
    return wide.select(F.lit(table_name).alias("table_name"), *by, "rows", F.explode(each).alias("e")).select(
        "table_name", *by, "e.column_name", "rows", "e.missing", "e.sketch")


def merge_profiles(*states: DataFrame) -> DataFrame:
    """One state of several states over disjoint rows (their ``by`` columns are given up)."""
    columns = ["table_name", "column_name", "rows", "missing", "sketch"]
    rows = states[0].select(*columns)
    for s in states[1:]:
        rows = rows.unionByName(s.select(*columns))
    return rows.groupBy("table_name", "column_name").agg(F.sum("rows").alias("rows"), F.sum("missing").alias("missing"),
                                                         F.hll_union_agg("sketch").alias("sketch"))


def profile(state: DataFrame) -> DataFrame:
    """(table_name, column_name, null_fraction, distinct_count, rows) of a state; distinct counts are estimates."""
    share = F.when(F.col("rows") > 0, F.col("missing") / F.col("rows")).otherwise(0.0)
    return state.select("table_name", "column_name", share.alias("null_fraction"),
                        F.hll_sketch_estimate("sketch").alias("distinct_count"), "rows")
