"""Key operators: dense row index, foreign-key sampling and parent attachment.

``dense_index`` gives each row the 1-based rank of its key without a global window:
range-partition on the key, sort inside partitions, and *write* each row with its
partition number and position to the shared scratch folder. Per-partition counts, their
running sums and the index are all computed from those written rows, so they describe one
and the same layout whatever bounds Spark sampled for it (range bounds are sampled anew
each time a plan is run, so two evaluations of one range partitioning need not agree).
The table of running sums has one row per partition; broadcasting it is bounded by the
partition count, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowsmith.functions import rng
from rowsmith.session import written

POS_MASK = (1 << 33) - 1   # monotonically_increasing_id keeps the row position in the low 33 bits


def dense_index(df: DataFrame, key: str, index_col: str = "_idx",
                num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Return (``df`` + 1-based ``index_col`` ordered by ``key``, one-row frame ``_n``
    with the row count, usable as a scalar subquery).

    Runs one job, which writes ``df``'s columns in key order. NULL keys come first; rows
    with equal keys get neighbouring indexes in an order that the written table fixes."""
    n_parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n_parts, F.col(key))
                       .sortWithinPartitions(key)
                       .withColumn("_pid", F.spark_partition_id())
                       .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(POS_MASK))), "ranked")
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # a global window, but over one row per partition (bounded by the partition count)
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    total = ranged.agg(F.count(F.lit(1)).alias("_n"))
    indexed = (ranged.join(F.broadcast(offsets), "_pid")
                     .withColumn(index_col, (F.col("_off") + F.col("_pos") + F.lit(1)).cast("long"))
                     .drop("_pid", "_pos", "_off"))
    return indexed, total


def sample_index(n: Column, u: Column) -> Column:
    """Uniform 1-based index in [1, n] from a uniform draw."""
    return (F.floor(u * n) + F.lit(1)).cast("long")


def sample_foreign_key(child: DataFrame, parent: DataFrame, fk: str, ref: str, id_col: str,
                       seed: int = 42, table: str = "t", mode: str = "portable",
                       context=(), prefix: str | None = None) -> DataFrame:
    """G3 + G4 for an arbitrary parent key: each child row draws a uniform parent row
    (with replacement) and takes its ``ref`` value as ``fk``; ``context`` parent
    columns come along as ``<prefix>__<col>``.

    The child joins the indexed parent on the drawn index: a plain equi-join that
    AQE may broadcast when the parent is small and sort-merges otherwise. Uniform
    draws spread the child evenly over parent keys, so the join is not skewed."""
    prefix = prefix or fk
    keep = [ref] + [c for c in context if c != ref]
    indexed, total = dense_index(parent.select(*keep).where(F.col(ref).isNotNull()), ref, "_pidx_key")
    u = rng.uniform(F.col(id_col), seed, table, fk + "#fk", 0, mode)
    drawn = child.withColumn("_pidx", sample_index(total.select("_n").scalar(), u))
    right = indexed.select(F.col("_pidx_key").alias("_pidx"), F.col(ref).alias(fk),
                           *[F.col(c).alias(f"{prefix}__{c}") for c in keep[1:]])
    if fk in drawn.columns:
        drawn = drawn.drop(fk)
    return drawn.join(right, "_pidx", "inner").drop("_pidx")


def sample_dense_foreign_key(n_parent: int, id_col: str, fk: str, seed: int = 42, table: str = "t",
                             mode: str = "portable") -> Column:
    """G3 for a parent whose key is exactly 1..n_parent: arithmetic, no join."""
    u = rng.uniform(F.col(id_col), seed, table, fk + "#fk", 0, mode)
    return sample_index(F.lit(int(n_parent)), u)


def attach_parent(child: DataFrame, parent: DataFrame, fk: str, ref: str, columns,
                  prefix: str | None = None) -> DataFrame:
    """The parent row's ``columns`` as ``<prefix>__<col>``, joined on ``fk == ref``.

    Only the needed parent columns are read (Catalyst prunes the scan)."""
    prefix = prefix or fk
    cols = [c for c in columns if c in parent.columns and c != ref]
    right = parent.select(F.col(ref).alias("__ref"), *[F.col(c).alias(f"{prefix}__{c}") for c in cols])
    return child.join(right, child[fk] == right["__ref"], "inner").drop("__ref")
