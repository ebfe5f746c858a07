"""Synthetic table generation (projections over ``spark.range``).

``generate_table`` builds one table lazily:

1. dense primary key 1..n from ``spark.range`` (G1), partitions of about a million rows;
2. ``_batch = floor((key-1)/batch_rows)``: the scope of every statistic (z-scores, std,
   sorted temporal columns) at every size, so groups stay bounded (G26);
3. foreign keys sampled uniformly from the parent (G3): arithmetic when the parent
   key is dense 1..N, an index join otherwise; parent columns used by the parent
   influence step (G4) are re-evaluated at the sampled key when the parent is a
   generated table that never changes them, and joined in otherwise;
4. every other field from ``field_column`` (G5-G24);
5. parent influence (D8-D10), then the rule chain (D5) with temporal repair (C6). By
   default rows are built so that each batch lies inside one partition, and the
   chain runs per partition in pandas (``mapInPandas``): no exchange of generated
   rows. ``rule_method="window"`` uses window aggregates on ``_batch`` (one shuffle).

``generate_tables`` runs it parents-first for a whole schema (G25).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowsmith.functions.fields import GenContext, default_as_of, field_column
from rowsmith.operators import correlate, keys
from rowsmith.spec import SchemaSpec, TableSpec

BATCH_ROWS = 25_000
ROWS_PER_PARTITION = 1_000_000
CONTEXT_COLUMNS = ("age", "tenure", "comorbidity_count")


@dataclass(frozen=True)
class Generated:
    """A generated table: its DataFrame, row count, whether its key is dense 1..rows,
    the generation settings (``params``) and the columns changed after generation
    (``modified``). A child reads an unmodified column of such a parent by
    re-evaluating its generator at the sampled key instead of joining."""
    df: DataFrame
    rows: int
    spec: TableSpec | None
    dense_key: bool = True
    params: dict | None = None
    modified: frozenset = frozenset()


def modified_columns(table: TableSpec, rules, has_context: bool) -> frozenset:
    """Columns a table's generation may change after drawing them (a superset):
    parent-influence targets, rule targets and the repaired end column."""
    out = set()
    if has_context:
        for f in table.fields:
            if (f.is_numeric and (correlate._has(f.name, correlate.PARENT_NUM_WORDS)
                                  or correlate._has(f.name, correlate.COMORB_WORDS))) or \
               (f.type == "boolean" and correlate._has(f.name, correlate.PARENT_FLAG_WORDS)):
                out.add(f.name)
    names = table.field_names
    live = [r for r in rules if correlate.applicable(r, table, names)]
    out |= {r.target for r in live}
    if live:
        from rowsmith.operators.constraints import temporal_pair
        pair = temporal_pair(names)
        if pair:
            out.add(pair[1])
    return frozenset(out)


def generate_table(spark: SparkSession, table: TableSpec, rows: int, *, parents=None,
                   seed: int = 42, as_of: datetime | None = None, mode: str = "fast",
                   batch_rows: int = BATCH_ROWS, rules=None, parent_influence: bool = True,
                   exact_names: bool = False, rows_per_partition: int = ROWS_PER_PARTITION,
                   rule_method: str = "auto", keep_batch: bool = False,
                   ids: DataFrame | None = None, exact_order: bool = False) -> DataFrame:
    """Generate ``rows`` rows of ``table``.

    ``parents``: table name -> ``Generated`` (or DataFrame) for foreign keys.
    ``rules``: correlation rules; None means the name-derived default set.
    ``ids``: optional frame with a dense ``_row`` column (1..rows) to generate over
    instead of ``spark.range`` (e.g. one synthetic row per row of a given table).
    ``exact_order``: row-ordered temporal columns by sorting each batch's draws (a join by rank) instead of strata.
    """
    parents = parents or {}
    as_of = as_of or default_as_of()
    rows = int(rows)
    ctx = GenContext(table=table.name, seed=seed, as_of=as_of, mode=mode, rows=rows,
                     batch_rows=batch_rows, batched=True, exact_names=exact_names, exact=exact_order)
    # default: batches aligned with partitions and the chain run per partition (no shuffle);
    # "window" / "pandas" keep the shuffled forms, and ``ids``-driven rows always use them
    aligned = rule_method in ("auto", "partition") and ids is None
    if aligned:
        # every batch built from one batch id inside one partition: batches never straddle partitions
        n_batches, width = math.ceil(rows / batch_rows), batch_rows
        parts = min(max(1, n_batches), max(spark.sparkContext.defaultParallelism, math.ceil(rows / rows_per_partition)))
        b = F.col("id")
        base = spark.range(0, n_batches, 1, parts).select(F.explode(F.sequence(
            b * F.lit(width) + F.lit(1), F.least((b + F.lit(1)) * F.lit(width), F.lit(rows)))).alias("_row"))
    elif ids is None:
        parts = max(spark.sparkContext.defaultParallelism, math.ceil(rows / rows_per_partition))
        parts = max(1, min(parts, rows))
        base = spark.range(1, rows + 1, 1, parts).withColumnRenamed("id", "_row")
    else:
        base = ids.select("_row")
    batch = F.floor((F.col("_row") - 1) / F.lit(batch_rows)).cast("long")
    df = base.withColumn("_batch", batch)

    fk_cols: dict[str, str] = {}
    context_cols: list[str] = []
    joined_rows = False           # a join moves rows, so batches may then straddle partitions
    for fk in table.foreign_keys:
        parent = parents.get(fk.ref_table)
        if parent is None or fk.ref_table == table.name:
            continue
        if isinstance(parent, DataFrame):
            parent = Generated(parent, 0, None, dense_key=False)
        if parent.dense_key and parent.rows <= 0:
            continue
        pdf = parent.df
        ref = fk.ref_column if fk.ref_column in pdf.columns else pdf.columns[0]
        wanted = [c for c in CONTEXT_COLUMNS if c in pdf.columns and c != ref] if parent_influence else []
        pk = parent.spec.primary_key if parent.spec is not None else None
        if parent.dense_key and ref == pk:
            df = df.withColumn(fk.column, keys.sample_dense_foreign_key(
                parent.rows, "_row", fk.column, seed, table.name, mode))
            redraw = [c for c in wanted if parent.params is not None and c not in parent.modified
                      and c != pk and parent.spec.field(c) is not None]
            if redraw:
                # the parent's value at the sampled key, re-evaluated: no join, no shuffle
                pctx = GenContext(table=parent.spec.name, row_col=fk.column, **parent.params)
                cols = {f"{fk.column}__{c}": field_column(parent.spec.field(c), pctx) for c in redraw}
                df = pctx.finish(pctx.prepare(df).withColumns(cols))
            joined = [c for c in wanted if c not in redraw]
            if joined:
                df = keys.attach_parent(df, pdf, fk.column, ref, joined)
                joined_rows = True
        else:
            df = keys.sample_foreign_key(df, pdf, fk.column, ref, "_row", seed, table.name, mode,
                                         context=wanted)
            joined_rows = True
        fk_cols[fk.column] = ref
        context_cols += [f"{fk.column}__{c}" for c in wanted]

    gen = {}
    for f in table.fields:
        if f.name == table.primary_key:
            gen[f.name] = F.col("_row")
        elif f.name in fk_cols:
            continue
        else:
            gen[f.name] = field_column(f, ctx)
    joined_rows = joined_rows or bool(ctx.sorted_draws)
    df = ctx.finish(ctx.prepare(df).withColumns(gen))
    by = ("_batch",)
    # Chained statistics use windows on _batch: one shuffle and sort shared by every step.
    # (Broadcasting grouped statistics back would leave rows in place, but each step's
    # statistics are computed from the previous step's output, so the plan doubles per step.)
    rule_list = correlate.default_rules(table) if rules is None else list(rules)
    if aligned and joined_rows:
        aligned = False               # rows were shuffled by a join: use the shuffled forms
    if aligned:
        # no exchange of the rows: each partition holds whole batches (see above)
        df = correlate.apply_chain_per_partition(df, table, context_cols if parent_influence else [],
                                                 rule_list, "_batch", seed, "_row", mode)
    else:
        if parent_influence and context_cols:
            df = correlate.apply_parent_influence(df, table, context_cols, by, seed, "_row", mode)
        df = correlate.apply_rules(df, rule_list, table, by, seed, "_row", mode, fill_median=False,
                                   method="pandas" if rule_method == "pandas" else "window")
    out = [F.col(f.name) for f in table.fields if f.name in df.columns]
    if keep_batch:
        out.append(F.col("_batch"))
    # undeclared foreign-key columns were only sampled for context: dropped here
    return df.select(*out)


def generate_tables(spark: SparkSession, spec: SchemaSpec, row_count: int, *, seed: int = 42,
                    as_of: datetime | None = None, mode: str = "fast", rules=None,
                    **kwargs) -> dict[str, DataFrame]:
    """Every table of a schema, parents first; ``rules``: table -> list or None."""
    as_of = as_of or default_as_of()
    done: dict[str, Generated] = {}
    for table in spec.parents_first():
        n = table.rows_for(row_count)
        table_rules = None if rules is None else rules.get(table.name, None)
        done[table.name] = generate(spark, table, n, parents=done, seed=seed, as_of=as_of, mode=mode,
                                    rules=table_rules, **kwargs)
    return {name: g.df for name, g in done.items()}


def generate(spark: SparkSession, table: TableSpec, rows: int, *, parents=None, seed: int = 42,
             as_of: datetime | None = None, mode: str = "fast", rules=None, parent_influence: bool = True,
             batch_rows: int = BATCH_ROWS, exact_names: bool = False, **kwargs) -> Generated:
    """``generate_table`` plus what children need to read it without joins."""
    as_of = as_of or default_as_of()
    parents = parents or {}
    df = generate_table(spark, table, rows, parents=parents, seed=seed, as_of=as_of, mode=mode, rules=rules,
                        parent_influence=parent_influence, batch_rows=batch_rows, exact_names=exact_names,
                        **kwargs)
    has_context = parent_influence and any(
        fk.ref_table in parents and fk.ref_table != table.name and
        any(c in _parent_df(parents[fk.ref_table]).columns for c in CONTEXT_COLUMNS)
        for fk in table.foreign_keys)
    rule_list = correlate.default_rules(table) if rules is None else list(rules)
    params = dict(seed=seed, as_of=as_of, mode=mode, rows=int(rows), batch_rows=batch_rows,
                  batched=True, exact_names=exact_names)
    return Generated(df, int(rows), table, True, params, modified_columns(table, rule_list, has_context))


def _parent_df(p) -> DataFrame:
    return p.df if isinstance(p, Generated) else p
