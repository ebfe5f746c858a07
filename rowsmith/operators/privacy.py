"""Masking of personal columns (H1-H6). All per-row native expressions; the same
calls work unchanged on streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowsmith.spec import TableSpec

# Pseudonym e-mail format and ZIP generalisation suffix.
EMAIL_PREFIX, EMAIL_DOMAIN, EMAIL_HEX = "user+", "@example.com", 12
ZIP_KEEP, ZIP_SUFFIX = 3, "XX"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_mask(c) -> Column:
    """H1: SHA-256 hex digest."""
    return F.sha2(_c(c).cast("string"), 256)


def email_pseudonym(c) -> Column:
    """H2: ``user+<first 12 hex of sha256>@example.com``."""
    return F.concat(F.lit(EMAIL_PREFIX), F.substring(F.sha2(_c(c).cast("string"), 256), 1, EMAIL_HEX),
                    F.lit(EMAIL_DOMAIN))


def zip_generalize(c) -> Column:
    """H3: first three characters + ``XX``."""
    return F.concat(F.substring(_c(c).cast("string"), 1, ZIP_KEEP), F.lit(ZIP_SUFFIX))


MASKS = {"hash": hash_mask, "email": email_pseudonym, "zip": zip_generalize}


def mask_kind(column: str) -> str:
    """Default mask for a column name: e-mail pseudonym, ZIP generalisation, else hash."""
    low = column.lower()
    if "email" in low:
        return "email"
    if "zip" in low or "postal" in low:
        return "zip"
    return "hash"


def pii_inventory(spark, spec) -> DataFrame:
    """H4: (table_name, column_name) of every field flagged ``pii`` in a SchemaSpec."""
    rows = [(t.name, f.name) for t in spec.tables for f in t.fields if f.pii]
    return spark.createDataFrame(rows, "table_name string, column_name string")


def flagged(df: DataFrame, columns) -> list[str]:
    """The columns to mask: a list of names, or the ``pii`` fields of a TableSpec. Unknown
    names raise, so a misspelt column cannot leave raw values behind."""
    names = [f.name for f in columns.fields if f.pii] if isinstance(columns, TableSpec) else list(columns)
    unknown = [c for c in names if c not in df.columns]
    if unknown:
        raise ValueError(f"columns to mask are not in the frame: {', '.join(unknown)}")
    return names


def mask(df: DataFrame, columns, kinds: dict | None = None) -> DataFrame:
    """H5: replace each listed or flagged column by its masked value (raw values do not survive)."""
    kinds = kinds or {}
    return df.withColumns({c: MASKS[kinds.get(c, mask_kind(c))](c) for c in flagged(df, columns)})


def mask_audit(df: DataFrame, columns, kinds: dict | None = None) -> DataFrame:
    """H6: per masked column: rows whose masked value equals the raw one, and the
    distinct counts before and after.

    Rows are first counted by (column, raw value), so each distinct value is masked and
    hashed once, however many rows hold it; one scan, no Expand over masked values."""
    kinds = kinds or {}
    cols = flagged(df, columns)
    each = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("raw"))
                                         for i, c in enumerate(cols)])).alias("e")).select("e.*")
    values = each.groupBy("i", "raw").agg(F.count(F.lit(1)).alias("n"))
    masked = F.lit(None).cast("string")
    for i, c in enumerate(cols):
        masked = F.when(F.col("i") == i, MASKS[kinds.get(c, mask_kind(c))]("raw")).otherwise(masked)
    pairs = values.withColumn("masked", masked).groupBy("i", "masked").agg(
        F.sum(F.when(F.col("masked") == F.col("raw"), F.col("n")).otherwise(0)).alias("same"),
        F.count("raw").alias("raws"))
    found = pairs.groupBy("i").agg(F.sum("same").alias("unchanged_rows"), F.sum("raws").alias("distinct_raw"),
                                   F.count("masked").alias("distinct_masked"))
    names = df.sparkSession.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(c).alias("column_name")) for i, c in enumerate(cols)])).alias("e")).select("e.*")
    return names.join(found, "i", "left").select("column_name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (
        "unchanged_rows", "distinct_raw", "distinct_masked")])
