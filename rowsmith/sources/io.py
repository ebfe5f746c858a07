"""Scans and sinks (S1-S12): CSV/JSON/Parquet reads with explicit schemas,
partitioned overwrite writes, catalog registration, compaction, exports, samples."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

DEFAULT_FORMAT = "parquet"
PART_SUFFIX = "_date"
GRAINS = {"day": "_date", "month": "_month", "year": "_year"}


# Both directions of CSV: quotes are doubled inside quoted fields, so line breaks, quotes and
# backslashes survive; blanks at the ends stay; times keep microseconds.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
               "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Rows of one CSV file: files with quoted line breaks cannot be split when read.
CSV_ROWS_PER_FILE = 100_000


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header CSV with quoted line breaks; the declared schema when given (no inference
    pass), else inference."""
    # nothing between two commas is NULL, quotes around nothing an empty text: the parser puts
    # this mark where nothing was
    r = spark.read.options(**CSV_OPTIONS).options(multiLine="true", emptyValue="", nullValue="\u0000no value\u0000")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None,
              options: dict | None = None) -> DataFrame:
    """JSON lines."""
    r = spark.read.options(**(options or {}))
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_table(spark: SparkSession, path: str, fmt: str = DEFAULT_FORMAT) -> DataFrame:
    """S3: a written table (Parquet by default; ``delta`` when the jar is present)."""
    return spark.read.format(fmt).load(path)


def partition_column(df: DataFrame) -> str | None:
    """First date or timestamp column, the layout key of every layer."""
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return f.name
    return None


def with_partition_key(df: DataFrame, column: str | None, grain: str = "day") -> tuple[DataFrame, str | None, bool]:
    """(frame, key, derived): a date column to partition by, the column itself for dates at
    day grain, else a new ``<col>_date`` / ``<col>_month`` / ``<col>_year`` (the date truncated
    to the grain; underscores are added while the name is taken). Raw timestamps would give
    one directory per distinct instant."""
    if column is None or column not in df.columns:
        return df, None, False
    if grain == "day" and isinstance(df.schema[column].dataType, T.DateType):
        return df, column, False
    key = column + GRAINS[grain]
    while key.lower() in {c.lower() for c in df.columns}:
        key += "_"
    day = F.to_date(F.col(column))
    value = day if grain == "day" else F.trunc(day, "month" if grain == "month" else "year")
    return df.withColumn(key, value), key, True


def write_partitioned(df: DataFrame, path: str, fmt: str = DEFAULT_FORMAT, column: str | None = None,
                      mode: str = "overwrite", options: dict | None = None, grain: str = "day") -> str | None:
    """Overwrite write, partitioned by the date (or month/year) of ``column``.

    Rows are clustered by the partition key with the ``rebalance`` hint, so each
    task writes few directories (no small-file explosion), while AQE splits a
    skewed key (one hot day) over several tasks and merges tiny ones. Pick the
    grain so one partition holds at least a few hundred MB. Returns the key."""
    df2, key, _ = with_partition_key(df, column, grain)
    write_by_key(df2, path, fmt, key, mode, options)
    return key


def write_by_key(df2: DataFrame, path: str, fmt: str = DEFAULT_FORMAT, key: str | None = None,
                 mode: str = "overwrite", options: dict | None = None) -> None:
    """Write a frame partitioned by one of its columns (or not at all)."""
    w = df2.hint("rebalance", key).write if key else df2.write
    w = w.mode(mode).format(fmt)
    for k, v in (options or {}).items():
        w = w.option(k, v)
    if key:
        w = w.partitionBy(key)
    w.save(path)


def create_schema(spark: SparkSession, schema_name: str, location: str | None = None) -> None:
    """``CREATE SCHEMA IF NOT EXISTS`` (with an explicit location when given)."""
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema_name}`{loc}")


def register_table(spark: SparkSession, name: str, path: str, fmt: str = DEFAULT_FORMAT,
                   schema_name: str | None = None) -> str:
    """Register the table at ``path``; returns the full name. An entry whose columns or
    place are no longer those of the files is replaced (external tables keep their files); it is put aside under
    another name first and comes back if the new entry can't be made."""
    full = f"`{schema_name}`.`{name}`" if schema_name else f"`{name}`"
    aside = f"`{schema_name}`.`{name}__old`" if schema_name else f"`{name}__old`"
    replaced = False
    if spark.catalog.tableExists(full):
        now = {(f.name, f.dataType.simpleString()) for f in spark.read.format(fmt).load(path).schema}
        known = {(f.name, f.dataType.simpleString()) for f in spark.table(full).schema}
        if now != known or _plain_path(_location(spark, full)) != _plain_path(path):
            spark.sql(f"DROP TABLE IF EXISTS {aside}")
            spark.sql(f"ALTER TABLE {full} RENAME TO {aside}")
            replaced = True
    try:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {full} USING {fmt} LOCATION '{path}'")
        if spark.sql(f"DESCRIBE TABLE {full}").where("col_name = '# Partition Information'").count():
            spark.sql(f"ALTER TABLE {full} RECOVER PARTITIONS")   # register the existing directories
    except Exception:
        if replaced:
            spark.sql(f"DROP TABLE IF EXISTS {full}")
            spark.sql(f"ALTER TABLE {aside} RENAME TO {full}")
        raise
    if replaced:
        spark.sql(f"DROP TABLE {aside}")
    return full


def _location(spark: SparkSession, full: str) -> str:
    """Where a catalog entry's files are."""
    return json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {full} AS JSON").first()[0]).get("location", "")


def _plain_path(path: str) -> str:
    """A path without slashes after its scheme, the local scheme and a slash at its end."""
    return re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*):/*", r"\1:/", path).removeprefix("file:").rstrip("/")


#: Bytes that a compacted file aims at.
FILE_BYTES = 256 << 20


def compact(spark: SparkSession, path: str, out_path: str, file_bytes: int = FILE_BYTES, fmt: str = DEFAULT_FORMAT,
            partition_key: str | None = None) -> str:
    """Rewrite a table at ``out_path`` in files of about ``file_bytes`` (as shuffled); rows
    are unchanged. A ``rebalance`` by the partition value lets AQE split a hot value over as
    many tasks as its bytes need and merge small ones. Readers go to the new path."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, str(int(file_bytes)))
    try:
        df = spark.read.format(fmt).load(path)
        if partition_key and partition_key in df.columns:
            write_by_key(df, out_path, fmt, partition_key)
        else:
            df.hint("rebalance").write.mode("overwrite").format(fmt).save(out_path)
    finally:
        spark.conf.set(size, before)
    return out_path


def export_table(df: DataFrame, path: str, fmt: str = "csv", compression: str | None = None) -> str:
    """CSV with a header row, or Parquet; written in parallel part files."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.options(**CSV_OPTIONS).option("maxRecordsPerFile", CSV_ROWS_PER_FILE)
    if compression:
        w = w.option("compression", compression)
    w.save(path)
    return path


def export_all(tables: dict, root: str, fmt: str = "csv", compression: str | None = "gzip") -> dict:
    """Every table under ``root/<table>`` (gzip CSV by default) instead of one archive."""
    return {name: export_table(df, f"{root.rstrip('/')}/{name}", fmt, compression)
            for name, df in tables.items()}


def sample(df: DataFrame, n: int = 20, order_by=None) -> DataFrame:
    """The first ``n`` rows in an explicit order: a top-k per partition, then a merge of
    n rows per partition."""
    order = list(order_by) if order_by else [df.columns[0]]
    return df.orderBy(*order).limit(max(0, int(n)))
