"""Tables whose schema changes between loads (S7) and whose partitions are overwritten alone.

Each change of schema is a numbered entry under ``<path>/_schemas``; a table is read with its newest
schema. A load may leave out columns, add some, or bring a wider or narrower type of a
column: columns are the union, and a type is widened to one that holds all values of both, so files of
earlier loads are read as they are, never rewritten. A change that could lose values is an
error before anything is written.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowsmith.sources.io import with_partition_key

LOG = "_schemas"
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class SchemaConflict(ValueError):
    """No type holds all values of two loads of a column."""


def widened(a: T.DataType, b: T.DataType, name: str = "") -> T.DataType:
    """The type that holds all values of both and that files of either are read as without loss."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    pair = (a, b)
    if all(isinstance(x, _WHOLE) for x in pair):
        return max(pair, key=lambda x: next(i for i, kind in enumerate(_WHOLE) if isinstance(x, kind)))
    if all(isinstance(x, (T.FloatType, T.DoubleType)) for x in pair):
        return T.DoubleType()
    if any(isinstance(x, T.DoubleType) for x in pair) and any(isinstance(x, _WHOLE[:3]) for x in pair):
        return T.DoubleType()
    if all(isinstance(x, T.DecimalType) for x in pair):
        scale = max(x.scale for x in pair)
        digits = max(x.precision - x.scale for x in pair) + scale
        if digits <= 38:
            return T.DecimalType(digits, scale)
    if any(isinstance(x, T.DateType) for x in pair) and any(isinstance(x, T.TimestampNTZType) for x in pair):
        return T.TimestampNTZType()
    raise SchemaConflict(f"column {name}: neither {a.simpleString()} nor {b.simpleString()} holds the other's values")


def merged(old: T.StructType, new: T.StructType) -> T.StructType:
    """All columns of both (names compare without case, the old spelling and order stay), with widened types."""
    later = {f.name.lower(): f for f in new.fields}
    out = []
    for f in old.fields:
        g = later.pop(f.name.lower(), None)
        out.append(T.StructField(f.name, widened(f.dataType, g.dataType, f.name) if g else f.dataType))
    return T.StructType(out + [T.StructField(f.name, f.dataType) for f in later.values()])


def _log(spark: SparkSession, path: str) -> list[dict]:
    """Entries (version, schema, keys) of the schema log, oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{LOG}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    rows = spark.read.schema("version int, schema string, keys array<string>").json(f"{path}/{LOG}/*")
    return [r.asDict() for r in rows.orderBy("version").collect()]


def schema_log(spark: SparkSession, path: str) -> list[T.StructType]:
    """The table's schemas, oldest first."""
    return [T.StructType.fromJson(json.loads(e["schema"])) for e in _log(spark, path)]


def load(df: DataFrame, path: str, column: str | None = None, grain: str = "day", mode: str = "append") -> T.StructType:
    """Write a load and return the table's schema after it, partitioned by the date (or month/year) of ``column``.

    ``append`` adds rows, ``overwrite`` replaces the whole table (and starts its schema anew, kept in the log),
    ``partitions`` replaces just the partitions that the load has rows of. The schema is logged first, so files never hold a
    column that readers don't know."""
    if mode not in ("append", "overwrite", "partitions"):
        raise ValueError(f"mode is append, overwrite or partitions, not {mode!r}")
    spark = df.sparkSession
    log = _log(spark, path)
    keyed, key, _ = with_partition_key(df, column, grain)
    keys = [key] if key else []
    now = T.StructType([T.StructField(f.name, f.dataType) for f in keyed.schema.fields])
    if log and mode != "overwrite":
        old = T.StructType.fromJson(json.loads(log[-1]["schema"]))
        if log[-1]["keys"] != keys:
            raise SchemaConflict(f"the table is partitioned by {log[-1]['keys']}, the load by {keys}")
        now = merged(old, now)
    if any(isinstance(f.dataType, T.NullType) for f in now.fields):
        raise SchemaConflict("a column without a type can't be stored")
    if not log or log[-1]["schema"] != now.json() or log[-1]["keys"] != keys:
        version = log[-1]["version"] + 1 if log else 1
        spark.createDataFrame([(version, now.json(), keys)], "version int, schema string, keys array<string>").coalesce(1).write.mode(
            "overwrite").json(f"{path}/{LOG}/{version}")
    spelled = {f.name.lower(): f.name for f in now.fields}
    keyed = keyed.toDF(*[spelled[c.lower()] for c in keyed.columns])
    w = (keyed.hint("rebalance", key) if key else keyed).write
    w = w.partitionBy(*keys) if keys else w
    if mode == "append":
        w.mode("append").parquet(path)
    elif mode == "partitions":
        if not keys:
            raise ValueError("only a partitioned table has partitions to replace")
        w.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        _replace(spark, w, path)
    return now


def _replace(spark: SparkSession, writer, path: str) -> None:
    """A static overwrite clears the folder, the schema log too: put the log back."""
    log = _log(spark, path)
    writer.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    for e in log:
        spark.createDataFrame([(e["version"], e["schema"], e["keys"])], "version int, schema string, keys array<string>").coalesce(
            1).write.mode("overwrite").json(f"{path}/{LOG}/{e['version']}")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table with its newest schema (or the columns and types it had at a version): columns that a file lacks are
    NULL, narrower types are widened by the scan."""
    log = {e["version"]: e for e in _log(spark, path)}
    if not log:
        return spark.read.parquet(path)
    newest = T.StructType.fromJson(json.loads(log[max(log)]["schema"]))
    df = spark.read.schema(newest).parquet(path)
    if version is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromJson(json.loads(log[version]["schema"])).fields])
    return df
