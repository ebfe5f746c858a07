"""Versions of a Parquet table: compaction (S8) and purge (R1) that leave other files alone.

A version is a written list of the table's data files. New files go to a folder of their own
under the table, and only then is the next list written; the newest complete list is the
table. So a failure between the two steps leaves the old version current and readable, and whoever
still reads an older version finds its files until ``vacuum``. Before the first list the
folder itself is the table (version 0). Lists and new files lie in folders that begin with an
underscore, which plain scans of the folder skip: those keep seeing version 0.

Drivers handle one row per data file, which Spark's own file index does for any scan.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from datetime import date, datetime, time, timedelta, timezone
from urllib.parse import unquote
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowsmith.operators.retention import DEFAULT_TTL_MINUTES, retain
from rowsmith.sources.io import FILE_BYTES

LISTS, DATA = "_versions", "_data"
ENTRY = T.StructType([T.StructField("root", T.StringType()), T.StructField("file", T.StringType()),
                      T.StructField("bytes", T.LongType()), T.StructField("schema", T.StringType())])
#: A file smaller than this share of the target is small.
SMALL = 0.75
#: File-to-bin rows that are broadcast at most.
BROADCAST_FILES = 50_000
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> int:
    """The newest version whose list is complete; 0 if there is none."""
    at, fs = _fs(spark, f"{path}/{LISTS}")
    if not fs.exists(at):
        return 0
    done = [int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()
            and fs.exists(_fs(spark, f"{path}/{LISTS}/{s.getPath().getName()}/_SUCCESS")[0])]
    return max(done, default=0)


def _listing(spark: SparkSession, root: str, schema: str) -> list[tuple]:
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
             .load(root).select("path", "length"))          # lengths only: contents are not read
    return [(root, r["path"], r["length"], schema) for r in found.collect()]


def entries(spark: SparkSession, path: str, version: int | None = None) -> list[tuple]:
    """(root, file, bytes, schema) of a version's files."""
    v = current_version(spark, path) if version is None else version
    if v == 0:
        return _listing(spark, path, spark.read.parquet(path).schema.json())
    return [tuple(r) for r in spark.read.schema(ENTRY).parquet(f"{path}/{LISTS}/{v}").collect() if r["file"] is not None]


def _schema(spark: SparkSession, path: str, files: list[tuple]) -> T.StructType:
    kept = files or [tuple(r) for r in spark.read.schema(ENTRY).parquet(f"{path}/{LISTS}/{current_version(spark, path)}").collect()]
    import json
    return T.StructType.fromJson(json.loads(kept[0][3]))


def _read(spark: SparkSession, files: list[tuple], schema: T.StructType, with_file: bool = False) -> DataFrame:
    by_root = defaultdict(list)
    for root, file, *_ in files:
        by_root[root].append(file)
    out = spark.createDataFrame([], schema if not with_file else T.StructType([*schema.fields, T.StructField("_file", T.StringType())]))
    for root, some in sorted(by_root.items()):
        df = spark.read.option("basePath", root).schema(schema).parquet(*some)
        out = out.unionByName(df.withColumn("_file", F.col("_metadata.file_path")) if with_file else df.select(*schema.fieldNames()))
    return out


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as its newest (or the given) version."""
    files = entries(spark, path, version)
    return _read(spark, files, _schema(spark, path, files))


def _commit(spark: SparkSession, path: str, base: int, files: list[tuple], schema: T.StructType) -> int:
    """Write the list of version base + 1: the step that swaps versions. An existing one is an error
    (somebody else changed the table meanwhile)."""
    rows = files or [(None, None, None, schema.json())]        # an empty version still knows its schema
    spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("errorifexists").parquet(f"{path}/{LISTS}/{base + 1}")
    return base + 1


def partition_of(entry: tuple) -> dict[str, str]:
    """Partition values by key from a file's folders."""
    return {k: unquote(v) for k, v in re.findall(r"/([^/=]+)=([^/]*)(?=/)", entry[1][len(entry[0].rstrip("/")) - len(entry[0]):])}


def pack(files: list[tuple], file_bytes: int, small: float = SMALL) -> list[list[tuple]]:
    """Bins of small files of one partition folder, of ``file_bytes`` at most: each goes into the fullest bin that
    takes it, large files first. Bins of one file are left out, so there is nothing to do a second time."""
    folders = defaultdict(list)
    for f in files:
        if f[2] < small * file_bytes:
            folders[tuple(sorted(partition_of(f).items()))].append(f)
    out = []
    for _, some in sorted(folders.items()):
        bins: list[tuple[int, list]] = []
        for f in sorted(some, key=lambda f: (-f[2], f[1])):
            fit = max((k for k, (size, _) in enumerate(bins) if size + f[2] <= file_bytes), key=lambda k: bins[k][0], default=None)
            if fit is None:
                bins.append((f[2], [f]))
            else:
                bins[fit] = (bins[fit][0] + f[2], bins[fit][1] + [f])
        out += [b for _, b in bins if len(b) > 1]
    return out


def _plain(file: str) -> str:
    """A file's path without slashes after its scheme, whose number differs between sources of paths."""
    return re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*):/*", r"\1:/", file)


def compact_in_place(spark: SparkSession, path: str, file_bytes: int = FILE_BYTES, small: float = SMALL) -> int:
    """Merge the small files of each partition into files of up to ``file_bytes``; returns the version that is then
    current. Only small files are read and written, one task per new file; files above the target are untouched,
    and a table without two small files to merge keeps its version."""
    base = current_version(spark, path)
    files = entries(spark, path, base)
    bins = pack(files, file_bytes, small)
    if not bins:
        return base
    schema = _schema(spark, path, files)
    chosen = {f[1]: k for k, b in enumerate(bins) for f in b}
    rows = _read(spark, [f for b in bins for f in b], schema, with_file=True)
    by_plain = {_plain(f): k for f, k in chosen.items()}
    # paths in row metadata are URLs, those of listings are not
    names = [(r["_file"], by_plain[_plain(unquote(r["_file"]))]) for r in rows.select("_file").distinct().collect()]
    of = spark.createDataFrame(names, "_name string, _bin int")
    if len(names) <= BROADCAST_FILES:
        of = F.broadcast(of)
    keys = list(partition_of(bins[0][0]))
    root = f"{path}/{DATA}/{uuid.uuid4().hex}"
    moved = rows.join(of, F.col("_file") == F.col("_name")).repartitionById(len(bins), "_bin").select(*schema.fieldNames())
    w = moved.write
    (w.partitionBy(*keys) if keys else w).parquet(root)
    kept = [f for f in files if f[1] not in chosen]
    return _commit(spark, path, base, kept + _listing(spark, root, schema.json()), schema)


def _stretch(value: str, grain: str) -> tuple[datetime, datetime]:
    """The first instant of a partition's date stretch and the first one after it."""
    a = date.fromisoformat(value)
    b = a + timedelta(days=1) if grain == "day" else (
        date(a.year + a.month // 12, a.month % 12 + 1, 1) if grain == "month" else date(a.year + 1, 1, 1))
    return datetime.combine(a, time()), datetime.combine(b, time())


def purge(spark: SparkSession, path: str, created_col: str, as_of: datetime, ttl_minutes: int = DEFAULT_TTL_MINUTES,
          key: str | None = None, grain: str = "day") -> int:
    """Drop rows that :func:`retain` would drop from a table partitioned by the date (or month/year) ``key`` of
    ``created_col``; returns the version that is then current. Partitions that have expired are dropped from the
    list unread, later ones stay as they are, and only the partition that holds the limit is rewritten."""
    base = current_version(spark, path)
    files = entries(spark, path, base)
    schema = _schema(spark, path, files)
    key = key or f"{created_col}_date"
    cutoff = as_of - timedelta(minutes=ttl_minutes)
    if cutoff.tzinfo is None:
        cutoff = cutoff.replace(tzinfo=timezone.utc)
    zoned = isinstance(schema[created_col].dataType, T.TimestampType)      # its date is that of the session's zone
    cutoff = cutoff.astimezone(ZoneInfo(spark.conf.get("spark.sql.session.timeZone")) if zoned else timezone.utc).replace(tzinfo=None)
    stay, edge = [], []
    for f in files:
        value = partition_of(f)[key]
        if value == NO_VALUE:
            continue            # no time: never younger than the limit
        first, after = _stretch(value, grain)
        if first > cutoff:
            stay.append(f)
        elif after > cutoff:
            edge.append(f)
    if len(stay) == len(files):
        return base
    if edge:
        root = f"{path}/{DATA}/{uuid.uuid4().hex}"
        left = retain(_read(spark, edge, schema), created_col, as_of, ttl_minutes)
        left.hint("rebalance", key).write.partitionBy(*partition_of(edge[0])).parquet(root)
        stay += _listing(spark, root, schema.json())
    return _commit(spark, path, base, stay, schema)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the data files under ``path`` that none of the last ``keep`` versions lists; returns them. Version 0's
    files go too once it is older than that: from then on only :func:`read_version` reads the table."""
    now = current_version(spark, path)
    if now < keep:
        return []
    needed = {_plain(f[1]) for v in range(now - keep + 1, now + 1) for f in entries(spark, path, v)}
    at, fs = _fs(spark, path)
    gone, found = [], fs.listFiles(at, True)
    while found.hasNext():
        p = found.next().getPath()
        name = p.toString()
        if name.endswith(".parquet") and f"/{LISTS}/" not in name and _plain(name) not in needed:
            gone.append(name)
            fs.delete(p, False)
    return gone
