"""Session helpers: one place for the settings every job in this library assumes."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# HotSpot does not JIT-compile methods above 8,000 bytes of bytecode. A whole-stage
# method that large runs interpreted (several times slower); with this limit Spark
# falls back to per-operator code whose expressions are split into small methods.
JIT_METHOD_LIMIT = 8000

_LOCAL_ROOT: list[str] = []     # one scratch folder per local process
_SHIPPED: set[str] = set()      # applications that have the package


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "rowsmith") -> SparkSession:
    """Build (or reuse) a session with AQE on, the UI off and UTC as session zone.

    On a cluster ``master`` stays None so the launcher decides; tests pass ``local[*]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.sql.codegen.hugeMethodLimit", str(JIT_METHOD_LIMIT)))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Unset is allowed only with a local master (tests), where a fresh folder under the
    system temp dir is used for the whole session; a cluster without it fails loudly,
    since executors there would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    try:
        master = spark.sparkContext.master
    except Exception:  # noqa: BLE001 - a session without a SparkContext (Spark Connect)
        master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master or ""):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="rowsmith-scratch-"))
    return _LOCAL_ROOT[0]


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Set the context's checkpoint folder from :func:`checkpoint_root` if none is set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_root(spark))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint root for written tables."""
    return f"{checkpoint_root(spark)}/rowsmith-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: its rows are fixed, and
    lost executors recompute nothing that came before it."""
    path = scratch_path(df.sparkSession, name)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give every executor this package, so Python tasks work from any directory."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = tempfile.mkdtemp(prefix="rowsmith-zip-")
    sc.addPyFile(shutil.make_archive(os.path.join(out, "rowsmith"), "zip", home, "rowsmith"))
    _SHIPPED.add(sc.applicationId)
