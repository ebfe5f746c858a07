"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.session import scratch_path


def _give_back_large_arrays() -> None:
    """Let the C library return freed arrays of 256 kB and more to the system at once. Python
    workers live on between stages; else each keeps the most that any task of it ever used."""
    if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "mallopt"):
        mmap_threshold = -3
        ctypes.CDLL(None).mallopt(mmap_threshold, 256 << 10)


_give_back_large_arrays()

#: Bytes of one Arrow batch handed to Python (one longer row travels alone).
ARROW_BATCH_BYTES = 4 << 20
#: Bytes of text worked on at once inside a Python task (one longer text is worked on alone).
TEXT_SLICE_BYTES = 1 << 20


def text_session(spark: SparkSession) -> None:
    """Runtime settings for Python tasks over text: Arrow batches bounded in bytes, so very
    long texts do not pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage and
    fixes its rows, so lost executors recompute nothing before it. ``narrow`` rows (a few
    numbers each) are written by an eighth of the shuffle partitions, so that small tables do
    not become as many small files."""
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(8, shuffle_partitions(spark) // 8))
    path = scratch_path(spark, name)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_repeat(docs: DataFrame, most: int) -> DataFrame:
    """Adds repeat: a number of the row's own where more than ``most`` rows share its doc_id (or
    have none), else null, which hashes leave out: only often repeated rows depend on the layout."""
    often = stored(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
                       .select(F.col("doc_id").alias("often"), F.lit(True).alias("repeated")), "repeated-ids", narrow=True)
    if often.isEmpty():
        return docs.withColumn("repeat", F.lit(None).cast("long"))
    rows = docs.withColumn("repeat", F.monotonically_increasing_id())
    return rows.join(often, F.col("doc_id").eqNullSafe(F.col("often")), "left").select(
        *docs.columns, F.when(F.col("repeated"), F.col("repeat")).alias("repeat"))


def id_crc(col: Column) -> Column:
    """crc32 of an id's decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def slices(col: pa.Array, limit: int = TEXT_SLICE_BYTES):
    """(start, stop) row ranges of a string array holding about ``limit`` bytes each."""
    n = len(col)
    if n == 0:
        return
    size = np.nan_to_num(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    part = np.cumsum(size) // limit
    cut = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cut.tolist(), n]
    yield from zip(edges[:-1], edges[1:])


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges start..start+length."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = starts - (ends - lengths)
    if total < 2**31 and (not len(starts) or starts.max() < 2**31):
        shift = shift.astype(np.int32)
    out = np.repeat(shift, lengths)
    out += np.arange(total, dtype=out.dtype)
    return out
