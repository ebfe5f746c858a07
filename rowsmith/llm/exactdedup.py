"""Exact duplicate removal by two-pass Bloom filtering.

The first pass over the texts finds which 64-bit hashes may occur twice
(:mod:`rowsmith.llm.bloom`). In the second, rows whose hash does not pass straight through
unshuffled; only the possibly repeated rows are written, shuffled and grouped by the SHA-256
of their text. Groups are aggregated before the join back, so a text that a third of all rows share is
one row on its side of the join and splittable on the other.

Defined results: null counts as empty text; of equal texts the row with the largest doc_id
stays (null lowest; of rows that share it, one); every column, whatever its name, is carried
through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm import bloom
from rowsmith.llm.common import documents, stored, text_session


def _text(row: str):
    return F.coalesce(F.col(f"{row}.text"), F.lit(""))


def annotate(docs: DataFrame) -> DataFrame:
    """Every row as ``doc`` (a struct of all its columns) with keep_id, group_size, kept and text_sha256."""
    text_session(docs.sparkSession)
    rows = docs.count()
    n = bloom.slice_count(rows)
    bits = bloom.filter_bits(-(-rows // n))
    wide = docs.select(F.struct("*").alias("doc")).withColumn("hash", F.xxhash64(_text("doc")))
    if n > 1:      # one pass writes the slices, each is then read alone
        wide = stored(wide.withColumn("slice", F.pmod(F.shiftright("hash", 32), F.lit(n)).cast("int")),
                      "dedup-slices", ["slice"])
    out = None
    for i in range(n):
        part = wide.filter(F.col("slice") == i).drop("slice") if n > 1 else wide
        plane = bloom.repeated_plane(part, "hash", bits)
        marked = part.withColumn("maybe", bloom.in_plane(plane, F.col("hash"), part))
        sha = F.sha2(_text("doc").cast("binary"), 256)
        alone = marked.filter(~F.col("maybe")).select(
            "doc", F.col("doc.doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"), sha.alias("text_sha256"))
        again = stored(marked.filter("maybe").select("doc", sha.alias("text_sha256"),
                                                     F.monotonically_increasing_id().alias("row")), "dedup-repeated")
        # written, so that both sides of the join are plain shuffles and AQE can split a hot text
        groups = stored(again.groupBy("text_sha256").agg(
            F.count(F.lit(1)).alias("group_size"),
            F.max(F.struct(F.col("doc.doc_id").alias("doc_id"), "row")).alias("best")), "dedup-groups")
        shared = again.join(groups, "text_sha256").select(
            "doc", F.col("best.doc_id").alias("keep_id"), "group_size",
            (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")
        both = alone.unionByName(shared)
        out = both if out is None else out.unionByName(both)
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    return annotate(docs).filter("kept").select("doc.*")


def q_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document with the row that stays for its text."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return annotate(docs).select(F.col("doc.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
