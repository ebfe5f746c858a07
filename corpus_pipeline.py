"""The corpus pipeline: from raw documents to packed training sequences.

``STAGES`` are applied in order; each is written as Parquet and read again as the next one's
documents. Every stage but the last returns the columns of its input:

* ``language_id`` drops documents whose language can't be told (no letters, or no resemblance to
  any language profile);
* ``exact_dedup`` keeps, of equal texts, the row with the largest doc_id;
* ``near_dedup`` keeps, of each group of near-duplicates (five-word shingles, similarity 0.8),
  the row with the smallest doc_id;
* ``mixing`` drops or repeats documents so that sources come near their target weights, in the
  order of training;
* ``packing`` returns the pieces of sequences of at most 4096 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowsmith.llm import exactdedup, langid, mixing, neardedup, packing
from rowsmith.llm.common import documents, stored

NEAR = neardedup.Threshold(width=5, per_cent=80)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdedup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardedup.dedup(docs, NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("mixing", mix), ("packing", pack)]

#: The language profiles, the near-duplicate closure and the packing cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, f"pipeline-{name}")
    return docs
