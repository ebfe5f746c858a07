"""Token ids of documents in compressed binary files (patched frame-of-reference blocks).

``write_ids`` tokenises whole texts and writes files in ascending ``doc_id`` order;
``read_ids`` decodes them. A file is a self-contained image in the format of
:mod:`rowsmith.llm.pfor`, stored as one row of a Parquet table: Spark's committer then
makes every file appear once however often a task is retried, on any file system that
Spark writes. Rows carry the file's place (range partition, number in it, ids before it in
the partition), so neither a task nor the driver ever holds an index of all files.

Defined results: null text is empty and has just the end id; a null ``doc_id`` sorts first;
rows sharing a ``doc_id`` all stay, ordered by a hash of their text; a text of any length is
one document, so a file is as large as its longest document or ``FILE_IDS``; an empty table
gives an empty file table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsmith.llm import pfor
from rowsmith.llm.common import shuffle_partitions, slices, text_session
from rowsmith.llm.tokens import SLICE_BYTES, crc_of, encoder, tokenizer_path
from rowsmith.session import scratch_path

END_ID = 2
#: Ids after which a file is closed.
FILE_IDS = 1 << 18

FILES = "part int, seq long, start_in_part long, n_tokens long, image binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
              partitions: int | None = None) -> None:
    """Write all documents' ids to file images under ``path``, in ascending doc_id order."""
    spark = docs.sparkSession
    text_session(spark)
    tokenizer = tokenizer or tokenizer_path()

    def write(batches):
        from pyspark import TaskContext
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer, end_id)
        seq = before = held = 0
        doc_ids, counts, chunks = [], [], []

        def flush():
            nonlocal seq, before, held, doc_ids, counts, chunks
            ids = np.concatenate(chunks) if chunks else np.zeros(0, np.uint32)
            image = pfor.encode(doc_ids, np.array(counts, np.int64), ids)
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int64()),
                "start_in_part": pa.array([before], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()),
                "image": pa.array([image], pa.binary())})
            seq, before, held = seq + 1, before + len(ids), 0
            doc_ids, counts, chunks = [], [], []
            return row

        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for i, j in slices(texts, SLICE_BYTES):
                ids, offsets = enc.encode(texts.slice(i, j - i))
                for k, name in enumerate(names.slice(i, j - i).to_pylist()):
                    doc_ids.append(name)
                    counts.append(int(offsets[k + 1] - offsets[k]))
                    chunks.append(ids[offsets[k]:offsets[k + 1]])
                    held += counts[-1]
                    if held >= FILE_IDS:
                        yield flush()
        if doc_ids:
            yield flush()

    n = partitions or shuffle_partitions(spark)
    (docs.select("doc_id", "text")
         .repartitionByRange(n, "doc_id", F.xxhash64("text"))
         .sortWithinPartitions("doc_id", F.xxhash64("text"))
         .mapInArrow(write, FILES).write.parquet(path))


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the files under ``path``: doc_id, start (ids before the document over all
    files), n_tokens, ids_crc32 and, if asked for, the ids themselves."""
    text_session(spark)
    files = spark.read.schema(FILES).parquet(path)
    bases = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        F.col("part").alias("base_part"),
        F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("base"))
    out = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def read(batches):
        for batch in batches:
            for part, before, image in zip(*(batch.column(i).to_pylist() for i in range(3))):
                doc_ids, counts, ids = pfor.decode(image)
                ends = np.cumsum(counts)
                begin = ends - counts
                cols = {
                    "part": pa.array([part] * len(doc_ids), pa.int32()), "doc_id": pa.array(doc_ids, pa.int64()),
                    "start": pa.array(before + begin, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array([crc_of(ids[a:b]) for a, b in zip(begin, ends)], pa.int64())}
                if with_ids:
                    cols["ids"] = pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(cols)

    rows = files.select("part", "start_in_part", "image").mapInArrow(read, out)
    # one row for each range partition: as many as this job's shuffle partitions
    rows = rows.join(F.broadcast(bases), rows["part"] == bases["base_part"])
    return rows.withColumn("start", F.col("start") + F.col("base")).drop("part", "base_part", "base")


def q_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document's ids written to files and read back."""
    from rowsmith.llm.common import documents
    path = scratch_path(spark, "token-files")
    write_ids(documents(spark, sf_dir), path)
    return read_ids(spark, path)
