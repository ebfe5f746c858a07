"""Packing of documents into sequences: first-fit decreasing in randomised groups.

Documents become token ids (whole texts, end id behind). A document longer than a sequence
is cut: its full-length pieces are sequences of their own, only the rest is packed. Pieces
are dealt at random, by a seeded hash, to groups of about ``GROUP_DOCS`` documents (rows whose
doc_id more rows than that share are dealt by a row number, too, so copies spread); inside a group first-fit decreasing puts each piece, longest first, into the first sequence with room,
found by descending a tournament tree over the sequences' free room in O(log n). Groups are
independent, so the work spreads over the cluster and a group's memory is bounded.

Defined results: null text is empty and has just the end id; equal lengths are ordered by
doc_id, start and crc; repeated rows are packed each; an empty table gives no pieces; columns other
than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm.common import shuffle_partitions, slices, text_session, with_repeat
from rowsmith.llm.tokens import SLICE_BYTES, crc_of, encoder, tokenizer_path

END_ID = 2
SEQUENCE = 4096
#: Documents in a group, on average. A group's pieces are a few integers each.
GROUP_DOCS = 8192
SEED = 20240607

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = SEQUENCE,
           with_ids: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece of every document; pieces are at most ``capacity`` ids long. ``carried``
    names columns of type long that pieces keep."""
    text_session(docs.sparkSession)
    tokenizer = tokenizer or tokenizer_path()
    schema = PIECES + "".join(f", {c} long" for c in carried) + (", ids array<int>" if with_ids else "")

    def cut(batches):
        enc = encoder(tokenizer, end_id)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for i, j in slices(texts, SLICE_BYTES):
                ids, offsets = enc.encode(texts.slice(i, j - i))
                size = np.diff(offsets)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(j - i), n)
                nth = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
                begin = nth * capacity
                length = np.minimum(capacity, size[doc] - begin)
                at = offsets[doc] + begin
                cols = {
                    "doc_id": names.slice(i, j - i).take(pa.array(doc)), "start": pa.array(begin, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array([crc_of(ids[a:a + k]) for a, k in zip(at, length)], pa.int64()),
                    "doc_tokens": pa.array(size[doc], pa.int64())}
                for k, c in enumerate(carried, 2):
                    cols[c] = batch.column(k).slice(i, j - i).take(pa.array(doc))
                if with_ids:     # the pieces of a slice lie one behind the other
                    cols["ids"] = pa.ListArray.from_arrays(
                        pa.array(np.concatenate([at, offsets[-1:]]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(cols)

    return docs.select(F.col("doc_id").cast("long"), "text", *carried).mapInArrow(cut, schema)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; ``lengths`` must be in descending order.

    The tree's leaves hold each sequence's free room and an inner node the larger of its
    two; going left wherever the left subtree has room finds the first sequence that fits.
    """
    n = len(lengths)
    leaves = 1
    while leaves < n:
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, size in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = SEQUENCE,
         group_docs: int = GROUP_DOCS, seed: int = SEED, with_ids: bool = False) -> DataFrame:
    """All pieces with their sequence_id and offset in it (and their ids if asked for).
    Sequence ids are unique over all groups: group number times 2**32 plus the group's."""
    spark = docs.sparkSession
    groups = max(1, -(-docs.count() // group_docs))
    numbered = with_repeat(docs.select("doc_id", "text"), group_docs)
    cut = pieces(numbered, tokenizer, end_id, capacity, with_ids, ("repeat",))
    grouped = cut.withColumn("pack_group", F.pmod(
        F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "repeat"), F.lit(groups))).drop("repeat")
    schema = grouped.schema.add("sequence_id", "long").add("offset", "long")

    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"),
                       ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(t["length"].to_numpy(), capacity)
        group = t["pack_group"].to_numpy()
        return (t.append_column("sequence_id", pa.array(group * 2**32 + bins, pa.int64()))
                 .append_column("offset", pa.array(offsets, pa.int64())))

    n = min(groups, shuffle_partitions(spark))
    return (grouped.repartition(n, "pack_group").groupBy("pack_group")
                   .applyInArrow(place, schema).drop("pack_group"))


def q_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents packed into sequences of at most 4096 ids."""
    from rowsmith.llm.common import documents
    return pack(documents(spark, sf_dir))
