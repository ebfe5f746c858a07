"""Exact top-k inner products by pivot-table elimination.

Vectors become integers floor(1024 * x). For ``PIVOTS`` pivots (chosen farthest-first from a
bounded sample) every vector's distances are computed once and stored beside it: the pivot table.
By the triangle inequality d(q, c) >= max over pivots |d(q, p) - d(c, p)|, so the inner product
(|q|^2 + |c|^2 - d^2) / 2 has an upper bound. Candidates are evaluated in the order of their
bounds until the next bound lies below the k-th best score found; that bound starts at the k-th best in the
sample, so most of a batch is never looked at where bounds are tight. Scores are exact integers.

Candidates are dealt into cells by a row number of their own; every query travels to every cell. A task
holds one cell's candidates (``CELL_BYTES``) and streams the queries past them, so no query passes
through the driver; a cell returns at most k rows a query, and none below that query's starting bound.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor
do rows without vec_id; shorter vectors count as padded with zeros, an empty one as zero; rows with the
query's vec_id are its own; a vec_id repeated among queries is one query (its least vector), repeated
candidates count each; ties go to the smaller vec_id; other columns are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsmith.llm.common import shuffle_partitions, stored, table, text_session

SCALE = 1024
PIVOTS = 32
SAMPLE = 2048
#: Bytes of a cell's candidates (vectors and pivot distances), and rows bounded at once inside a task.
CELL_BYTES = 32 << 20
BOUND_ROWS = 4096
K = 10
SEED = 5


def valid_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and the integer vector of the rows that take part."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return df.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & x.isNotNull() & whole).select(
        "vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("vector"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A list column as (rows, dim) integers, padded with zeros."""
    size = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n sample vectors, each the farthest from those before it."""
    if not len(sample):
        return sample
    x = sample.astype(np.float64)
    chosen, far = [0], np.full(len(x), np.inf)
    while len(chosen) < min(n, len(x)):
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(far.argmax()))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to pivots, summed pivot by pivot (no cancellation)."""
    out = np.empty((len(x), len(pivots)))
    x = x.astype(np.float64)
    for i, p in enumerate(pivots.astype(np.float64)):
        out[:, i] = np.sqrt(((x - p) ** 2).sum(axis=1))
    return out


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return x @ q        # 64-bit integers: exact


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows of each query row."""
    spark = vectors.sparkSession
    text_session(spark)
    dim = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    few = vectors.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(SAMPLE).collect()
    sample_ids = np.array([r["vec_id"] for r in few], np.int64)
    sample = np.zeros((len(few), dim), np.int64)
    for i, r in enumerate(few):
        sample[i, :len(r["vector"])] = r["vector"]
    pivots = _spread_out(sample, PIVOTS)

    def measure(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0), "vector": batch.column(1),
                "pivots": pa.array([d.tobytes() for d in _distances(x, pivots)], pa.binary())})

    measured = stored(vectors.mapInArrow(measure, "vec_id long, vector array<long>, pivots binary")
                      .withColumn("row", F.monotonically_increasing_id()), "pivot-table")

    def start(batches):
        """Each query's pivot distances and the k-th best score in the sample (no row below it is wanted)."""
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            least = np.full(len(ids), -2**63)
            for i in range(len(ids)):
                s = _scores(sample[sample_ids != ids[i]], x[i])
                if len(s) >= k:
                    least[i] = np.partition(s, len(s) - k)[len(s) - k]
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0), "vector": batch.column(1),
                "pivots": pa.array([d.tobytes() for d in _distances(x, pivots)], pa.binary()),
                "least": pa.array(least, pa.int64())})

    rows = "vec_id long, vector array<long>, pivots binary, least long"
    queries = stored(measured.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
                     .mapInArrow(start, rows), "queries")
    cells = max(shuffle_partitions(spark), -(-measured.count() * 8 * (dim + PIVOTS) // CELL_BYTES))
    candidates = measured.select(
        F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int").alias("cell"), F.lit(False).alias("asks"),
        "vec_id", "vector", "pivots", F.lit(None).cast("long").alias("least"))
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(True).alias("asks"),
        "vec_id", "vector", "pivots", "least")
    out = (candidates.unionByName(asked).repartitionById(cells, "cell").sortWithinPartitions("cell", "asks")
           .mapInArrow(_searcher(k, dim), "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _searcher(k: int, dim: int):
    """The task over rows sorted by cell, a cell's candidates before its queries."""

    def run(batches):
        cell, held, ready = None, [], None
        for batch in batches:
            cells, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(cells) != 0) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip(chain([0], cut.tolist()), chain(cut.tolist(), [len(cells)])):
                if a == b:
                    continue
                if cells[a] != cell:
                    cell, held, ready = cells[a], [], None
                part = batch.slice(a, b - a)
                names, x = part.column(2).to_numpy(), _matrix(part.column(3), dim)
                far = np.frombuffer(b"".join(part.column(4).to_pylist()), np.float64).reshape(len(names), -1)
                if not asks[a]:
                    held.append((names.copy(), x.copy(), far))
                elif held:
                    if ready is None:
                        ready = _Cell(*(np.concatenate(c) for c in zip(*held)))
                        held = [()]
                    yield from ready.answer(names, x, far, part.column(5).to_numpy(), k)

    return run


class _Cell:
    """A cell's candidates, with their squared lengths."""

    def __init__(self, names: np.ndarray, x: np.ndarray, far: np.ndarray):
        self.names, self.x, self.far = names, x, far
        self.own = np.concatenate([(x[i:i + BOUND_ROWS].astype(np.float64) ** 2).sum(axis=1)
                                   for i in range(0, len(x), BOUND_ROWS)])

    def answer(self, ids, x, far, least, k):
        """Each query's k best candidates that reach its starting bound."""
        found = [self._best(ids[i], x[i], far[i], int(least[i]), k) for i in range(len(ids))]
        n = [len(s) for s, _ in found]
        if sum(n):
            yield pa.RecordBatch.from_pydict({
                "query_id": pa.array(np.repeat(ids, n), pa.int64()),
                "vec_id": pa.array(np.concatenate([v for _, v in found]), pa.int64()),
                "score": pa.array(np.concatenate([s for s, _ in found]), pa.int64())})

    def _best(self, name, q, q_far, least, k):
        square = (q.astype(np.float64) ** 2).sum()
        ats, bounds = [], []
        for i in range(0, len(self.names), BOUND_ROWS):
            low = np.abs(self.far[i:i + BOUND_ROWS] - q_far).max(axis=1)
            both = square + self.own[i:i + BOUND_ROWS]
            bound = (both - low * low) / 2 + 1e-9 * both + 1         # the last two: what rounding may have taken
            at = np.flatnonzero((bound >= least) & (self.names[i:i + BOUND_ROWS] != name))
            ats.append(at + i)
            bounds.append(bound[at])
        at, bound = np.concatenate(ats), np.concatenate(bounds)
        order = np.argsort(-bound, kind="stable")
        at, bound = at[order], bound[order]
        scores, names = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done, step = 0, 256
        while done < len(at) and bound[done] >= least:
            pick = at[done:done + step]
            more = _scores(self.x[pick], q)
            scores, names = np.concatenate([scores, more]), np.concatenate([names, self.names[pick]])
            top = np.lexsort((names, -scores))[:k]
            scores, names = scores[top], names[top]
            if len(top) == k:
                least = max(least, int(scores[-1]))
            done, step = done + step, step * 2
        reach = scores >= least
        return scores[reach], names[reach]


def q_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the 10 best rows for every vector whose vec_id is divisible by 100."""
    return search(valid_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
