"""Near-duplicate documents by HyperMinHash, banding and exact confirmation.

1. Every whole text becomes its set of word shingles and 128 HyperMinHash registers. Rows
   with equal sets form a class; classes are compared, copies are not.
2. 32 bands of 4 registers are hashed; classes sharing a band hash are in one bucket. A pair at
   similarity 0.8 shares no band with probability (1 - 0.8**4)**32 = 5e-8. Buckets with the same
   members are taken once.
3. First each bucket's least class is paired with its other members: linear in the bucket.
   Pairs whose estimated similarity (corrected for register collisions) is not ``MARGIN`` below the
   threshold (five standard errors) are confirmed on full sets; links give components.
4. Only buckets whose members lie in several components go on. Members are compared there by
   registers in memory-bounded cells, across components and without emitting pairs: a first pass
   keeps the members that have a possible partner, a second one gets their full sets and confirms
   the possible pairs, most similar first, leaving out those that the cell has joined meanwhile. What
   leaves a cell are links between components, fewer than its members. So no linked pair that shares a band
   is lost unless its ends are joined already, and no group emits its pairs.

Sets are recomputed for classes in candidate pairs only, found with a Bloom filter of their
documents in the scan, so the other texts are never shuffled. Defined results: null text and
text without words have the empty set and are linked with nothing; null doc_ids are rows of
their own, named last; repeated rows are one class; an empty table gives an empty result; other
columns are carried (``dedup``) or not read (``groups``), whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm import bloom, hyperminhash as hmh, wordhash
from rowsmith.llm.common import documents, slices, stored, text_session
from rowsmith.llm.components import components

BANDS = 32
BAND_REGISTERS = hmh.REGISTERS // BANDS
#: Five standard errors of the estimate at similarity 0.8: sqrt(0.8 * 0.2 / 128) * 5.
MARGIN = 0.18
#: Classes of one bucket compared in one task; larger buckets are cut into cells of two blocks.
CELL = 768


@dataclass(frozen=True)
class Threshold:
    """Similarity of at least per_cent / 100, on sets of shingles of ``width`` words."""
    width: int = 5
    per_cent: int = 80

    def may_reach(self, small, large):
        """Whether sets of these sizes can reach it."""
        return 100 * small >= self.per_cent * large


def _text_key(col="text"):
    return F.xxhash64(F.coalesce(F.col(col), F.lit("")))


def _sets(docs: DataFrame, width: int, full: bool, plane: np.ndarray | None = None) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles, set_id (128 bits) and the registers, or the whole set;
    with a filter plane only of rows whose doc_id is in it (looked up here, so that a task needs one
    Python worker)."""
    shared = None if plane is None else docs.sparkSession.sparkContext.broadcast(plane)
    text_session(docs.sparkSession)
    out = "doc_id long, text_key long, n_shingles long, set_id binary, " + ("members" if full else "regs") + " binary"

    def scan(batches):
        for batch in batches:
            if shared is not None:
                batch = batch.filter(pa.array(bloom.lookup(shared.value, batch.column(3).to_numpy())))
            for i, j in slices(batch.column(2)):
                values, edges = wordhash.shingles(*wordhash.words(batch.column(2).slice(i, j - i)), width)
                n = np.diff(edges)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(wordhash.mix(values + np.uint64(salt)), dtype=np.uint64)])
                        for salt in (1, 0x5851F42D4C957F2D)]
                ids = np.stack([s[edges[1:]] - s[edges[:-1]] for s in sums], axis=1)
                if full:
                    last = [values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
                else:
                    last = [r.tobytes() for r in hmh.registers(values, edges)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(i, j - i), "text_key": batch.column(1).slice(i, j - i),
                    "n_shingles": pa.array(n, pa.int64()), "set_id": pa.array([x.tobytes() for x in ids], pa.binary()),
                    "members" if full else "regs": pa.array(last, pa.binary())})

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id, _text_key(), "text", F.xxhash64(doc_id)).mapInArrow(scan, out)


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, band, cls, least) of all buckets with several classes; of buckets with equal
    members the one of the first band."""
    size = 2 * BAND_REGISTERS
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("regs", b * size + 1, size)) for b in range(BANDS)])
    rows = classes.select("cls", F.posexplode(keys).alias("band", "bucket"))
    found = rows.groupBy("bucket", "band").agg(
        F.count(F.lit(1)).alias("n"), F.min("cls").alias("least"),
        F.sum(F.xxhash64(F.lit(5), "cls").cast("decimal(20,0)")).alias("sum1"),
        F.bit_xor(F.xxhash64(F.lit(6), "cls")).alias("sum2")).filter("n > 1")
    once = found.groupBy("n", "least", "sum1", "sum2").agg(F.min(F.struct("band", "bucket")).alias("first"))
    once = once.select("first.bucket", "first.band", "least")
    return stored(rows.join(once, ["bucket", "band"]), "buckets")


def _estimated(pairs: DataFrame, classes: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs (a < b) whose estimate does not rule them out."""
    c = classes.select("cls", "n_shingles", "regs")
    j = (pairs.join(c.toDF("a", "na", "ra"), "a").join(c.toDF("b", "nb", "rb"), "b")
              .filter(100 * F.least("na", "nb") >= limit.per_cent * F.greatest("na", "nb")))
    least = limit.per_cent / 100 - MARGIN

    def look(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, hmh.REGISTERS)
                      for k in (4, 5))
            keep = hmh.estimate((ra == rb).sum(axis=1), batch.column(2).to_numpy(), batch.column(3).to_numpy()) >= least
            yield batch.select([0, 1]).filter(pa.array(keep))

    return j.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(look, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, limit: Threshold) -> bool:
    """Whether two sorted sets reach the similarity."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= limit.per_cent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs that are linked, by their full sets."""
    s = sets.select("cls", "members")
    j = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def check(batches):
        for batch in batches:
            keep = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), limit)
                    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return j.mapInArrow(check, "a long, b long")


def _mixed(members: DataFrame) -> DataFrame:
    """The members (bucket, band, cls, comp) of buckets with several components, with the bucket's size,
    its least component (major) and the number of members outside it (minors)."""
    parts = members.groupBy("bucket", "band", "comp").agg(F.count(F.lit(1)).alias("n"))
    found = parts.groupBy("bucket", "band").agg(F.min(F.struct("comp", "n")).alias("least"), F.max("comp").alias("other"),
                                        F.sum("n").alias("size")).filter("least.comp <> other")
    found = found.select("bucket", "band", F.col("least.comp").alias("major"), "size", (F.col("size") - F.col("least.n")).alias("minors"))
    return stored(members.select("bucket", "band", "cls", "comp").join(found, ["bucket", "band"]), "mixed-buckets", narrow=True)


def _possible(regs: np.ndarray, n: np.ndarray, comp: np.ndarray, band: int, limit: Threshold):
    """(row, column, estimate) of the pairs of a cell that may be linked, each once: other
    components, sizes and estimate near enough, and ``band`` the first one that they share. A pair's row is
    of the greater component, so members of the cell's least component, often nearly all, are columns only."""
    step, least = max(1, (8 << 20) // max(1, regs.nbytes)), limit.per_cent / 100 - MARGIN
    rows = np.flatnonzero(comp > comp.min())
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a in range(0, len(rows), step):
        part = rows[a:a + step]
        agree = (regs[part, None, :] == regs[None, :, :]).sum(axis=2, dtype=np.int32)
        mine, other = np.broadcast_to(n[part, None], agree.shape), np.broadcast_to(n, agree.shape)
        near = hmh.estimate(agree, mine, other)
        row, col = np.nonzero((near >= least) & (comp[part, None] > comp[None, :])
                              & limit.may_reach(np.minimum(mine, other), np.maximum(mine, other)))
        same = (regs[part[row]] == regs[col]).reshape(-1, BANDS, BAND_REGISTERS).all(axis=2)
        first = same.argmax(axis=1) == band
        out.append((part[row[first]], col[first], near[row, col][first]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _views(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The values of a binary column as number arrays over Arrow's own memory."""
    out = []
    for part in column.chunks:
        width = np.int64 if pa.types.is_large_binary(part.type) else np.int32
        at = np.frombuffer(part.buffers()[1], width, len(part) + 1, part.offset * np.dtype(width).itemsize).tolist()
        size = np.dtype(kind).itemsize
        out += [np.frombuffer(part.buffers()[2], kind, (b - a) // size, a) for a, b in zip(at[:-1], at[1:])]
    return out


def _crossing(mixed: DataFrame, classes: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """(a, b, comp_a, comp_b): links across components, enough to join all that the buckets link.

    Members outside the bucket's major component are the minor ones. A large bucket is cut into
    blocks, and cells hold two blocks, minor with major or minor with minor; so a bucket that is nearly
    one component costs its size, whatever that is. A pair is looked at in the bucket of the
    first band that it shares only.
    """
    m = mixed.withColumn("minor", F.col("comp") != F.col("major"))
    half = CELL // 2
    blocks = F.when(F.col("size") <= CELL, 1).otherwise(F.ceil(F.col("minors") / half)).cast("int")
    majors = F.when(F.col("size") <= CELL, 1).otherwise(
        F.greatest(F.lit(1), F.ceil((F.col("size") - F.col("minors")) / half))).cast("int")
    m = m.withColumn("mb", blocks).withColumn("jb", majors)
    own = F.when(F.col("minor"), F.pmod(F.xxhash64("cls"), F.col("mb"))).otherwise(
        F.pmod(F.xxhash64("cls"), F.col("jb"))).cast("int")
    m = m.withColumn("own", own)
    others = F.sequence(F.lit(0), F.col("mb") - 1)
    major_cells = F.sequence(F.lit(0), F.col("jb") - 1)
    with_major = F.when(F.col("minor"), F.transform(major_cells, lambda j: F.struct(F.col("own").alias("i"), (-1 - j).alias("j")))) \
        .otherwise(F.transform(others, lambda i: F.struct(i.alias("i"), (-1 - F.col("own")).alias("j"))))
    with_minor = F.when(F.col("minor"), F.transform(others, lambda i: F.struct(
        F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j")))).otherwise(
        F.array().cast("array<struct<i:int,j:int>>"))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    cells = F.when(F.col("size") <= CELL, one).otherwise(F.concat(with_major, with_minor))
    rows = m.select("bucket", "band", "cls", "comp", F.explode(cells).alias("cell"))
    rows = rows.join(classes.select("cls", "n_shingles", "regs"), "cls").select(
        "bucket", "band", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "cls", "comp", "n_shingles", "regs")
    cell = ["bucket", "band", "i", "j"]

    def arrays(t: pa.Table):
        return (t["cls"].to_numpy(), t["comp"].to_numpy(), t["n_shingles"].to_numpy(), t["band"][0].as_py(),
                np.stack(_views(t["regs"], np.uint16)))

    def hopeful(t: pa.Table) -> pa.Table:
        """The members that have a possible partner."""
        _, comp, n, band, regs = arrays(t)
        row, col, _ = _possible(regs, n, comp, band, limit)
        return t.take(pa.array(np.unique(np.concatenate([row, col]))))

    def links(t: pa.Table) -> pa.Table:
        """Confirmed pairs that join components of the cell."""
        cls, comp, n, band, regs = arrays(t)
        full = _views(t["members"], np.uint64)
        row, col, near = _possible(regs, n, comp, band, limit)
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        found = []
        for k in np.lexsort((cls[col], cls[row], -near)).tolist():
            a, b = int(row[k]), int(col[k])
            x, y = find(int(comp[a])), find(int(comp[b]))
            if x != y and _linked(full[a], full[b], limit):
                root[max(x, y)] = min(x, y)
                found.append((int(cls[a]), int(cls[b]), int(comp[a]), int(comp[b])))
        columns = list(zip(*found)) or [[], [], [], []]
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("a", "b", "comp_a", "comp_b"), columns)})

    some = rows.groupBy(*cell).applyInArrow(hopeful, rows.schema)
    some = some.join(sets.select("cls", "members"), "cls")
    return some.groupBy(*cell).applyInArrow(links, "a long, b long, comp_a long, comp_b long")


def _all_labels(labels: DataFrame, fresh: DataFrame) -> DataFrame:
    """Labels with the classes that had no link before."""
    both = fresh.select(F.col("a").alias("node"), F.col("comp_a").alias("component")).unionAll(
        fresh.select(F.col("b").alias("node"), F.col("comp_b").alias("component"))).distinct()
    return labels.unionByName(both.join(labels.select("node"), "node", "left_anti"))


def _renamed(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows with their ``component`` under its new name."""
    return rows.join(merged, rows["component"] == merged["old"], "left").withColumn(
        "component", F.coalesce("new", "component")).drop("old", "new")


def _analyse(docs: DataFrame, limit: Threshold) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, n_shingles, row, cls and comp (both null for empty sets)."""
    rows = stored(_sets(docs, limit.width, False).withColumn("row", F.monotonically_increasing_id()), "sets")
    by_set = rows.filter("n_shingles > 0").groupBy("set_id", "n_shingles").agg(
        F.min("row").alias("cls"), F.min(F.struct("doc_id", "text_key")).alias("sample"), F.first("regs").alias("regs"))
    classes = stored(by_set, "classes")
    buckets = _buckets(classes)

    star = buckets.filter("cls <> least").select(F.col("least").alias("a"), F.col("cls").alias("b")).distinct()
    # dealt anew for the write (AQE merges small parts), so that estimates and cells run in all tasks
    todo = stored(_estimated(star, classes, limit).hint("rebalance"), "pairs")
    # every class that any later round can pair has a partner in some bucket
    sample = classes.join(buckets.select("cls"), "cls", "left_semi").select(
        "cls", "set_id", F.xxhash64("sample.doc_id").alias("id_hash"))
    sample = stored(sample, "candidates", narrow=True)
    plane = bloom.member_plane(sample, "id_hash", sample.count())
    sets = stored(_sets(docs, limit.width, True, plane).join(sample.select("cls", "set_id"), "set_id")
                  .dropDuplicates(["cls"]).select("cls", "members"), "members")

    links = _confirmed(todo, sets, limit)
    labels = components(links)
    members = buckets.join(labels, buckets["cls"] == labels["node"], "left").select(
        "bucket", "band", "cls", F.coalesce("component", "cls").alias("comp"))
    fresh = stored(_crossing(_mixed(members), classes, sets, limit).hint("rebalance"), "links-found")
    # components that the new links join, as old name -> new name
    merged = components(fresh.select(F.least("comp_a", "comp_b").alias("a"), F.greatest("comp_a", "comp_b").alias("b")))
    labels = stored(_renamed(_all_labels(labels, fresh), merged.toDF("old", "new")), "components", narrow=True)
    named = classes.join(labels, classes["cls"] == labels["node"], "left").select(
        "set_id", "cls", F.coalesce("component", "cls").alias("comp"))
    return rows.drop("regs").join(named, "set_id", "left").withColumn(
        "comp", F.when(F.col("n_shingles") > 0, F.col("comp")))


def groups(docs: DataFrame, limit: Threshold = Threshold()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id of the component; its own for an
    empty set) and kept (doc_id = component_id)."""
    rows = stored(_analyse(docs, limit).hint("rebalance"), "near-rows")
    # aggregates are written before joins back, so that AQE can split a component with very many rows
    least = stored(rows.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "near-least", narrow=True)
    out = rows.join(least, "comp", "left")
    named = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", named.alias("component_id"), F.col("doc_id").eqNullSafe(named).alias("kept"))


def dedup(docs: DataFrame, limit: Threshold = Threshold()) -> DataFrame:
    """The columns of ``docs`` without near-duplicates: of each component the row of the least doc_id stays,
    and every row without words. Rows whose key is in a Bloom filter of the dropped ones are
    shuffled to be told apart; all other rows pass straight through."""
    rows = stored(_analyse(docs, limit), "near-rows")
    best = stored(rows.filter("comp is not null").groupBy("comp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("best")), "near-best", narrow=True)
    lost = rows.join(best, "comp").filter("row <> best.row").select(
        F.xxhash64("doc_id", "text_key").alias("key")).distinct()
    twins = rows.join(best, "comp").filter("row = best.row").select(
        F.xxhash64("doc_id", "text_key").alias("key"), F.lit(True).alias("twin"))
    # a kept row with identical rows beside it shares their key: of such rows one stays
    lost = stored(lost.join(twins, "key", "left").select("key", F.coalesce("twin", F.lit(False)).alias("twin")), "dropped")
    plane = bloom.member_plane(lost, "key", lost.count())
    wide = docs.select(F.struct("*").alias("doc")).withColumn(
        "key", F.xxhash64(F.col("doc.doc_id").cast("long"), _text_key("doc.text")))
    wide = wide.withColumn("hit", bloom.in_plane(plane, F.col("key"), docs))
    through = wide.filter("not hit").select("doc")
    told = stored(wide.filter("hit").drop("hit").join(lost, "key", "left"), "near-told")
    return (through.unionByName(told.filter("twin is null").select("doc"))
                   .unionByName(told.filter("twin").dropDuplicates(["key"]).select("doc")).select("doc.*"))


def q_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document's component at 80 % similarity of its 4-word shingles."""
    return groups(documents(spark, sf_dir), Threshold(width=4))
