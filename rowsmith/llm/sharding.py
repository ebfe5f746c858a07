"""Sharding over fixed virtual slots with a versioned slot-to-shard map (law: near-equal bytes).

Records are hashed by their text into ``SLOTS`` slots, so equal texts share a slot and copies
of a text lie in one shard. Bytes and rows are summed per slot and per cell (slot, part and one
of ``CELLS`` doc_id hashes): a constant number of sums. The map starts with slots dealt in turn;
rebalancing edits it by single moves from the fullest shard to the emptiest until no move helps,
and every state is stored with its version. A slot heavier than a shard's share is cut into
parts by another hash of the text, so copies still lie together; only a text that is itself
heavier than a share (one that very many rows share) is cut by doc_id, and its cells as finely as its rows need. Growing moves parts to the
new shard only. A row's place in its shard is its cell's offset plus its rank in the cell, so
ranking needs no task per shard.

Defined results: null text has no bytes (size 1, crc32 of nothing); null doc_ids rank first; repeated
rows take a place each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsmith.llm.common import documents, stored, with_repeat
from rowsmith.session import scratch_path

SLOTS = 4096
CELLS = 64
SHARDS = 16
#: A hot text's cells are cut again, into up to FINE cells of about CELL_ROWS rows each.
FINE = 1 << 14
CELL_ROWS = 1 << 18
#: Rows that may share a doc_id before a row number, too, spreads them over cells.
REPEATS = 8192


@dataclass
class SlotMap:
    """Part sizes and their shards; ``history`` holds the moves of each version. ``parts`` holds
    the number of text parts of each cut slot, ``hot`` the hashes of the texts cut by doc_id:
    the n-th one's parts start at n * CELLS, counted from 1."""
    sizes: dict[tuple[int, int], int]
    parts: dict[int, int]
    shards: int
    hot: list[int] = field(default_factory=list)
    owner: dict[tuple[int, int], int] = field(default_factory=dict)
    history: list[list[tuple[int, int, int]]] = field(default_factory=list)

    def __post_init__(self):
        moves = [(s, p, (s + p) % self.shards) for s, p in sorted(self.sizes)]
        self._apply(moves)

    def _apply(self, moves: list[tuple[int, int, int]]) -> None:
        for s, p, shard in moves:
            self.owner[s, p] = shard
        self.history.append(moves)

    def _held(self) -> list[list[tuple[int, int, int]]]:
        held = [[] for _ in range(self.shards)]
        for (s, p), shard in self.owner.items():
            held[shard].append((self.sizes[s, p], s, p))
        return held

    def rebalance(self, limit: int = 4 * SLOTS) -> None:
        """One new version: moves from the fullest shard to the emptiest, each of the part
        nearest to half their difference, while that brings them closer."""
        held = [sorted(x) for x in self._held()]
        load = [sum(b for b, *_ in x) for x in held]
        moves = []
        while len(moves) < limit:
            a, b = max(range(self.shards), key=load.__getitem__), min(range(self.shards), key=load.__getitem__)
            gap = load[a] - load[b]
            fit = [x for x in held[a] if 0 < x[0] < gap]
            if not fit:
                break
            part = min(fit, key=lambda x: (abs(2 * x[0] - gap), x))
            held[a].remove(part)
            held[b].append(part)
            load[a], load[b] = load[a] - part[0], load[b] + part[0]
            moves.append((part[1], part[2], b))
        self._apply(moves)

    def grow(self) -> None:
        """One new version with one more shard, which takes parts from the fullest ones."""
        held = self._held()
        self.shards += 1
        share = sum(self.sizes.values()) / self.shards
        heap = [(-sum(b for b, *_ in x), i, sorted(x)) for i, x in enumerate(held)]
        heapq.heapify(heap)
        got, moves = 0, []
        while heap and got < share:
            load, i, own = heapq.heappop(heap)
            fit = [x for x in own if x[0] <= min(share - got, -load - share)]
            if not fit:
                continue
            part = fit[-1]
            own.remove(part)
            got += part[0]
            moves.append((part[1], part[2], self.shards - 1))
            heapq.heappush(heap, (load + part[0], i, own))
        self._apply(moves)

    def _hot_text(self, part: int) -> int | None:
        return self.hot[part // CELLS - 1] if part >= CELLS else None

    def frame(self, spark: SparkSession) -> DataFrame:
        """The current state: slot, part, parts, hot_text (of a part cut by doc_id), shard."""
        rows = [{"slot": s, "part": p, "parts": self.parts.get(s, 1), "hot_text": self._hot_text(p), "shard": x}
                for (s, p), x in sorted(self.owner.items())]
        kind = "array<struct<slot:int,part:int,parts:int,hot_text:bigint,shard:int>>"
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))

    def store(self, spark: SparkSession, path: str) -> None:
        """All versions: version, slot, part, hot_text (of a part cut by doc_id), shard it moved
        to. Any state is the last move of each part up to a version."""
        rows = [{"version": v, "slot": s, "part": p, "hot_text": self._hot_text(p), "shard": x}
                for v, moves in enumerate(self.history) for s, p, x in moves]
        kind = "array<struct<version:int,slot:int,part:int,hot_text:bigint,shard:int>>"
        spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind))).write.parquet(path)


def records(docs: DataFrame, slots: int = SLOTS, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, text_hash, virtual_slot, cell and fine (a cell of FINE as many) of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"), F.pmod(F.xxhash64(text), F.lit(slots)).cast("int").alias("virtual_slot"))
    fine = F.pmod(F.xxhash64(F.lit(11), "doc_id", "repeat"), F.lit(cells * FINE)).cast("int")
    return with_repeat(rows, REPEATS).withColumn("fine", fine).withColumn("cell", fine % cells).drop("repeat")


def cuts(rows: DataFrame, shards: int = SHARDS) -> tuple[list[int], list[int], int]:
    """The slots heavier than a shard's share, the hashes of the texts in them that are so
    themselves (each fewer than ``shards``), and how many cells such a text's cell is cut into again, so that
    a task ranks about ``CELL_ROWS`` rows. Collects one row a slot besides."""
    slots = {r["virtual_slot"]: r["b"] for r in
             rows.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect()}
    share = sum(slots.values()) / shards
    heavy = sorted(s for s, b in slots.items() if b > share)
    if not heavy:
        return [], [], 1
    texts = rows.filter(F.col("virtual_slot").isin(heavy)).groupBy("text_hash").agg(
        F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).filter(F.col("b") > share).collect()
    most = max((r["n"] for r in texts), default=0)
    return heavy, sorted(r["text_hash"] for r in texts), min(FINE, 1 << max(0, -(-most // (CELLS * CELL_ROWS)) - 1).bit_length())


def with_parts(rows: DataFrame, heavy: list[int], hot: list[int], fine: int = 1) -> DataFrame:
    """Adds part: 0; in heavy slots a hash of the text; for hot texts their number and the cell, which is then cut
    into ``fine`` cells for ranking (a power of two; their places follow each other in the part's shard)."""
    if not heavy:
        return rows.withColumn("part", F.lit(0)).drop("fine")
    nth = F.array_position(F.array(*[F.lit(h).cast("long") for h in hot]).cast("array<long>"), F.col("text_hash"))
    part = F.when(nth > 0, nth * CELLS + F.col("cell")) \
            .when(F.col("virtual_slot").isin(heavy), F.pmod(F.xxhash64(F.lit(13), "text_hash"), F.lit(CELLS))) \
            .otherwise(0)
    cell = F.when(nth > 0, F.col("fine") % (CELLS * fine)).otherwise(F.col("cell"))
    return rows.withColumn("part", part.cast("int")).withColumn("cell", cell).drop("fine")


def build_map(cells: DataFrame, heavy: list[int], hot: list[int], shards: int = SHARDS) -> SlotMap:
    """Version 0 (dealt in turn) and version 1 (rebalanced) from the cells' sums. Collects one
    row a slot, and the parts of the heavy ones."""
    sizes = {(r["virtual_slot"], r["part"]): r["b"] for r in
             cells.groupBy("virtual_slot", "part").agg(F.sum("bytes").alias("b")).collect()}
    out = SlotMap(sizes, {s: CELLS for s in heavy}, shards, hot)
    out.rebalance()
    return out


def shard(docs: DataFrame, shards: int = SHARDS, map_path: str | None = None) -> DataFrame:
    """Every row's shard and place in it; the versioned map is stored under ``map_path``."""
    spark = docs.sparkSession
    rows = stored(records(docs), "shard-records")
    heavy, hot, fine = cuts(rows, shards)
    rows = with_parts(rows, heavy, hot, fine)
    cell = ["virtual_slot", "part", "cell"]
    cells = stored(rows.groupBy(*cell).agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-cells")
    slot_map = build_map(cells, heavy, hot, shards)
    slot_map.store(spark, map_path or scratch_path(spark, "slot-map"))
    m = slot_map.frame(spark).select(F.col("slot").alias("virtual_slot"), "part", "shard")
    placed = cells.join(F.broadcast(m), ["virtual_slot", "part"])
    before = Window.partitionBy("shard").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(*cell, "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = Window.partitionBy(*cell).orderBy("doc_id", "text_crc32", "size")
    # the ranked rows are already partitioned by cell: only the cells' offsets move for the join
    return (rows.withColumn("rank", F.row_number().over(rank) - 1)
                .join(placed, cell)
                .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                        (F.col("base") + F.col("rank")).cast("long").alias("slot"),
                        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"))


def q_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents in 16 shards of near-equal bytes."""
    return shard(documents(spark, sf_dir))
