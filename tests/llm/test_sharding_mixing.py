"""Sharding, mixing and exact duplicates on odd rows, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from rowsmith.llm import bloom, exactdedup, mixing, sharding


def _data(df):
    return [r.asDict() for r in df.collect()]


def test_shards_hold_every_row_once(odd):
    rows = _data(sharding.shard(odd))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_equal_texts_share_a_shard_and_sizes_are_near_equal(spark):
    rows = _data(sharding.q_sharding(spark, SF_SMALL.replace("0.001", "0.01")))
    load, place = Counter(), defaultdict(set)
    for r in rows:
        load[r["shard"]] += r["size"]
        place[r["text_crc32"], r["size"]].add(r["shard"])
    assert max(load.values()) < 1.01 * min(load.values())
    assert all(len(x) == 1 for x in place.values())


def test_a_hot_text_is_cut_into_parts(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "hot " * 50).otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string"), F.lit("y" * 190))).alias("text"))
    load = Counter()
    for r in _data(sharding.shard(docs)):
        load[r["shard"]] += r["size"]
    assert max(load.values()) < 1.1 * min(load.values())


def test_copies_in_a_hot_texts_slot_stay_together(spark):
    """Only the hot text itself is cut: the copies of another text in its slot share a shard."""
    slot = lambda t: F.pmod(F.xxhash64(t), F.lit(sharding.SLOTS))
    names = spark.range(40000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("t")).filter(
        slot(F.col("t")) == slot(F.lit("hot " * 50)))
    names = sorted(r["t"] for r in names.collect())
    assert len(names) > 2
    rows = [(i, "hot " * 50) for i in range(1500)] + [(i, f"text {i}" + "y" * 190) for i in range(1500, 3000)]
    rows += [(3000 + i, names[i % len(names)]) for i in range(40 * len(names))]
    place = defaultdict(set)
    for r in _data(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"))):
        place[r["text_crc32"]].add(r["shard"])
    assert all(len(place[zlib.crc32(t.encode())]) == 1 for t in names)
    assert len(place[zlib.crc32(("hot " * 50).encode())]) == 16


def test_a_hot_text_without_ids_is_cut_too(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REPEATS", 100)
    docs = spark.range(3000).select(F.when(F.col("id") >= 1500, F.col("id")).alias("doc_id"), F.when(
        F.col("id") < 1500, "hot " * 50).otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string"), F.lit("y" * 190))).alias("text"))
    by = defaultdict(list)
    for r in _data(sharding.shard(docs)):
        by[r["shard"]].append((r["slot"], r["size"]))
    load = [sum(s for _, s in x) for x in by.values()]
    assert max(load) < 1.1 * min(load) and len(load) == 16
    assert all(sorted(p for p, _ in x) == list(range(len(x))) for x in by.values())


def test_growing_moves_parts_to_the_new_shard_only():
    sizes = {(s, 0): 100 + s * s % 997 for s in range(sharding.SLOTS)}
    m = sharding.SlotMap(sizes, {}, 16)
    m.rebalance()
    before = dict(m.owner)
    m.grow()
    moved = {k: x for k, x in m.owner.items() if before[k] != x}
    assert moved and set(moved.values()) == {16}
    load = Counter()
    for k, x in m.owner.items():
        load[x] += sizes[k]
    assert max(load.values()) < 1.02 * min(load.values())
    assert [len(h) > 0 for h in m.history] == [True, True, True] and len(m.history) == 3


def test_map_versions_are_stored(spark, odd, tmp_path):
    path = str(tmp_path / "map")
    sharding.shard(odd, map_path=path)
    assert {r["version"] for r in spark.read.parquet(path).collect()} == {0, 1}


def test_empty_tables(empty):
    assert sharding.shard(empty).collect() == []
    assert mixing.mix(empty).collect() == [] and mixing.assign(empty).collect() == []
    assert exactdedup.annotate(empty).collect() == [] and exactdedup.dedup(empty).columns == empty.columns


def test_cells_of_a_hot_text_follow_its_rows(spark, monkeypatch):
    """A text that most rows share is ranked in as many cells as its rows need; places stay gapless."""
    docs = spark.createDataFrame([(i, "the same text " * 20) for i in range(3000)] + [(5000 + i, f"text {i % 90}") for i in range(200)]
                                 + [(None, None), (7, "the same text " * 20)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(sharding, "CELL_ROWS", 4)
    rows = sharding.records(docs).cache()
    heavy, hot, fine = sharding.cuts(rows)
    assert len(hot) == 1 and fine == 16
    cut = sharding.with_parts(rows, heavy, hot, fine)
    own = cut.filter(F.col("text_hash") == hot[0]).groupBy("part", "cell").count().collect()
    assert len(own) > 500 and len({r["part"] for r in own}) == 64 and all(r["part"] % 64 == r["cell"] % 64 for r in own)
    out = sharding.shard(docs).collect()
    assert len(out) == 3202
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    size = Counter()
    for r in out:
        size[r["shard"]] += r["size"]
    assert len(size) == 16 and max(size.values()) < 1.25 * min(size.values())      # 64 parts for 16 shards


def _targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return {**target, **share}
        for s in over:
            target[s] = 3.0 * sizes[s]
            open_.discard(s)
            left -= target[s]


def _words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_mixing_targets_and_counts(odd):
    rows = _data(mixing.assign(odd).select("doc.*", F.col("size").alias("words"), "source_size", "target", "taken", "positions"))
    sizes = Counter()
    for r in odd.collect():
        sizes[r["source"]] += _words(r["text"])
    want = _targets(sizes)
    assert len(rows) == odd.count()
    taken = Counter()
    for r in rows:
        assert r["words"] == _words(r["text"]) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["taken"] in {k * r["words"] for k in range(4)} and len(r["positions"]) * r["words"] == r["taken"]
        assert all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]


def test_mixing_comes_near_its_targets_and_reruns_agree(spark):
    sf = SF_SMALL.replace("0.001", "0.01")
    one, two = (sorted(map(str, mixing.q_mixing(spark, sf).collect())) for _ in range(2))
    assert one == two
    rows = _data(mixing.q_mixing(spark, sf))
    taken, target = Counter(), {}
    for r in rows:
        taken[r["source_size"], r["target"]] += r["taken"]
        target[r["source_size"], r["target"]] = r["target"]
    assert all(abs(taken[k] - t) < 0.03 * t for k, t in target.items())


def test_mixture_carries_all_columns_in_training_order(odd):
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    passes = mixing.assign(odd).select(F.sum(F.size("positions"))).first()[0]
    assert out.count() == passes


def test_inverted_integral(spark):
    """A position's integral of the weight schedule is the share of the target asked for before it."""
    for r in mixing.assign(spark.createDataFrame([(i, "w " * 50, "ab"[i % 2]) for i in range(400)],
                                                 "doc_id long, text string, source string")).collect():
        ramp = mixing.RAMP if r["doc"]["source"] == "a" else -mixing.RAMP
        all_ = r["target"] / r["source_size"]
        for i, t in enumerate(r["positions"]):
            assert abs(t * (1 + ramp) - ramp * t * t - min(1, (i + r["u"]) / all_)) < 0.06


def _demand(rows, hashes):
    """(row, pass) -> share of its source's given words that come before it, by sorting and adding up."""
    out = {}
    for src in {r["doc"]["source"] for r in rows}:
        own = sorted((r for r in rows if r["doc"]["source"] == src and r["size"]), key=lambda r: hashes[r["doc"]["doc_id"]])
        passes = math.floor(own[0]["target"] / own[0]["source_size"]) if own else 0
        given = sum(r["taken"] for r in own)
        at = 0
        for i in range(passes + 1):
            for r in own:
                if len(r["positions"]) > i:
                    out[r["doc"]["doc_id"], i] = at / given
                    at += r["size"]
        assert at == given
    return out


@pytest.mark.parametrize("sizes", ["one huge", "pareto", "equal"])
def test_positions_invert_cumulative_words(spark, sizes):
    """Positions against brute-force word sums, with sizes far from equal."""
    rnd = random.Random(7)
    size = {"one huge": lambda i: 5000 if i == 17 else 5, "pareto": lambda i: int(rnd.paretovariate(0.8)) % 3000 + 1,
            "equal": lambda i: 3}[sizes]
    docs = spark.createDataFrame([(i, "w " * size(i), "abbc"[i % 4]) for i in range(3000)], "doc_id long, text string, source string")
    hashes = {r["doc"]["doc_id"]: r["hash"] for r in mixing._sized(docs).collect()}
    rows = mixing.assign(docs).collect()
    want = _demand(rows, hashes)
    off, n = 0, 0
    for r in rows:
        ramp = mixing.RAMP if r["doc"]["source"] in "ac" else -mixing.RAMP
        assert r["positions"] == sorted(r["positions"])
        for i, t in enumerate(r["positions"]):
            off = max(off, abs(t * (1 + ramp) - ramp * t * t - want[r["doc"]["doc_id"], i]))
            n += 1
    assert n == len(want) and off < 0.004


def test_many_sources_without_one_task(spark, monkeypatch):
    """Targets with more levels than the driver takes equal plain water-filling."""
    rnd = random.Random(3)
    sizes = {(f"http://site{i}/é" if i else None): rnd.choice([0, 1, 7, rnd.randint(1, 10_000)]) for i in range(400)}
    monkeypatch.setattr(mixing, "LEVELS", 5)
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "src string, source_size long")).collect()
    want = _targets(sizes)
    assert len(got) == 400
    assert all(abs(r["target"] - want[r["name"]]) < 1e-6 * max(1, want[r["name"]]) for r in got)
    assert abs(sum(r["target"] for r in got) - sum(sizes.values())) < 1e-3


def test_equal_rows_beyond_a_number_spread(spark, monkeypatch):
    """Rows without an id and with one text get positions of their own, so they fill many partitions."""
    monkeypatch.setattr(mixing, "REPEATS", 20)
    docs = spark.createDataFrame([(None, "same words here", "a")] * 200 + [(i, "x y z", "b") for i in range(100)],
                                 "doc_id long, text string, source string").repartition(3)
    rows = mixing.assign(docs).collect()
    copies = [tuple(r["positions"]) for r in rows if r["doc"]["doc_id"] is None]
    assert len(copies) == 200 and len(set(copies)) > 100
    out = mixing.mix(docs, 8).withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert len(out) == 8 and sum(r["count"] for r in out) == sum(len(r["positions"]) for r in rows)
    assert max(r["count"] for r in out) < 3 * min(r["count"] for r in out)


def test_mixture_lies_in_order_of_position(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 50), "abc"[i % 3]) for i in range(500)], "doc_id long, text string, source string")
    first = {r["doc"]["doc_id"]: r["positions"] for r in mixing.assign(docs).collect()}
    at, seen = -1, Counter()
    for r in mixing.mix(docs, 5).collect():        # partitions in turn
        t = first[r["doc_id"]][seen[r["doc_id"]]]
        seen[r["doc_id"]] += 1
        assert t >= at
        at = t


def test_exact_groups(odd):
    rows = _data(exactdedup.annotate(odd).select("doc.doc_id", "doc.text", "keep_id", "group_size", "kept", "text_sha256"))
    groups = defaultdict(list)
    for r in odd.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    assert len(rows) == odd.count()
    kept = Counter()
    for r in rows:
        ids = groups[r["text"] or ""]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((x for x in ids if x is not None), default=None)
        assert r["text_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
        kept[r["text"] or ""] += r["kept"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    out = exactdedup.dedup(odd)
    assert out.columns == odd.columns and out.count() == len(groups)


def test_slices_give_the_same_groups(odd, monkeypatch):
    want = sorted(map(str, exactdedup.annotate(odd).select("keep_id", "group_size", "kept", "text_sha256").collect()))
    monkeypatch.setattr(bloom, "MAX_BITS", 1 << 9)
    monkeypatch.setattr(bloom, "SEGMENT_BYTES", 1 << 4)
    assert bloom.slice_count(odd.count()) > 1
    got = sorted(map(str, exactdedup.annotate(odd).select("keep_id", "group_size", "kept", "text_sha256").collect()))
    assert got == want


def test_filter_misses_no_repeated_hash(spark):
    h = spark.range(5000).select(F.xxhash64(F.col("id") % 4000).alias("h"))
    plane = bloom.repeated_plane(h, "h", bloom.filter_bits(5000))
    found = h.withColumn("m", bloom.in_plane(plane, F.col("h"), h)).groupBy("h").agg(F.count("h").alias("n"), F.max("m").alias("m"))
    assert found.filter("n > 1 and not m").count() == 0
    assert found.filter("n = 1 and m").count() < 100
