"""Streams: JSON events, restartable dedupe, generated record stream."""

import time

from pyspark.sql import functions as F

from rowsmith.plans.registry import MEMBER_VISITS
from rowsmith.spec import load_spec
from rowsmith.streaming import events as ev

SF = "/root/testdata/sf0.001"


def test_event_roundtrip_batch(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    back = ev.from_events(ev.to_events(e), e.schema)
    assert back.exceptAll(e).count() == 0 and e.exceptAll(back).count() == 0


def test_backfill_of_shuffled_files_loses_nothing_and_restarts(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    src, out, ck, bad = (str(tmp_path / x) for x in ("topic", "silver", "ckpt", "bad"))

    def go():
        stream = ev.read_event_stream(spark, src, e.schema, max_files_per_trigger=4, corrupt=ev.CORRUPT)
        ev.stream_silver(stream, ["event_id"], out, ck, ev.CORRUPT, bad)
        return ev.read_silver(spark, out, e.schema)

    ev.write_event_files(e.repartition(24, "event_id"), src)
    spark.createDataFrame([('{"event_id": 1, "ts',), ("not json",)], "value string").write.mode("append").text(src)
    got = go()
    assert got.count() == e.count() and got.exceptAll(e).count() == 0
    ev.write_event_files(e.where(F.col("event_type") == "view"), src)     # copies arrive later
    got = go()
    assert got.count() == e.count() and got.exceptAll(e).count() == 0
    assert {r[ev.CORRUPT] for r in spark.read.parquet(bad).collect()} == {'{"event_id": 1, "ts', "not json"}


def _silver(spark, e, src, out, ck, **more):
    ev.stream_silver(ev.read_event_stream(spark, src, e.schema, max_files_per_trigger=2), ["event_id"], out, ck, **more)
    return ev.read_silver(spark, out, e.schema)


def test_silver_is_never_read(spark, tmp_path):
    """Copies are known from state: earlier silver may be moved away, and batches stay as cheap."""
    import shutil
    e = spark.read.parquet(f"{SF}/events.parquet")
    src, out, ck = (str(tmp_path / x) for x in ("topic", "silver", "ckpt"))
    ev.write_event_files(e.repartition(4, "event_id"), src)
    assert _silver(spark, e, src, out, ck).count() == e.count()
    assert list((tmp_path / "ckpt" / "state").rglob("*.zip")) or list((tmp_path / "ckpt" / "state").rglob("*.changelog"))
    for p in (tmp_path / "silver").glob("batch_id=[0-9]*"):
        shutil.move(p, tmp_path / p.name)
    ev.write_event_files(e, src)                                    # every event again
    assert _silver(spark, e, src, out, ck).count() == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_replayed_batch_and_keyless_rows(spark, tmp_path):
    """A batch that was written but not committed is run again; rows without a key are all kept."""
    rows = [(i % 50 if i % 7 else None, i % 50 if i % 7 else i, "x") for i in range(300)]
    e = spark.createDataFrame(rows, "event_id long, v long, t string")
    src, out, ck = (str(tmp_path / x) for x in ("topic", "silver", "ckpt"))
    ev.write_event_files(e.repartition(6), src)
    want = sorted(map(tuple, _silver(spark, e, src, out, ck).collect()), key=str)
    assert len(want) == 50 - sum(1 for k in range(50) if all(i % 7 == 0 for i in range(k, 300, 50))) + sum(i % 7 == 0 for i in range(300))
    for p in (tmp_path / "ckpt" / "commits").iterdir():
        if p.name.lstrip(".").startswith("2"):                      # the third batch, and its checksum
            p.unlink()
    again = _silver(spark, e, src, out, ck)
    assert sorted(map(tuple, again.collect()), key=str) == want


def test_hot_key_is_combined_before_the_shuffle(spark, tmp_path):
    e = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("event_id"))
    one = ev._first_of_keys(e.repartition(2), ["event_id"])
    assert one.where("event_id = 7").count() < 20 and one.distinct().count() == e.distinct().count()


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    from datetime import datetime, timedelta
    src, out, ck, late = (str(tmp_path / x) for x in ("topic", "silver", "ckpt", "late"))
    rows = lambda ids, day: spark.createDataFrame([(i, datetime(2024, 1, day) + timedelta(minutes=i)) for i in ids],
                                                  "event_id long, ts timestamp_ntz")
    schema = rows([1], 1).schema
    for ids, day in ((range(5), 3), (range(3, 9), 1), (range(20, 22), 4)):
        ev.write_event_files(rows(ids, day), src)
        ev.stream_silver(ev.read_event_stream(spark, src, schema), ["event_id"], out, ck, ts_col="ts",
                         late_after="1 hour", late_path=late)
    assert sorted(r.event_id for r in ev.read_silver(spark, out, schema).collect()) == [0, 1, 2, 3, 4, 20, 21]
    assert sorted(r.event_id for r in spark.read.parquet(late).collect()) == [5, 6, 7, 8]


def test_timeout_raises(spark, tmp_path):
    import pytest
    e = spark.read.parquet(f"{SF}/events.parquet")
    ev.write_event_files(e.repartition(24, "event_id"), str(tmp_path / "t"))
    stream = ev.read_event_stream(spark, str(tmp_path / "t"), e.schema, max_files_per_trigger=1)
    with pytest.raises(TimeoutError):
        ev.run_available_now(stream, str(tmp_path / "o"), str(tmp_path / "c"), timeout_s=1)


def test_published_stream_survives_a_crash(spark, tmp_path):
    """The last batch was written, but the stream died before it was committed; another application publishes too."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(6, "event_id").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    ck, out = str(tmp_path / "ck"), str(tmp_path / "out")
    ev.publish_stream(stream(), "a", ck, out)
    for p in (tmp_path / "ck" / "commits").iterdir():
        if p.name.lstrip(".").startswith("2"):
            p.unlink()
    e.limit(5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ev.publish_stream(stream(), "a", ck, out)
    ev.publish_stream(stream(), "b", str(tmp_path / "ck2"), str(tmp_path / "out2"))
    want = e.union(e.limit(5))
    for path in (out, str(tmp_path / "out2")):
        got = ev.read_published(spark, path, e.schema)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
    import pytest
    with pytest.raises(ValueError):
        ev.publish_stream(stream(), "a", ck)


def test_kafka_records_carry_their_transaction(spark):
    e = spark.createDataFrame([(1, "x"), (2, None)], "id long, t string")
    r = ev.kafka_records(e, "app", 7, "id").orderBy("key").collect()
    assert [(x["key"], x["value"], bytes(x["headers"][0]["value"])) for x in r] == [
        ("1", '{"id":1,"t":"x"}', b"app/7"), ("2", '{"id":2}', b"app/7")]


def test_kafka_options():
    assert ev.topic_name("rs", "health") == "rs-health-events"
    assert ev.kafka_options("h:1", "t", acks="all") == {"kafka.bootstrap.servers": "h:1", "topic": "t", "acks": "all"}
    assert ev.kafka_options("h:1", "t", source=True)["startingOffsets"] == "earliest"


def test_stream_generate_rate_source(spark):
    t = load_spec(MEMBER_VISITS).table("members")
    s = ev.stream_generate(spark, t, rows_per_second=200)
    q = s.writeStream.format("memory").queryName("gen_patients").outputMode("append").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("gen_patients").count() < 50:
            time.sleep(1)
    finally:
        q.stop()
    got = spark.table("gen_patients")
    assert got.count() >= 50
    assert got.where(~F.col("email").contains("@")).count() == 0
    assert got.select("id").distinct().count() == got.count()
