"""JSON event streams with Structured Streaming.

``stream_silver`` keeps the keys it has seen in RocksDB state that expires, so a micro-batch
costs the same however large the silver table has grown; ``publish_stream`` writes each micro-batch
under a transaction id of (application, batch), so a replayed batch replaces itself.

Events are rows serialised to one JSON ``value`` per record. The same
``to_events`` / ``from_events`` projections serve a Kafka sink/source (when the
connector is on the classpath) and plain JSON-lines file directories, which
stand in for a topic in tests. Timestamps keep microseconds.
"""

from __future__ import annotations

from contextlib import contextmanager
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowsmith.functions.fields import GenContext, default_as_of, field_column
from rowsmith.spec import TableSpec

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
TS_NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
JSON_OPTIONS = {"timestampFormat": TS_FORMAT, "timestampNTZFormat": TS_NTZ_FORMAT}


def to_events(df: DataFrame, key: str | None = None) -> DataFrame:
    """One JSON text ``value`` per row (plus a string ``key`` when given)."""
    value = F.to_json(F.struct(*[F.col(c) for c in df.columns]), JSON_OPTIONS).alias("value")
    if key:
        return df.select(F.col(key).cast("string").alias("key"), value)
    return df.select(value)


CORRUPT = "_corrupt_record"
BATCH_ID = "batch_id"


def from_events(df: DataFrame, schema: T.StructType, value_col: str = "value", corrupt: str | None = None) -> DataFrame:
    """Decode the JSON ``value`` column with a declared schema. With ``corrupt`` a further
    text column holds the raw value of records that are not JSON of that schema (NULL for
    good ones); without it such records decode to NULLs."""
    options = dict(JSON_OPTIONS)
    if corrupt:
        schema = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
        options["columnNameOfCorruptRecord"] = corrupt
    return df.select(F.from_json(F.col(value_col).cast("string"), schema, options).alias("e")).select("e.*")


def write_event_files(df: DataFrame, path: str, mode: str = "append") -> None:
    """Batch producer into a JSON-lines directory (one file per task)."""
    to_events(df).write.mode(mode).text(path)


def kafka_options(servers: str, topic: str, source: bool = False, **extra) -> dict[str, str]:
    """Options of the Kafka connector, for publishing to a topic or reading it from its start."""
    out = {"kafka.bootstrap.servers": servers}
    out.update({"subscribe": topic, "startingOffsets": "earliest"} if source else {"topic": topic})
    return {**out, **{k: str(v) for k, v in extra.items()}}


def topic_name(prefix: str, domain: str) -> str:
    """``<prefix>-<domain>-events``."""
    return f"{prefix}-{domain}-events"


def publish(df: DataFrame, servers: str, topic: str, key: str | None = None, **extra) -> None:
    """S13 on Kafka: one JSON event per row (needs the Kafka connector on the classpath)."""
    to_events(df, key).write.format("kafka").options(**kafka_options(servers, topic, **extra)).save()


def kafka_source(spark: SparkSession, servers: str, topic: str, **extra) -> DataFrame:
    """S14 on Kafka from the earliest offset (needs the Kafka connector on the classpath)."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, source=True, **extra)).load()


def read_event_stream(spark: SparkSession, path: str, schema: T.StructType,
                      max_files_per_trigger: int | None = None, corrupt: str | None = None) -> DataFrame:
    """S14 on a JSON-lines directory, as a stream."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return from_events(r.load(path), schema, corrupt=corrupt)


#: Column with the time a record was first read, by which keys expire.
SEEN = "_seen"
ROUTE = "_route"
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def _first_of_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key of each Arrow batch, before any shuffle: of a key that very many records share
    only one record per batch reaches the task that holds its state."""
    def work(batches):
        for batch in batches:
            if batch.num_rows:
                again = batch.select(keys).to_pandas().duplicated().to_numpy()
                yield batch.filter(pa.array(~again))

    return df.mapInArrow(work, df.schema)


def first_seen(events: DataFrame, keys: list[str], remember: str) -> DataFrame:
    """Streaming rows whose key has not been seen before. Keys live in the state store until ``remember``
    of reading time has passed since their first record; no row is too late for it."""
    seen = _first_of_keys(events, keys).withColumn(SEEN, F.current_timestamp())
    return seen.withWatermark(SEEN, remember).dropDuplicatesWithinWatermark(keys).drop(SEEN)


def stream_silver(events: DataFrame, keys, out_path: str, checkpoint: str, corrupt: str | None = None,
                  bad_path: str | None = None, ts_col: str | None = None, late_after: str | None = None,
                  late_path: str | None = None, timeout_s: float | None = None, remember: str = "7 days") -> None:
    """append each event once, by ``keys``, to the silver table at ``out_path``; stops when
    everything now available is processed and goes on from ``checkpoint`` later.

    Seen keys are streaming state (RocksDB, in the checkpoint) that expires ``remember`` after a
    key was first read; silver itself is never read, so the cost of a batch does not depend on its size. No row
    is dropped for being late: with ``late_after`` (an interval such as "1 hour") new rows of ``ts_col`` older than
    that against the newest event of earlier batches go to ``late_path``. With ``late_after`` at most ``remember``, a copy
    whose key has expired is late too as soon as events are as new as their reading time, so it lands there and
    silver stays unique. Records that did not decode (non-NULL ``corrupt``) go to ``bad_path``; rows
    without a key (any part NULL) are no copies of each other and are all kept.

    A micro-batch is staged once, so state is read and written once, and then put into its tables as
    the partition ``batch_id=<n>``, which a replay overwrites: restarts neither lose nor repeat rows."""
    keys = list(keys)
    spark = events.sparkSession
    if (corrupt is None) != (bad_path is None) or (late_after is None) != (late_path is None):
        raise ValueError("corrupt needs bad_path, and late_after needs late_path")
    names = [c for c in events.columns if c != corrupt]
    silver_schema = T.StructType([f for f in events.schema.fields if f.name != corrupt])
    staged_schema = T.StructType([*events.schema.fields, T.StructField(ROUTE, T.StringType())])
    spark.createDataFrame([], silver_schema).write.mode("ignore").parquet(f"{out_path}/{BATCH_ID}=-1")

    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    bad = F.col(corrupt).isNotNull() if corrupt else F.lit(False)
    rows = first_seen(events.where(~bad & keyed), keys, remember).unionByName(events.where(bad | ~keyed))

    def take(batch: DataFrame, n: int) -> None:
        session, stage, newest = batch.sparkSession, f"{checkpoint}/stage", None
        late = F.lit(False)
        if late_after:
            newest = session.read.parquet(f"{checkpoint}/newest/{n - 1}").first()[0] if n else None
            if newest is not None:
                late = F.coalesce(F.col(ts_col) < F.lit(newest) - F.expr(f"INTERVAL {late_after}"), F.lit(False))
        route = F.when(bad, "bad").when(late, "late").otherwise("silver")
        batch.withColumn(ROUTE, route).write.mode("overwrite").partitionBy(ROUTE).parquet(stage)
        staged = session.read.schema(staged_schema).parquet(stage)
        found = {r[0] for r in staged.select(ROUTE).distinct().collect()}
        for name, path, columns in (("silver", out_path, names), ("late", late_path, names), ("bad", bad_path, [corrupt])):
            if name in found:
                staged.where(F.col(ROUTE) == name).select(*columns).write.mode("overwrite").parquet(f"{path}/{BATCH_ID}={n}")
        if late_after:
            top = staged.where(F.col(ROUTE) != "bad").agg(F.max(ts_col).alias("newest"))
            top.select(F.greatest("newest", F.lit(newest).cast(top.schema["newest"].dataType)).alias("newest")
                       ).write.mode("overwrite").parquet(f"{checkpoint}/newest/{n}")

    with _settings(spark, ROCKSDB):        # a query takes the settings with it when it starts
        query = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    _finish(query, timeout_s)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def transaction(app: str, batch: int) -> str:
    """The id under which a micro-batch is published; a replay of the batch has the same."""
    return f"{app}/{batch}"


def kafka_records(df: DataFrame, app: str, batch: int, key: str | None = None) -> DataFrame:
    """S13 on Kafka: records whose ``txn`` header holds the transaction id. A topic can't take a record back,
    so a replayed batch is there twice; consumers keep the first record of each (txn, key)."""
    header = F.struct(F.lit("txn").alias("key"), F.lit(transaction(app, batch)).cast("binary").alias("value"))
    return to_events(df, key).withColumn("headers", F.array(header))


def publish_stream(events: DataFrame, app: str, checkpoint: str, path: str | None = None, servers: str | None = None,
                   topic: str | None = None, key: str | None = None, timeout_s: float | None = None, **extra) -> None:
    """Publish a stream's rows as JSON events, to JSON-lines files under ``path`` or to a Kafka ``topic``; stops
    when everything now available is published and goes on from ``checkpoint`` later.

    A micro-batch goes to ``path/app=<app>/txn=<batch>``, which a replay after a failure overwrites, so readers of the folder
    see every event once; several applications may publish into one folder."""
    if (path is None) == (topic is None):
        raise ValueError("publish to a path or to a topic")

    def take(batch: DataFrame, n: int) -> None:
        if path is not None:
            to_events(batch).write.mode("overwrite").text(f"{path}/app={app}/txn={n}")
        else:
            kafka_records(batch, app, n, key).write.format("kafka").options(**kafka_options(servers, topic, **extra)).save()

    _finish(events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(), timeout_s)


def read_published(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The events that :func:`publish_stream` wrote under ``path``."""
    return from_events(spark.read.text(path).select("value"), schema)


def read_silver(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that :func:`stream_silver` wrote, without the batch column."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def _finish(query, timeout_s: float | None) -> None:
    """Wait for a query; raise its error, or TimeoutError if it did not end in time."""
    ended = query.awaitTermination(timeout_s) if timeout_s is not None else query.awaitTermination()
    if timeout_s is not None and not ended:
        query.stop()
        raise TimeoutError(f"the stream was stopped after {timeout_s} s with part of its input unprocessed")
    if query.exception():
        raise query.exception()


def run_available_now(df: DataFrame, out_path: str, checkpoint: str, fmt: str = "parquet",
                      timeout_s: float | None = None) -> None:
    """Process everything available now into ``out_path`` and stop; restartable from
    ``checkpoint`` (exactly-once file sink)."""
    _finish(df.writeStream.format(fmt).option("path", out_path).option("checkpointLocation", checkpoint)
              .outputMode("append").trigger(availableNow=True).start(), timeout_s)


def stream_generate(spark: SparkSession, table: TableSpec, rows_per_second: int = 1000, seed: int = 42,
                    as_of: datetime | None = None, mode: str = "fast") -> DataFrame:
    """A synthetic record stream from the ``rate`` source: row key = rate value + 1,
    every field from the stateless generators (no per-batch statistics)."""
    ctx = GenContext(table=table.name, seed=seed, as_of=as_of or default_as_of(), mode=mode,
                     rows=1, batched=False, ordered=False)
    src = (spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
           .select((F.col("value") + 1).alias("_row")))
    cols = [(F.col("_row") if f.name == table.primary_key else field_column(f, ctx)).alias(f.name)
            for f in table.fields]
    return ctx.prepare(src).select(*cols)
