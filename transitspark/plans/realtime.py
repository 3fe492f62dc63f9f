"""From landed feed snapshots to the four ledger tables, and the exploration summary."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from transitspark.operators import delays
from transitspark.operators.realtime import exploration_summary, ledger_entities, trip_update_rows
from transitspark.operators.state import state_as_of
from transitspark.streaming import ledger

RAW, NORMALIZED, DELTAS, METRICS = (
    "transit.snapshots.raw",
    "transit.snapshots.normalized",
    "transit.state.deltas",
    "transit.metrics.operational",
)
UNREADABLE = "transit.snapshots.unreadable"
LEDGER_SCHEMA = (
    T.StructType()
    .add("key", T.StringType())
    .add("value", T.StringType())
    .add("entity_type", T.StringType())
    .add("entity_id", T.StringType())
    .add("feed_ts", T.TimestampType())
    .add("ingestion_ts", T.TimestampType())
    .add("feed_version", T.StringType())
    .add("feed_date", T.DateType())
)


def explore(spark: SparkSession, feed_path: str, out_path: str) -> DataFrame:
    """One JSON document per landed snapshot: header and entity counts."""
    rows = ledger.read_entities(spark, feed_path)
    exploration_summary(rows, F.current_timestamp()).write.mode("overwrite").json(out_path)
    return spark.read.json(out_path)


def _table(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def _checkpoint(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/checkpoints/{name}"


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(_table(root, RAW)).select(*LEDGER_SCHEMA.names)


def start_raw(spark: SparkSession, feed_path: str, root: str, every: str | None = ledger.POLL) -> StreamingQuery:
    """Landed entities to the raw table: everything, unfiltered."""
    messages = ledger.raw_messages(ledger.stream_entities(spark, feed_path))
    return ledger.start_table(messages, _table(root, RAW), _checkpoint(root, RAW), every)


def start_guarded_raw(
    spark: SparkSession, feed_path: str, root: str, every: str | None = ledger.POLL, tries: int = 3
) -> StreamingQuery:
    """`start_raw` that sets a cycle aside once it failed `tries` times, below `<root>/quarantine`.

    The table has one folder per cycle instead of the file sink's log; a root takes one of the two.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        ledger.write_batch(ledger.raw_messages(batch), batch_id, _table(root, RAW))

    entities = ledger.stream_entities(spark, feed_path)
    return ledger.start_guarded(entities, step, quarantine(root), _checkpoint(root, RAW), every, tries)


def quarantine(root: str) -> str:
    return _table(root, f"quarantine/{RAW}")


def start_unreadable(spark: SparkSession, feed_path: str, root: str, every: str | None = ledger.POLL) -> StreamingQuery:
    """Feed lines that are no entity, kept with their text beside the ledger."""
    lines = ledger.stream_unreadable(spark, feed_path)
    return ledger.start_table(lines, _table(root, UNREADABLE), _checkpoint(root, UNREADABLE), every)


def start_derived(
    spark: SparkSession,
    root: str,
    every: str | None = ledger.POLL,
    watermark: str = "10 minutes",
    window: str = "15 minutes",
) -> dict[str, StreamingQuery]:
    """The three derived tables, each an independent reader of the raw table."""
    def raw() -> DataFrame:
        return spark.readStream.schema(LEDGER_SCHEMA).parquet(_table(root, RAW)).select(*LEDGER_SCHEMA.names)

    states = raw().where(F.col("key").isNotNull() & F.col("feed_ts").isNotNull()).select(
        "key",
        "feed_ts",
        "entity_type",
        F.get_json_object("value", "$.payload").alias("payload"),
        "entity_id",
    )
    updates = trip_update_rows(ledger_entities(raw())).withColumn(
        "delay_s", F.coalesce("arrival_delay_s", "departure_delay_s", "trip_delay_s")
    )
    metrics = delays.streamed_delay_metrics(updates, ["route_id", "stop_id"], window, watermark)
    dated = metrics.withColumn("feed_date", F.to_date("window_start"))
    return {
        NORMALIZED: ledger.start_table(
            ledger.normalized(raw(), watermark), _table(root, NORMALIZED), _checkpoint(root, NORMALIZED), every
        ),
        DELTAS: ledger.start_deltas(
            states, checkpoint=_checkpoint(root, DELTAS), every=every, **_snapshot_deltas(root)
        ),
        METRICS: ledger.start_table(dated, _table(root, METRICS), _checkpoint(root, METRICS), every),
    }


def _snapshot_deltas(root: str) -> dict:
    return {
        "keys": ["key"],
        "values": ["entity_type", "payload"],
        "out": _table(root, DELTAS),
        "state": _table(root, "checkpoints/last-snapshot"),
        "tie": ["entity_id"],
    }


def flush_deltas(spark: SparkSession, root: str) -> None:
    """Compares the newest snapshot too, once its stream is stopped."""
    ledger.flush_deltas(spark, **_snapshot_deltas(root))


def ledger_at(ledger_rows: DataFrame, at: F.Column, known_at: F.Column | None = None) -> DataFrame:
    """The message of every key that held at an instant; any instant can be replayed.

    The day filter lets Spark skip the later partitions of the ledger.
    """
    values = ["entity_type", "entity_id", "value", "feed_version", "ingestion_ts"]
    rows = ledger_rows.where(F.col("feed_date") <= F.to_date(at))
    return state_as_of(rows, ["key"], values, at, ["ingestion_ts", "entity_id"], known_at)


def keep_going(
    start: Callable[[], StreamingQuery], pause_s: float = 30.0, failures: int | None = None
) -> int:
    """Runs a stream and starts it again from its checkpoint when a cycle fails.

    The cycle that failed comes again; `ledger.start_guarded` sets it aside after some tries.
    Returns the number of failed runs once the stream ends by itself; with `failures` set, gives
    up (and raises) after that many in all.
    """
    failed = 0
    while True:
        try:
            start().awaitTermination()
            return failed
        except StreamingQueryException:
            failed += 1
            if failures is not None and failed >= failures:
                raise
            time.sleep(pause_s)
