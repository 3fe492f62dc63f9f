"""Streams from decoded entities to the ledger and on to its derived tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from transitspark.functions.clock import feed_instant
from transitspark.operators.realtime import ledger_messages, named_model
from transitspark.operators.state import snapshot_deltas, snapshot_sequence
from transitspark.sources import files
from transitspark.sources.feed_schema import FEED_SCHEMA

POLL = "30 seconds"
_CORRUPT = "__line"
_READABLE = f"({_CORRUPT} IS NULL AND id IS NOT NULL)"


_LINES = T.StructType([*FEED_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])


def _lines(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """Every line of the landed files; the text of one that does not decode is in `_CORRUPT`."""
    return reader.schema(_LINES).option("columnNameOfCorruptRecord", _CORRUPT).json(path)


def _decoded(lines: DataFrame) -> DataFrame:
    return lines.where(_READABLE).drop(_CORRUPT)


def _unreadable(lines: DataFrame) -> DataFrame:
    """`line`, `read_at` of what is no entity: not JSON, of other types, or without an id."""
    text = F.coalesce(F.col(_CORRUPT), F.to_json(F.struct(*FEED_SCHEMA.names)))
    return lines.where(f"NOT {_READABLE}").select(text.alias("line"), F.current_timestamp().alias("read_at"))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Decoded entities (JSON, one per line, header repeated) of landed feed snapshots.

    Lines that do not decode are not among them; see `read_unreadable`.
    """
    return _decoded(_lines(spark.read, path))


def read_unreadable(spark: SparkSession, path: str) -> DataFrame:
    """The lines of landed feed snapshots that are no entity: `line`, `read_at`."""
    return _unreadable(_lines(spark.read, path))


def stream_entities(spark: SparkSession, path: str) -> DataFrame:
    """`read_entities` as a stream: each new file is picked up once."""
    return _decoded(_lines(spark.readStream, path))


def stream_unreadable(spark: SparkSession, path: str) -> DataFrame:
    return _unreadable(_lines(spark.readStream, path))


def raw_messages(entities: DataFrame) -> DataFrame:
    """Ledger messages of entities with a header, batch or stream.

    `current_timestamp()` has one value per query, and per micro-batch in a stream, so all
    messages of a cycle share their ingestion instant.
    """
    now = F.current_timestamp()
    header = F.col("header")
    return ledger_messages(
        named_model(entities),
        feed_instant(header["timestamp"], now),
        header["gtfs_realtime_version"],
        now,
    )


def start_table(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    every: str | None = POLL,
    partition: str | None = "feed_date",
) -> StreamingQuery:
    """Appends a stream to a Parquet table, exactly once; `every=None` drains and stops.

    A cycle that fails stops the query; restarted on the same checkpoint it goes on with the
    cycle that failed.
    """
    writer = rows.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    if partition and partition in rows.columns:
        writer = writer.partitionBy(partition)
    timed = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return timed.start()


# --- cycles that fail ---------------------------------------------------------------------------


class _Guard:
    """A step that is tried `tries` times per micro-batch; then the batch is set aside and counts as done.

    Tries are counted in files before the step runs, so one that takes the driver down counts too.
    """

    def __init__(self, step: Callable[[DataFrame, int], None], aside: str, checkpoint: str, tries: int) -> None:
        if tries < 1:
            raise ValueError("a batch is tried at least once")
        self.step, self.aside, self.checkpoint, self.tries = step, aside.rstrip("/"), checkpoint.rstrip("/"), tries

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        attempts = f"{self.aside}/attempts/batch_id={batch_id}"
        tried = len(files.children(spark, attempts))
        error = "every try ended the driver"
        if tried < self.tries:
            files.write_new(spark, f"{attempts}/{tried + 1}", "")
            try:
                return self.step(batch, batch_id)
            except Exception as e:
                if tried + 1 < self.tries:
                    raise
                error = f"{type(e).__name__}: {e}"
        self.set_aside(batch, batch_id, error)

    def set_aside(self, batch: DataFrame, batch_id: int, error: str) -> None:
        spark = batch.sparkSession
        if files.exists(spark, f"{self.aside}/records/{batch_id}.json"):
            return
        kept = True
        try:
            batch.write.mode("overwrite").parquet(_aside_rows(self.aside, batch_id))
        except Exception as e:  # the input itself cannot be read: its offsets still say what it was
            kept, error = False, f"{error}\n{type(e).__name__}: {e}"
        offsets = files.read_text(spark, f"{self.checkpoint}/offsets/{batch_id}")
        told = {"batch_id": batch_id, "tries": self.tries, "rows_kept": kept, "error": error, "offsets": offsets}
        files.write_new(spark, f"{self.aside}/records/{batch_id}.json", json.dumps(told))


def _aside_rows(aside: str, batch_id: int) -> str:
    return f"{aside.rstrip('/')}/rows/batch_id={batch_id}"


def start_guarded(
    rows: DataFrame,
    step: Callable[[DataFrame, int], None],
    aside: str,
    checkpoint: str,
    every: str | None = POLL,
    tries: int = 3,
) -> StreamingQuery:
    """Runs `step` on each micro-batch; one that fails `tries` times is set aside and the next one comes.

    A failure before that stops the query, and a restart on the same checkpoint tries the same batch
    again (`plans.realtime.keep_going` does so). What is set aside are the rows the step was given, the
    error and the source's offsets (`read_aside`); `retry_aside` gives them to a mended step. The step
    must give the same result when a batch is repeated, as `write_batch` does, and must not build
    on the result of the batch before.
    """
    writer = rows.writeStream.foreachBatch(_Guard(step, aside, checkpoint, tries)).option("checkpointLocation", checkpoint)
    timed = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return timed.start()


_ASIDE = "batch_id long, tries int, rows_kept boolean, error string, offsets string"


def read_aside(spark: SparkSession, aside: str) -> DataFrame:
    """One row per batch that is set aside and not yet retried with success."""
    records = f"{aside.rstrip('/')}/records"
    if not files.exists(spark, records):
        return spark.createDataFrame([], _ASIDE)
    retried = [int(e.name) for e in files.children(spark, f"{aside.rstrip('/')}/retried")]
    return spark.read.schema(_ASIDE).json(records).where(~F.col("batch_id").isin(retried))


def retry_aside(spark: SparkSession, aside: str, step: Callable[[DataFrame, int], None]) -> list[int]:
    """Gives the rows of batches set aside to a mended step, oldest first; returns the batches done.

    A step that fails again raises, and that batch stays aside. Batches whose rows could not be read are left.
    """
    done = []
    for batch_id, in read_aside(spark, aside).where("rows_kept").select("batch_id").orderBy("batch_id").collect():
        step(spark.read.parquet(_aside_rows(aside, batch_id)), batch_id)
        files.write_new(spark, f"{aside.rstrip('/')}/retried/{batch_id}", "")
        done.append(batch_id)
    return done


def write_batch(rows: DataFrame, batch_id: int, path: str, partition: str | None = "feed_date") -> None:
    """The rows of a micro-batch as a folder of their own below `path`, once, however often the batch is repeated."""
    folder = f"{path.rstrip('/')}/batch_id={batch_id}"
    if not _whole(rows.sparkSession, folder):
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(partition) if partition in rows.columns else writer).parquet(folder)


def start_kafka(
    messages: DataFrame, servers: str, topic: str, checkpoint: str, every: str = POLL
) -> StreamingQuery:
    """Key and value to a Kafka-compatible topic; needs Spark's Kafka connector on the class path."""
    return (
        messages.select("key", "value")
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )


def normalized(messages: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Valid messages, each entity of a key once per feed instant; later repeats are not seen.

    Two entities may share a key at one instant (several updates for one trip); both stay. A
    repeat is the same entity sent again, so any of its copies will do.
    """
    once = ["key", "entity_id", "feed_ts"]
    valid = messages.where(
        F.col("feed_ts").isNotNull() & F.col("key").isNotNull() & (F.col("entity_type") != "UNKNOWN")
    )
    if not messages.isStreaming:
        return valid.dropDuplicates(once)
    return valid.withWatermark("feed_ts", watermark).dropDuplicatesWithinWatermark(once)


# --- differences of full snapshots --------------------------------------------------------------

_OPEN, _LATE = "__open", "__late"


def _batch_folder(root: str, batch: int, flush: int = 0) -> str:
    return f"{root.rstrip('/')}/batch_id={batch}/flush={flush}"


def _whole(spark: SparkSession, folder: str) -> bool:
    """True if the table in `folder` was written to its end."""
    return files.exists(spark, f"{folder}/_SUCCESS")


class _Deltas:
    """What a stream of snapshots knows between two micro-batches, as tables.

    `state` holds, for each batch, the newest closed snapshot and all records of open ones. An
    instant is open while fewer than `hold` newer ones have been seen: the records of a snapshot may
    come in any number of batches as long as no `hold` newer snapshots come in between.
    """

    def __init__(
        self, keys: Sequence[str], values: Sequence[str], tie: Sequence[str], out: str, state: str, hold: int
    ) -> None:
        if hold < 1:
            raise ValueError("at least the newest instant is open")
        self.keys, self.values, self.tie, self.hold = keys, values, tie, hold
        self.out, self.state = out.rstrip("/"), state.rstrip("/")
        self.columns = [*dict.fromkeys([*keys, "feed_ts", *values, *tie])]

    def known(self, spark: SparkSession, batch: int) -> DataFrame | None:
        for flush in (1, 0):
            folder = _batch_folder(self.state, batch, flush)
            if _whole(spark, folder):
                return spark.read.parquet(folder)
        return None

    def advance(
        self, spark: SparkSession, known: DataFrame | None, fresh: DataFrame, target: tuple[int, int], hold: int
    ) -> None:
        """Closes what `fresh` closes: its differences to `out`, what is left to `state`."""
        out, state = _batch_folder(self.out, *target), _batch_folder(self.state, *target)
        work = _batch_folder(f"{self.state}_work", *target)
        edge = None
        rows = fresh.select(*self.columns)
        if known is not None:
            edge = known.where(f"NOT {_OPEN}").agg(F.max("feed_ts").alias("t")).first()["t"]
            rows = rows.unionByName(known.where(_OPEN).select(*self.columns))
        # records are read and reduced once; all that follows reads what is written here
        latest = F.max_by(F.struct(*self.columns), F.struct(*self.tie)).alias("r")
        rows = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*self.keys, "feed_ts"])]).agg(latest).select("r.*")
        late = F.lit(False) if edge is None else F.col("feed_ts") <= F.lit(edge)
        rows.withColumn(_LATE, late).write.mode("overwrite").parquet(f"{work}/rows")
        rows = spark.read.parquet(f"{work}/rows")

        behind, ahead = rows.where(_LATE).drop(_LATE), rows.where(f"NOT {_LATE}").drop(_LATE)
        if not behind.isEmpty():
            behind.write.mode("overwrite").parquet(_batch_folder(f"{self.out}_late", *target))
        newest = [r[0] for r in ahead.select("feed_ts").distinct().orderBy(F.desc("feed_ts")).limit(hold + 1).collect()]
        closed, opened = ahead, ahead.where(F.lit(False))
        if hold and newest:
            open_from = F.lit(newest[: hold][-1])
            closed, opened = ahead.where(F.col("feed_ts") < open_from), ahead.where(F.col("feed_ts") >= open_from)
        last = None if known is None else known.where(f"NOT {_OPEN}").select(*self.columns)
        together = closed if last is None else last.unionByName(closed)
        snapshot_sequence(together).write.mode("overwrite").parquet(f"{work}/polls")
        found = snapshot_deltas(together, self.keys, self.values, following=spark.read.parquet(f"{work}/polls"))
        if edge is not None:
            found = found.where(F.col("feed_ts") > F.lit(edge))
        found.write.mode("overwrite").parquet(out)

        kept = together.where(F.col("feed_ts") == F.lit(newest[hold] if len(newest) > hold else edge))
        kept = kept.withColumn(_OPEN, F.lit(False)).unionByName(opened.withColumn(_OPEN, F.lit(True)))
        kept.write.mode("overwrite").parquet(state)
        files.remove_folder(spark, f"{self.state}_work")

    def step(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        self.advance(spark, self.known(spark, batch_id - 1), batch, (batch_id, 0), self.hold)
        files.remove_folder(spark, f"{self.state}/batch_id={batch_id - 2}")

    def flush(self, spark: SparkSession) -> None:
        batches = [int(e.name.removeprefix("batch_id=")) for e in files.children(spark, self.state) if e.name.startswith("batch_id=")]
        done = [b for b in batches if _whole(spark, _batch_folder(self.state, b))]
        if done and not _whole(spark, _batch_folder(self.state, max(done), 1)):
            known = spark.read.parquet(_batch_folder(self.state, max(done)))
            self.advance(spark, known, known.where(F.lit(False)), (max(done), 1), 0)


def start_deltas(
    records: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    out: str,
    state: str,
    checkpoint: str,
    tie: Sequence[str],
    every: str | None = POLL,
    hold: int = 1,
) -> StreamingQuery:
    """Differences between consecutive full snapshots of a stream.

    The newest `hold` instants stay open, so a snapshot may be spread over any number of
    micro-batches; it is compared once it is closed by a newer one, or by `flush_deltas`. What is known
    between batches are the last closed snapshot and the open records, as tables. Results and
    state are named by the batch, so a repeated batch writes the same folders again. Only records
    of an instant already compared are late: they are set aside below `<out>_late`, not dropped.
    """
    step = _Deltas(keys, values, tie, out, state, hold).step
    writer = records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    timed = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return timed.start()


def flush_deltas(
    spark: SparkSession, keys: Sequence[str], values: Sequence[str], out: str, state: str, tie: Sequence[str]
) -> None:
    """Closes the instants a stopped `start_deltas` still holds open, as at the end of a day.

    Doing it twice changes nothing. The stream may be started again afterwards; records that still come
    for a flushed instant are then late.
    """
    _Deltas(keys, values, tie, out, state, 1).flush(spark)
