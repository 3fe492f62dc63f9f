"""Realtime queries: entities, ledger, state, delays, streams."""

from __future__ import annotations

import os
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitspark.checks.registry import query
from transitspark.checks.roles import (
    BOX,
    PREFIX,
    STATIC_SQL,
    entities,
    event_sql,
    feed_rows,
    table,
    tables,
)
from transitspark.functions import feed
from transitspark.operators import delays, realtime, state
from transitspark.operators.subset import zone_stops
from transitspark.plans import archive
from transitspark.plans.realtime import ledger_at
from transitspark.session import scratch_path
from transitspark.streaming import ledger

# half of the month the events cover
AT = 1705276800
AT_SQL = str(AT)


def _named(spark: SparkSession, sf: str) -> DataFrame:
    return realtime.named_model(entities(spark, sf))


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.raw_messages(entities(spark, sf))


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    """Entities read back from the JSON of the ledger."""
    return realtime.ledger_entities(_ledger(spark, sf))


def _seconds(column: str) -> F.Column:
    return F.unix_seconds(F.col(column).cast("timestamp")).alias(column)


@query("rt_entity_type", event_sql("SELECT entity_type, COUNT(*) n FROM ev GROUP BY entity_type"))
def rt_entity_type(spark, sf):
    kind = feed.entity_type(F.col("vehicle"), F.col("trip_update"), F.col("alert"))
    return entities(spark, sf).groupBy(kind.alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


@query("rt_key", event_sql("SELECT id, key FROM ev"))
def rt_key(spark, sf):
    payloads = F.col("vehicle"), F.col("trip_update"), F.col("alert")
    return entities(spark, sf).select("id", feed.entity_key(F.col("id"), *payloads).alias("key"))


@query(
    "rt_messages",
    event_sql("SELECT key, entity_type, id entity_id, hour_s feed_ts, '2.0' feed_version FROM live"),
)
def rt_messages(spark, sf):
    return _ledger(spark, sf).select(
        "key", "entity_type", "entity_id", _seconds("feed_ts"), "feed_version"
    )


@query(
    "rt_envelope",
    event_sql(
        "SELECT id entity_id, entity_type, strftime(make_timestamp(hour_s * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') feed_timestamp, "
        "'2.0' feed_version, CASE entity_type WHEN 'VEHICLE_POSITION' THEN CAST(user_id % 97 AS VARCHAR) END stop_id, "
        "CASE entity_type WHEN 'VEHICLE_POSITION' THEN CASE whole % 4 WHEN 0 THEN 'INCOMING_AT' WHEN 1 THEN 'STOPPED_AT' WHEN 2 THEN 'IN_TRANSIT_TO' END END current_status, "
        "CASE entity_type WHEN 'TRIP_UPDATE' THEN CAST(user_id AS VARCHAR) END trip_id FROM live"
    ),
)
def rt_envelope(spark, sf):
    """Fields read out of the JSON text of each message."""
    value = F.col("value")

    def at(path: str, kind: str | None = None):
        found = F.get_json_object(value, path)
        return F.when(F.col("entity_type") == kind, found) if kind else found

    return _ledger(spark, sf).select(
        at("$.entity_id").alias("entity_id"),
        at("$.entity_type").alias("entity_type"),
        at("$.feed_timestamp").alias("feed_timestamp"),
        at("$.feed_version").alias("feed_version"),
        at("$.payload.stop_id", "VEHICLE_POSITION").alias("stop_id"),
        at("$.payload.current_status", "VEHICLE_POSITION").alias("current_status"),
        at("$.payload.trip.trip_id", "TRIP_UPDATE").alias("trip_id"),
    )


_COUNTS = (
    "COUNT(*) total, COUNT(*) FILTER (WHERE entity_type = 'VEHICLE_POSITION') vehicle_positions, "
    "COUNT(*) FILTER (WHERE entity_type = 'TRIP_UPDATE') trip_updates, "
    "COUNT(*) FILTER (WHERE entity_type = 'ALERT') alerts, CAST(0 AS BIGINT) AS unknown"
)


@query("rt_entity_counts", event_sql(f"SELECT {_COUNTS} FROM ev"))
def rt_entity_counts(spark, sf):
    return realtime.entity_counts(entities(spark, sf))


@query(
    "rt_exploration",
    event_sql(f"SELECT hour_s timestamp_posix, '2.0' gtfs_realtime_version, {_COUNTS} FROM ev GROUP BY hour_s"),
)
def rt_exploration(spark, sf):
    found = realtime.exploration_summary(entities(spark, sf), F.current_timestamp())
    return found.select("header.timestamp_posix", "header.gtfs_realtime_version", "entity_counts.*")


@query(
    "rt_vehicles",
    event_sql(
        "SELECT key, hour_s feed_ts, CASE WHEN value < 60 THEN 'v' || user_id END vehicle_id, 'L' || user_id % 15 vehicle_label, "
        "CAST(user_id AS VARCHAR) trip_id, CASE WHEN event_type = 'view' THEN CAST(user_id % 20 AS VARCHAR) END route_id, "
        "round(CAST(CAST(47.3 + value / 1000 AS FLOAT) AS DOUBLE), 4) latitude, round(CAST(CAST(8.5 + value / 2000 AS FLOAT) AS DOUBLE), 4) longitude, "
        "CAST(whole AS DOUBLE) bearing, round(CAST(CAST(value / 10 AS FLOAT) AS DOUBLE), 3) speed_ms, "
        "CASE whole % 4 WHEN 0 THEN 'INCOMING_AT' WHEN 1 THEN 'STOPPED_AT' WHEN 2 THEN 'IN_TRANSIT_TO' END vehicle_status, "
        "CAST(user_id % 97 AS VARCHAR) current_stop_id, sec observed_at FROM live WHERE entity_type = 'VEHICLE_POSITION'"
    ),
)
def rt_vehicles(spark, sf):
    found = realtime.vehicle_rows(_typed(spark, sf))
    rounded = {"latitude": 4, "longitude": 4, "bearing": 1, "speed_ms": 3}
    return found.withColumns(
        {c: F.round(F.col(c).cast("double"), n) for c, n in rounded.items()}
    ).withColumns({c: _seconds(c) for c in ("feed_ts", "observed_at")})


@query(
    "rt_trip_updates",
    event_sql(
        "SELECT key, hour_s feed_ts, trip_id, route_id, trip_delay_s, stop_sequence, stop_id, relationship schedule_relationship, "
        "arrival_delay_s, departure_delay_s, predicted_s predicted_arrival_at, sec observed_at FROM stop_updates"
    ),
)
def rt_trip_updates(spark, sf):
    found = realtime.trip_update_rows(_typed(spark, sf))
    return found.withColumns(
        {c: _seconds(c) for c in ("feed_ts", "observed_at", "predicted_arrival_at")}
    )


_CAUSES = "CASE 1 + user_id % 14 " + " ".join(
    f"WHEN {code} THEN '{name}'" for code, name in feed.CAUSE.items()
) + " END"
_EFFECTS = "CASE 1 + user_id % 10 " + " ".join(
    f"WHEN {code} THEN '{name}'" for code, name in feed.EFFECT.items()
) + " END"


@query(
    "rt_alerts",
    event_sql(
        f"SELECT id alert_id, key, hour_s feed_ts, {_CAUSES} cause, {_EFFECTS} effect, "
        "CASE WHEN value < 50 THEN props ELSE 'de ' || event_id END summary, CAST(NULL AS VARCHAR) description, "
        "CASE WHEN value < 30 OR value >= 60 THEN CAST(1 AS INT) ELSE 0 END periods, "
        "CAST(user_id % 20 AS VARCHAR) affected_routes, CAST(user_id % 97 AS VARCHAR) affected_stops "
        "FROM live WHERE entity_type = 'ALERT'"
    ),
)
def rt_alerts(spark, sf):
    found = realtime.alert_rows(_typed(spark, sf))
    return found.select(
        "alert_id",
        "key",
        _seconds("feed_ts"),
        "cause",
        "effect",
        "summary",
        "description",
        F.size("active_periods").alias("periods"),
        F.concat_ws(",", "affected_routes").alias("affected_routes"),
        F.concat_ws(",", "affected_stops").alias("affected_stops"),
    )


@query(
    "rt_active_alerts",
    event_sql(
        f"SELECT id alert_id FROM live WHERE entity_type = 'ALERT' AND (value >= 30 AND value < 60 "
        f"OR value < 30 AND sec <= {AT_SQL} AND {AT_SQL} < sec + whole * 60 OR value >= 60 AND {AT_SQL} < sec)"
    ),
)
def rt_active_alerts(spark, sf):
    alerts = realtime.alert_rows(_named(spark, sf), carry=())
    return realtime.active_alerts(alerts, F.lit(AT)).select("alert_id")


# --- state ------------------------------------------------------------------------------------

def _observations(spark: SparkSession, sf: str) -> DataFrame:
    """One observation per event: what was seen, when it was true and when it was known."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("key"),
        F.col("ts").cast("timestamp").alias("feed_ts"),
        (F.col("ts").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.floor("value").cast("int"), F.lit(0))).alias("ingestion_ts"),
        "event_id",
        F.col("event_type").alias("status"),
        F.floor("value").cast("int").alias("delay_s"),
    )


_OBS = """obs AS (SELECT user_id AS key, ts feed_ts, ts + to_minutes(whole) ingestion_ts, event_id,
  event_type status, whole delay_s FROM ev)"""


def _instant() -> F.Column:
    return F.timestamp_seconds(F.lit(AT))


@query(
    "rt_asof_state",
    event_sql(
        f"SELECT key, epoch_us(feed_ts) feed_ts, event_id, status, delay_s FROM obs WHERE feed_ts <= make_timestamp({AT_SQL}000000) "
        "QUALIFY row_number() OVER (PARTITION BY key ORDER BY feed_ts DESC, event_id DESC) = 1",
        _OBS,
    ),
)
def rt_asof_state(spark, sf):
    found = state.state_as_of(
        _observations(spark, sf), ["key"], ["event_id", "status", "delay_s"], _instant(), ["event_id"]
    )
    return found.withColumn("feed_ts", F.unix_micros("feed_ts"))


@query(
    "rt_known_state",
    event_sql(
        f"SELECT key, epoch_us(feed_ts) feed_ts, event_id, status FROM obs WHERE feed_ts <= make_timestamp({AT_SQL}000000) "
        f"AND ingestion_ts <= make_timestamp({AT_SQL}000000) "
        "QUALIFY row_number() OVER (PARTITION BY key ORDER BY feed_ts DESC, event_id DESC) = 1",
        _OBS,
    ),
)
def rt_known_state(spark, sf):
    found = state.state_as_of(
        _observations(spark, sf), ["key"], ["event_id", "status"], _instant(), ["event_id"], _instant()
    )
    return found.withColumn("feed_ts", F.unix_micros("feed_ts"))


@query(
    "rt_asof_join",
    event_sql(
        "SELECT o.event_id, s.event_id AS state_event, s.status, epoch_us(s.feed_ts) state_ts FROM obs o ASOF LEFT JOIN "
        "(SELECT key, feed_ts, arg_max(event_id, event_id) event_id, arg_max(status, event_id) status FROM obs WHERE status <> 'view' GROUP BY 1, 2) s "
        "ON o.key = s.key AND o.ingestion_ts >= s.feed_ts",
        _OBS,
    ),
)
def rt_asof_join(spark, sf):
    """What held for each event's user, views apart, at the instant the event became known."""
    seen = _observations(spark, sf)
    events = seen.select("key", "event_id", F.col("ingestion_ts").alias("event_ts"))
    found = state.state_at_events(events, seen.where("status <> 'view'"), ["key"], ["event_id", "status"], ["event_id"])
    held = F.col("state")
    return found.select("event_id", held["event_id"].alias("state_event"), held["status"].alias("status"), F.unix_micros(held["feed_ts"]).alias("state_ts"))


@query(
    "rt_state_changes",
    event_sql(
        "SELECT key, event_id, status, CASE WHEN p IS NULL THEN 'first' ELSE 'changed' END change, p previous_status FROM ("
        "SELECT *, lag(status) OVER (PARTITION BY key ORDER BY feed_ts, event_id) p FROM obs) WHERE p IS DISTINCT FROM status",
        _OBS,
    ),
)
def rt_state_changes(spark, sf):
    found = state.state_changes(_observations(spark, sf), ["key"], ["status"], ["event_id"])
    return found.select(
        "key", "event_id", "status", "change", F.col("before.status").alias("previous_status")
    )


_SNAP = """snap AS (SELECT CAST(user_id AS VARCHAR) AS key, hour_s, arg_max(event_type, event_id) status FROM ev GROUP BY 1, 2),
seq AS (SELECT hour_s, lead(hour_s) OVER (ORDER BY hour_s) next_s FROM (SELECT DISTINCT hour_s FROM ev)),
moved AS (SELECT key, next_s hour_s, snap.hour_s seen, status FROM snap JOIN seq USING (hour_s) WHERE next_s IS NOT NULL),
deltas AS (SELECT COALESCE(c.key, m.key) AS key, COALESCE(c.hour_s, m.hour_s) feed_ts,
  CASE WHEN m.key IS NULL THEN 'appeared' WHEN c.key IS NULL THEN 'disappeared' ELSE 'changed' END change,
  m.seen previous_ts, m.status before_status, c.status after_status
  FROM snap c FULL JOIN moved m ON c.key = m.key AND c.hour_s = m.hour_s WHERE c.status IS DISTINCT FROM m.status)"""
_DELTAS = event_sql("SELECT * FROM deltas", _SNAP)


def _snapshots(events: DataFrame) -> DataFrame:
    """Status per user and hour: an hour of events plays one full snapshot."""
    return events.select(
        F.col("user_id").cast("string").alias("key"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("feed_ts"),
        "event_id",
        F.col("event_type").alias("status"),
    )


def _flat_deltas(found: DataFrame) -> DataFrame:
    return found.select(
        "key",
        _seconds("feed_ts"),
        "change",
        _seconds("previous_ts"),
        F.col("before.status").alias("before_status"),
        F.col("after.status").alias("after_status"),
    )


@query("rt_snapshot_deltas", _DELTAS)
def rt_snapshot_deltas(spark, sf):
    records = state.deduplicated(
        _snapshots(table(spark, sf, "events")), ["key"], ["status"], ["event_id"]
    )
    return _flat_deltas(state.snapshot_deltas(records, ["key"], ["status"]))


@query(
    "rt_zone_filter",
    event_sql(
        f"SELECT vehicle_key, current_stop_id FROM (SELECT key vehicle_key, CAST(user_id % 97 AS VARCHAR) current_stop_id, "
        "CAST(CAST(47.3 + value / 1000 AS FLOAT) AS DOUBLE) lat, CAST(CAST(8.5 + value / 2000 AS FLOAT) AS DOUBLE) lon FROM live WHERE entity_type = 'VEHICLE_POSITION') "
        f"WHERE current_stop_id IN (SELECT CAST(stop_id AS VARCHAR) FROM zone) "
        f"OR lat BETWEEN {BOX[0]} AND {BOX[2]} AND lon BETWEEN {BOX[1]} AND {BOX[3]}",
        STATIC_SQL,
    ),
)
def rt_zone_filter(spark, sf):
    stops = zone_stops(tables(spark, sf)["stops"], PREFIX).select(F.col("stop_id").cast("string"))
    vehicles = realtime.vehicle_rows(_typed(spark, sf)).withColumns(
        {c: F.col(c).cast("double") for c in ("latitude", "longitude")}
    )
    found = state.zone_filter(vehicles, stops, BOX, stop="current_stop_id")
    return found.select(F.col("key").alias("vehicle_key"), "current_stop_id")


@query(
    "rt_retention",
    event_sql(
        "SELECT key, id entity_id FROM live WHERE CAST(make_timestamp(hour_s * 1000000) AS DATE) > DATE '2024-01-30' - 7"
    ),
)
def rt_retention(spark, sf):
    today = F.lit("2024-01-30").cast("date")
    kept = state.within_retention(_ledger(spark, sf), "transit.snapshots.raw", today)
    return kept.select("key", "entity_id")


@query("rt_ordered_messages", event_sql("SELECT key, id entity_id, hour_s feed_ts FROM live"))
def rt_ordered_messages(spark, sf):
    return realtime.ordered_by_key(_ledger(spark, sf)).select("key", "entity_id", _seconds("feed_ts"))


@query(
    "rt_enriched",
    f"WITH RECURSIVE {STATIC_SQL}, " + event_sql(
        "SELECT u.trip_id, u.stop_sequence, COALESCE(u.route_id, CAST(t.route_id AS VARCHAR)) route_id, r.agency_id, u.stop_id, s.stop_name "
        "FROM (SELECT *, CASE WHEN arrival_delay_s < 0 THEN NULL ELSE rid END route_id FROM "
        "(SELECT trip_id, stop_sequence, stop_id, arrival_delay_s, route_id rid FROM stop_updates)) u "
        "LEFT JOIN trips t ON u.trip_id = CAST(t.trip_id AS VARCHAR) "
        "LEFT JOIN routes r ON COALESCE(u.route_id, CAST(t.route_id AS VARCHAR)) = CAST(r.route_id AS VARCHAR) "
        "LEFT JOIN stops s ON u.stop_id = CAST(s.stop_id AS VARCHAR)"
    )[len("WITH "):],
)
def rt_enriched(spark, sf):
    t = tables(spark, sf)
    trips = t["trips"].select(F.col("trip_id").cast("string"), F.col("route_id").cast("string"))
    routes = t["routes"].select(F.col("route_id").cast("string"), "agency_id")
    stops = t["stops"].select(F.col("stop_id").cast("string"), "stop_name")
    updates = realtime.trip_update_rows(_typed(spark, sf)).withColumn(
        "route_id", F.when(F.coalesce("arrival_delay_s", F.lit(0)) >= 0, F.col("route_id"))
    )
    found = realtime.enriched(updates, trips, routes, stops)
    return found.select("trip_id", "stop_sequence", "route_id", "agency_id", "stop_id", "stop_name")


# --- delays -----------------------------------------------------------------------------------

_WINDOWED = """metrics AS (
  SELECT route_id, hour_s - hour_s % 21600 window_start, COUNT(*) updates, round(AVG(d), 6) mean_delay_s,
         MIN(d) FILTER (WHERE rn >= n * 0.5::DOUBLE) p50_delay_s, MIN(d) FILTER (WHERE rn >= n * 0.95::DOUBLE) p95_delay_s,
         round(COUNT(*) FILTER (WHERE d > 0) / COUNT(*), 6) late_share
  FROM (SELECT *, row_number() OVER (PARTITION BY route_id, hour_s - hour_s % 21600 ORDER BY d) rn,
               COUNT(*) OVER (PARTITION BY route_id, hour_s - hour_s % 21600) n
        FROM (SELECT *, COALESCE(arrival_delay_s, departure_delay_s) d FROM stop_updates) WHERE d IS NOT NULL)
  GROUP BY 1, 2)"""


def _delays(updates: DataFrame) -> DataFrame:
    return updates.withColumn("delay_s", F.coalesce("arrival_delay_s", "departure_delay_s"))


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumns(
        {c: F.round(c, 6) for c in ("mean_delay_s", "late_share")}
    ).withColumn("window_start", F.unix_seconds("window_start"))


@query("rt_window_delay", event_sql("SELECT * FROM metrics", _WINDOWED))
def rt_window_delay(spark, sf):
    updates = _delays(realtime.trip_update_rows(_named_with_time(spark, sf)))
    windowed = delays.in_windows(updates, "6 hours")
    return _rounded(delays.delay_metrics(windowed, ["route_id", "window_start"]))


def _with_time(rows: DataFrame) -> DataFrame:
    """Live entities of the named model with the instant of their header."""
    named = realtime.named_model(rows.where(feed.kept(F.col("is_deleted"))))
    return named.withColumn("feed_ts", F.timestamp_seconds("header.timestamp"))


def _named_with_time(spark: SparkSession, sf: str) -> DataFrame:
    return _with_time(entities(spark, sf))


@query(
    "rt_delay_fill",
    """
    WITH upd AS (SELECT l_orderkey trip_id, l_linenumber stop_sequence, MAX(CAST(l_quantity AS INT)) q FROM lineitem GROUP BY 1, 2),
    marked AS (
      SELECT trip_id, stop_sequence, CASE WHEN q > 30 THEN 'NONE' WHEN q > 25 THEN 'SKIPPED' WHEN q > 20 THEN 'NO_DATA' ELSE 'SCHEDULED' END rel,
             CASE WHEN q <= 15 THEN q * 10 END d, CASE WHEN stop_sequence = 2 AND q <= 30 THEN q END trip_delay FROM upd),
    states AS (SELECT *, COUNT(*) FILTER (WHERE rel IN ('SCHEDULED', 'NO_DATA')) OVER (PARTITION BY trip_id ORDER BY stop_sequence) run,
               MAX(trip_delay) OVER (PARTITION BY trip_id) td FROM marked),
    filled AS (SELECT *, CASE WHEN run = 0 THEN td ELSE
               MAX(CASE WHEN rel = 'SCHEDULED' THEN d END) OVER (PARTITION BY trip_id, run) END f FROM states)
    SELECT trip_id, stop_sequence, CASE WHEN rel = 'SKIPPED' THEN NULL ELSE f END delay_s FROM filled
    """,
)
def rt_delay_fill(spark, sf):
    """Stops with a small quantity carry an update; a mid-sized one skips the stop or has no data."""
    stops = table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("stop_sequence")
    ).agg(F.max(F.col("l_quantity").cast("int")).alias("q"))
    q = F.col("q")
    updates = stops.where(q <= 30).select(
        "trip_id",
        "stop_sequence",
        F.when(q > 25, F.lit("SKIPPED")).when(q > 20, F.lit("NO_DATA")).otherwise(F.lit("SCHEDULED")).alias("schedule_relationship"),
        F.when(q <= 15, q * 10).alias("delay_s"),
        F.when(F.col("stop_sequence") == 2, q).alias("trip_delay_s"),
    )
    return realtime.propagated_delay(stops.select("trip_id", "stop_sequence"), updates, block_size=4)


# --- streams ----------------------------------------------------------------------------------

def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = table(spark, sf, "events").schema
    folder, name = os.path.split(f"{sf}/events.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def _drained(rows: DataFrame, label: str, schema: T.StructType | None = None) -> DataFrame:
    """The stream run to the end of its input into a table, read back."""
    spark = rows.sparkSession
    folder = scratch_path(spark, label)
    run = ledger.start_table(rows, f"{folder}/table", f"{folder}/checkpoint", every=None)
    run.awaitTermination()
    return spark.read.schema(schema or rows.schema).parquet(f"{folder}/table")


@query(
    "rt_stream_ledger",
    event_sql("SELECT key, entity_type, id entity_id, hour_s feed_ts FROM live"),
)
def rt_stream_ledger(spark, sf):
    """The raw ledger written by a stream; one ingestion instant per cycle."""
    table_ = _drained(ledger.raw_messages(feed_rows(_stream(spark, sf))), "ledger")
    return table_.select("key", "entity_type", "entity_id", _seconds("feed_ts"))


@query("rt_stream_normalized", event_sql("SELECT DISTINCT key, id entity_id, hour_s feed_ts FROM live"))
def rt_stream_normalized(spark, sf):
    messages = ledger.raw_messages(feed_rows(_stream(spark, sf)))
    table_ = _drained(ledger.normalized(messages), "normalized")
    return table_.select("key", "entity_id", _seconds("feed_ts"))


@query(
    "rt_bad_lines",
    event_sql("SELECT entity_type = 'VEHICLE_POSITION' AS broken, COUNT(*) n FROM ev GROUP BY entity_type = 'VEHICLE_POSITION'"),
)
def rt_bad_lines(spark, sf):
    """All entities as lines of JSON, those of vehicles cut short: what is published and what is set aside."""
    rows = entities(spark, sf)
    line = F.to_json(F.struct("*"))
    cut = F.when(F.col("vehicle").isNotNull(), F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    folder = scratch_path(spark, "lines")
    rows.withColumn("line", line).select(cut.alias("value")).write.text(folder)
    counts = [
        found.agg(F.count(F.lit(1)).alias("n")).select(F.lit(broken).alias("broken"), "n")
        for broken, found in ((False, ledger.read_entities(spark, folder)), (True, ledger.read_unreadable(spark, folder)))
    ]
    return counts[0].unionByName(counts[1])


@query(
    "rt_stream_window_delay",
    event_sql(
        "SELECT route_id, window_start, updates, mean_delay_s, p50_delay_s, p95_delay_s, late_share FROM metrics "
        "WHERE window_start + 21600 <= (SELECT MAX(hour_s) FROM stop_updates) - 600",
        _WINDOWED,
    ),
)
def rt_stream_window_delay(spark, sf):
    """Closed windows only: a window is written once the watermark has passed its end."""
    updates = _delays(realtime.trip_update_rows(_with_time(feed_rows(_stream(spark, sf)))))
    found = delays.streamed_delay_metrics(updates, ["route_id"], "6 hours", "10 minutes")
    table_ = _rounded(_drained(found, "metrics"))
    return table_.select("route_id", "window_start", "updates", "mean_delay_s", "p50_delay_s", "p95_delay_s", "late_share")


@query("rt_stream_deltas", _DELTAS)
def rt_stream_deltas(spark, sf):
    """The events come in pieces that begin in the middle of an hour, one micro-batch each."""
    folder = scratch_path(spark, "deltas")
    events = table(spark, sf, "events")
    first, last = events.select(F.min("ts"), F.max("ts")).first()
    pieces = 5
    width = (last - first) / pieces
    for i in range(pieces):
        after = F.lit(True) if i == 0 else F.col("ts") >= F.lit(first + i * width)
        until = F.lit(True) if i == pieces - 1 else F.col("ts") < F.lit(first + (i + 1) * width)
        events.where(after & until).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    job = {"keys": ["key"], "values": ["status"], "out": f"{folder}/deltas", "state": f"{folder}/state", "tie": ["event_id"]}
    run = ledger.start_deltas(_snapshots(stream), checkpoint=f"{folder}/checkpoint", every=None, **job)
    run.awaitTermination()
    ledger.flush_deltas(spark, **job)
    return _flat_deltas(spark.read.parquet(f"{folder}/deltas"))


_HELD = event_sql(
    f"SELECT key, entity_type, id entity_id, hour_s feed_ts FROM live WHERE hour_s <= {AT_SQL} "
    "QUALIFY row_number() OVER (PARTITION BY key ORDER BY hour_s DESC, id DESC) = 1"
)


@query("rt_ledger_replay", _HELD)
def rt_ledger_replay(spark, sf):
    """The message of every key that held in the middle of the month."""
    held = ledger_at(_ledger(spark, sf), _instant())
    return held.select("key", "entity_type", "entity_id", _seconds("feed_ts"))


@query("rt_archived_replay", _HELD)
def rt_archived_replay(spark, sf):
    """The same from the archive: the state the expired days left behind, and the days since."""
    root, at = scratch_path(spark, "archive"), datetime.fromtimestamp(AT, timezone.utc).replace(tzinfo=None)
    archive.archive_days(spark, _ledger(spark, sf), root)
    archive.expire(spark, root, date(2024, 1, 20))
    return archive.replay(spark, root, at).select("key", "entity_type", "entity_id", _seconds("feed_ts"))


@query(
    "rt_retention_job",
    event_sql(
        "SELECT key, id entity_id FROM live WHERE CAST(make_timestamp(hour_s * 1000000) AS DATE) > DATE '2024-01-30' - 7"
    ),
)
def rt_retention_job(spark, sf):
    """What is left once the job has taken expired days out, twice."""
    root = scratch_path(spark, "archive")
    archive.archive_days(spark, _ledger(spark, sf), root)
    for _ in range(2):
        archive.expire(spark, root, date(2024, 1, 30))
    return archive.read_days(spark, root).select("key", "entity_id")
