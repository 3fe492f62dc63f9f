"""Transit roles over the driver's star-schema tables, in Spark and as SQL common table expressions.

The given tables hold no timetable, so each query first renames them: parts are stops, orders are
trips, line items are stop times, events are realtime entities. Both forms say the same.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PREFIX = "Brand#2"
# the box used for positions between stops: south, west, north, east
BOX = (47.30, 8.50, 47.35, 8.52)


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once, not by every query."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _clock(seconds):
    hours = F.expr(f"lpad(cast(({seconds}) div 3600 as string), 2, '0')")
    minutes = F.expr(f"lpad(cast((({seconds}) div 60) % 60 as string), 2, '0')")
    rest = F.expr(f"lpad(cast(({seconds}) % 60 as string), 2, '0')")
    return F.concat_ws(":", hours, minutes, rest)


_ARRIVAL = "(l_linenumber * 3 + 6) * 3600 + cast(l_quantity as bigint) * 60"
_DEPARTURE = f"{_ARRIVAL} + l_suppkey % 60"


class _Roles(Mapping):
    """Timetable tables by role, each built when it is asked for."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self._spark, self._sf = spark, sf
        self._built: dict[str, DataFrame] = {}

    def __iter__(self):
        return iter(_BUILD)

    def __len__(self) -> int:
        return len(_BUILD)

    def __getitem__(self, role: str) -> DataFrame:
        if role not in self._built:
            self._built[role] = _BUILD[role](self._spark, self._sf)
        return self._built[role]


def _agency(spark, sf):
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("agency_id"), F.col("n_name").alias("agency_name")
    )


def _calendar(spark, sf):
    return _trips(spark, sf).select("service_id").distinct()


def _calendar_dates(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("service_id"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("date"),
    ).distinct()


def _frequencies(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("trip_id"), F.col("c_nationkey").alias("headway_min")
    )


def _routes(spark, sf):
    return _trips(spark, sf).select("route_id").distinct().select(
        "route_id",
        F.expr("route_id % 30").alias("agency_id"),
        F.concat(F.lit("R"), F.col("route_id").cast("string")).alias("route_short_name"),
    )


def _stop_times(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("trip_id"),
        F.col("l_partkey").alias("stop_id"),
        F.col("l_linenumber").alias("stop_sequence"),
        _clock(_ARRIVAL).alias("arrival_time"),
        _clock(_DEPARTURE).alias("departure_time"),
    )


def _stops(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("stop_id"),
        F.concat_ws(" ", "p_brand", "p_name").alias("stop_name"),
        F.expr("47.378177D + (p_partkey % 1000 - 500) * 0.0004D").alias("stop_lat"),
        F.expr("8.540192D + (p_partkey % 777 - 388) * 0.0005D").alias("stop_lon"),
        F.when(F.col("p_size") <= 25, F.expr("p_partkey - p_partkey % 10")).alias("parent_station"),
        F.col("p_type").alias("stop_kind"),
    )


def _trips(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("trip_id"),
        F.expr("o_orderkey div 3").alias("route_id"),
        F.col("o_orderpriority").alias("service_id"),
    )


_BUILD = {
    "agency": _agency,
    "calendar": _calendar,
    "calendar_dates": _calendar_dates,
    "frequencies": _frequencies,
    "routes": _routes,
    "stop_times": _stop_times,
    "stops": _stops,
    "trips": _trips,
}


def tables(spark: SparkSession, sf: str) -> Mapping[str, DataFrame]:
    return _Roles(spark, sf)


STATIC_SQL = f"""
agency AS (SELECT CAST(n_nationkey AS BIGINT) agency_id, n_name agency_name FROM nation),
trips AS (SELECT o_orderkey trip_id, o_orderkey // 3 route_id, o_orderpriority service_id FROM orders),
calendar AS (SELECT DISTINCT service_id FROM trips),
calendar_dates AS (SELECT DISTINCT o_orderpriority service_id, strftime(o_orderdate, '%Y%m%d') date FROM orders),
frequencies AS (SELECT c_custkey trip_id, c_nationkey headway_min FROM customer),
routes AS (SELECT DISTINCT route_id, route_id % 30 agency_id, 'R' || route_id route_short_name FROM trips),
stop_seconds AS (
  SELECT l_orderkey trip_id, l_partkey stop_id, l_linenumber stop_sequence,
         (l_linenumber * 3 + 6) * 3600 + CAST(l_quantity AS BIGINT) * 60 arrival_s,
         (l_linenumber * 3 + 6) * 3600 + CAST(l_quantity AS BIGINT) * 60 + l_suppkey % 60 departure_s
  FROM lineitem),
stop_times AS (
  SELECT trip_id, stop_id, stop_sequence,
         printf('%02d:%02d:%02d', arrival_s // 3600, (arrival_s // 60) % 60, arrival_s % 60) arrival_time,
         printf('%02d:%02d:%02d', departure_s // 3600, (departure_s // 60) % 60, departure_s % 60) departure_time
  FROM stop_seconds),
stops AS (
  SELECT p_partkey stop_id, p_brand || ' ' || p_name stop_name,
         47.378177::DOUBLE + (p_partkey % 1000 - 500) * 0.0004::DOUBLE stop_lat,
         8.540192::DOUBLE + (p_partkey % 777 - 388) * 0.0005::DOUBLE stop_lon,
         CASE WHEN p_size <= 25 THEN p_partkey - p_partkey % 10 END parent_station,
         p_type stop_kind
  FROM part),
zone AS (SELECT * FROM stops WHERE starts_with(stop_name, '{PREFIX}')),
profile AS (
  SELECT trip_id, COUNT(*) total_stops,
         COUNT(*) FILTER (WHERE stop_id IN (SELECT stop_id FROM zone)) zone_stops
  FROM stop_times GROUP BY trip_id HAVING zone_stops > 0),
trip_classes AS (
  SELECT t.*, CASE WHEN total_stops = zone_stops THEN 'internal' ELSE 'crossing' END trip_type,
         total_stops, zone_stops
  FROM trips t JOIN profile USING (trip_id)),
route_classes AS (
  SELECT route_id, CASE WHEN COUNT(DISTINCT trip_type) = 1 THEN MIN(trip_type) ELSE 'mixed' END classification
  FROM trip_classes GROUP BY route_id),
subset_stop_times AS (SELECT s.* FROM stop_times s WHERE trip_id IN (SELECT trip_id FROM profile))
"""


def static_sql(body: str, *more: str) -> str:
    return f"WITH RECURSIVE {', '.join([STATIC_SQL, *more])} {body}"


# --- realtime ---------------------------------------------------------------------------------

_ENTITY = {
    "header": "struct('2.0' AS gtfs_realtime_version, 0 AS incrementality, hour_s AS timestamp)",
    "id": "cast(event_id AS string)",
    "is_deleted": "CASE WHEN value < 2 THEN true WHEN value >= 4 THEN false END",
    "trip_update": """
CASE WHEN event_type IN ('purchase', 'signup') THEN struct(
  struct(cast(user_id AS string) AS trip_id, cast(user_id % 20 AS string) AS route_id,
         cast(user_id % 2 AS int) AS direction_id, cast(NULL AS string) AS start_time,
         cast(NULL AS string) AS start_date, cast(user_id % 7 AS int) AS schedule_relationship) AS trip,
  cast(NULL AS struct<id:string,label:string,license_plate:string>) AS vehicle,
  array(
    struct(1 AS stop_sequence, cast(user_id % 97 AS string) AS stop_id,
           struct(whole - 20 AS delay, sec + 60 AS time, cast(NULL AS int) AS uncertainty) AS arrival,
           cast(NULL AS struct<delay:int,time:bigint,uncertainty:int>) AS departure,
           0 AS schedule_relationship),
    struct(4 AS stop_sequence, cast((user_id + 1) % 97 AS string) AS stop_id,
           cast(NULL AS struct<delay:int,time:bigint,uncertainty:int>) AS arrival,
           struct(whole - 30 AS delay, sec + 360 AS time, cast(NULL AS int) AS uncertainty) AS departure,
           cast(whole % 4 AS int) AS schedule_relationship)) AS stop_time_update,
  sec AS timestamp,
  CASE WHEN value < 40 THEN whole - 10 END AS delay) END
""",
    "vehicle": """
CASE WHEN event_type IN ('view', 'click') THEN struct(
  struct(cast(user_id AS string) AS trip_id,
         CASE WHEN event_type = 'view' THEN cast(user_id % 20 AS string) END AS route_id,
         cast(NULL AS int) AS direction_id, cast(NULL AS string) AS start_time,
         cast(NULL AS string) AS start_date, cast(NULL AS int) AS schedule_relationship) AS trip,
  struct(CASE WHEN value < 60 THEN concat('v', user_id) END AS id,
         concat('L', user_id % 15) AS label, cast(NULL AS string) AS license_plate) AS vehicle,
  struct(cast(47.3D + value / 1000 AS float) AS latitude, cast(8.5D + value / 2000 AS float) AS longitude,
         cast(whole AS float) AS bearing, cast(NULL AS double) AS odometer,
         cast(value / 10 AS float) AS speed) AS position,
  1 AS current_stop_sequence,
  cast(user_id % 97 AS string) AS stop_id,
  cast(whole % 4 AS int) AS current_status,
  sec AS timestamp,
  cast(whole % 6 AS int) AS congestion_level,
  cast(whole % 8 AS int) AS occupancy_status) END
""",
    "alert": """
CASE WHEN event_type = 'error' THEN struct(
  CASE WHEN value < 30 THEN array(struct(sec AS start, sec + whole * 60 AS end))
       WHEN value < 60 THEN cast(array() AS array<struct<start:bigint,end:bigint>>)
       ELSE array(struct(cast(NULL AS bigint) AS start, sec AS end)) END AS active_period,
  array(struct(cast(NULL AS string) AS agency_id, cast(user_id % 20 AS string) AS route_id,
               cast(NULL AS int) AS route_type,
               cast(NULL AS struct<trip_id:string,route_id:string,direction_id:int,start_time:string,
                    start_date:string,schedule_relationship:int>) AS trip,
               cast(NULL AS string) AS stop_id),
        struct(cast(NULL AS string) AS agency_id, cast(NULL AS string) AS route_id,
               cast(NULL AS int) AS route_type,
               cast(NULL AS struct<trip_id:string,route_id:string,direction_id:int,start_time:string,
                    start_date:string,schedule_relationship:int>) AS trip,
               cast(user_id % 97 AS string) AS stop_id)) AS informed_entity,
  cast(1 + user_id % 14 AS int) AS cause,
  cast(1 + user_id % 10 AS int) AS effect,
  cast(NULL AS struct<translation:array<struct<text:string,language:string>>>) AS url,
  struct(CASE WHEN value < 50
    THEN array(struct(concat('fr ', event_id) AS text, 'fr' AS language), struct(props AS text, 'en' AS language))
    ELSE array(struct(concat('de ', event_id) AS text, 'de' AS language)) END AS translation) AS header_text,
  cast(NULL AS struct<translation:array<struct<text:string,language:string>>>) AS description_text
) END
""",
}


def feed_rows(events: DataFrame) -> DataFrame:
    """Events (batch or stream) as decoded entities; a snapshot is an hour."""
    instants = events.withColumns(
        {
            "sec": F.expr("unix_micros(cast(ts AS timestamp)) div 1000000"),
            "whole": F.expr("cast(floor(value) AS int)"),
        }
    ).withColumn("hour_s", F.expr("sec - sec % 3600"))
    return instants.select(*[F.expr(text).alias(name) for name, text in _ENTITY.items()])


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return feed_rows(table(spark, sf, "events"))


EVENT_SQL = """
ev AS (
  SELECT *, epoch_us(ts) // 1000000 sec, CAST(floor(value) AS INT) whole,
         (epoch_us(ts) // 1000000) - (epoch_us(ts) // 1000000) % 3600 hour_s,
         CAST(event_id AS VARCHAR) id,
         CASE WHEN event_type IN ('view', 'click') THEN 'VEHICLE_POSITION'
              WHEN event_type IN ('purchase', 'signup') THEN 'TRIP_UPDATE'
              WHEN event_type = 'error' THEN 'ALERT' ELSE 'UNKNOWN' END entity_type,
         CASE WHEN event_type IN ('view', 'click') THEN 'vehicle.' || CASE WHEN value < 60 THEN 'v' || user_id ELSE CAST(event_id AS VARCHAR) END
              WHEN event_type IN ('purchase', 'signup') THEN 'trip.' || user_id
              WHEN event_type = 'error' THEN 'alert.' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 12)
              ELSE 'unknown.' || event_id END AS key
  FROM events),
live AS (SELECT * FROM ev WHERE NOT value < 2),
stop_updates AS (
  SELECT event_id, key, hour_s, sec, CAST(user_id AS VARCHAR) trip_id, CAST(user_id % 20 AS VARCHAR) route_id,
         CASE WHEN value < 40 THEN whole - 10 END trip_delay_s, u.*
  FROM live, LATERAL (
    SELECT 1 stop_sequence, CAST(user_id % 97 AS VARCHAR) stop_id, 'SCHEDULED' relationship,
           whole - 20 arrival_delay_s, CAST(NULL AS INT) departure_delay_s, sec + 60 predicted_s
    UNION ALL
    SELECT 4, CAST((user_id + 1) % 97 AS VARCHAR),
           CASE whole % 4 WHEN 0 THEN 'SCHEDULED' WHEN 1 THEN 'SKIPPED' WHEN 2 THEN 'NO_DATA' END,
           NULL, whole - 30, NULL) u
  WHERE entity_type = 'TRIP_UPDATE')
"""


def event_sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([EVENT_SQL, *more])} {body}"
