"""Timetable queries: subset, classes, rules, exploration, summaries, profiling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitspark.checks.registry import SQL, query
from transitspark.checks.roles import PREFIX, static_sql, table, tables
from transitspark.config import QualityRules
from transitspark.functions.clock import clock_seconds
from transitspark.operators import explore, rules, subset, summaries, typed
from transitspark.operators.graph import route_stops
from transitspark.plans.static import replay_history
from transitspark.session import scratch_path
from transitspark.sources import manifest, members, publish, snapshots

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _profile(t: dict[str, DataFrame]) -> DataFrame:
    return subset.trip_profile(t["stop_times"], subset.zone_stops(t["stops"], PREFIX))


def _trips(t: dict[str, DataFrame]) -> DataFrame:
    return subset.classified_trips(t["trips"], _profile(t))


def _routes(t: dict[str, DataFrame]) -> DataFrame:
    return subset.classified_routes(t["routes"], subset.route_class(_trips(t)))


def _artifact(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return subset.city_subset(tables(spark, sf), PREFIX)[name]

    return run


_ARTIFACTS = {
    "subset_trip_ids": ("trip_ids", "SELECT trip_id FROM profile"),
    "subset_trips": ("trips", "SELECT * FROM trips WHERE trip_id IN (SELECT trip_id FROM profile)"),
    "internal_trips": (
        "internal_trips",
        "SELECT trip_id, route_id, service_id FROM trip_classes WHERE trip_type = 'internal'",
    ),
    "crossing_trips": (
        "crossing_trips",
        "SELECT trip_id, route_id, service_id FROM trip_classes WHERE trip_type = 'crossing'",
    ),
    "subset_routes": (
        "routes", "SELECT * FROM routes WHERE route_id IN (SELECT route_id FROM trip_classes)",
    ),
    "internal_routes": (
        "internal_routes",
        "SELECT r.* FROM routes r JOIN route_classes USING (route_id) WHERE classification = 'internal'",
    ),
    "crossing_routes": (
        "crossing_routes",
        "SELECT r.* FROM routes r JOIN route_classes USING (route_id) WHERE classification = 'crossing'",
    ),
    "mixed_routes": (
        "mixed_routes",
        "SELECT r.* FROM routes r JOIN route_classes USING (route_id) WHERE classification = 'mixed'",
    ),
    "subset_stop_times": ("stop_times", "SELECT * FROM subset_stop_times"),
    "internal_stop_times": (
        "internal_stop_times",
        "SELECT * FROM stop_times WHERE trip_id IN (SELECT trip_id FROM trip_classes WHERE trip_type = 'internal')",
    ),
    "crossing_stop_times": (
        "crossing_stop_times",
        "SELECT * FROM stop_times WHERE trip_id IN (SELECT trip_id FROM trip_classes WHERE trip_type = 'crossing')",
    ),
    "calendar_subset": (
        "calendar", "SELECT * FROM calendar WHERE service_id IN (SELECT service_id FROM trip_classes)",
    ),
    "calendar_dates_subset": (
        "calendar_dates",
        "SELECT * FROM calendar_dates WHERE service_id IN (SELECT service_id FROM trip_classes)",
    ),
    "agency_subset": (
        "agencies",
        "SELECT * FROM agency WHERE agency_id IN (SELECT r.agency_id FROM routes r JOIN route_classes USING (route_id))",
    ),
    "frequencies_subset": (
        "frequencies", "SELECT * FROM frequencies WHERE trip_id IN (SELECT trip_id FROM trip_classes)",
    ),
}
for _name, (_key, _sql) in _ARTIFACTS.items():
    query(_name, static_sql(_sql))(_artifact(_key))


@query("subset_stops", static_sql("SELECT stop_id, stop_name, stop_lat, stop_lon FROM zone"))
def subset_stops(spark, sf):
    stops = subset.zone_stops(tables(spark, sf)["stops"], PREFIX)
    return stops.select("stop_id", "stop_name", "stop_lat", "stop_lon")


@query("trip_class", static_sql("SELECT trip_id, total_stops, zone_stops, trip_type FROM trip_classes"))
def trip_class(spark, sf):
    return _trips(tables(spark, sf)).select("trip_id", "total_stops", "zone_stops", "trip_type")


@query("trip_class_counts", static_sql("SELECT trip_type, COUNT(*) n FROM trip_classes GROUP BY trip_type"))
def trip_class_counts(spark, sf):
    return explore.class_counts(_trips(tables(spark, sf)), "trip_type")


@query("route_class", static_sql("SELECT route_id, classification FROM route_classes"))
def route_class(spark, sf):
    return subset.route_class(_trips(tables(spark, sf)))


@query(
    "route_class_pct",
    static_sql(
        "SELECT classification, COUNT(*) n, round(COUNT(*) / SUM(COUNT(*)) OVER () * 100, 2) pct "
        "FROM route_classes GROUP BY classification"
    ),
)
def route_class_pct(spark, sf):
    return explore.class_shares(_routes(tables(spark, sf)), "classification")


@query(
    "mixed_route_details",
    static_sql(
        "SELECT route_short_name, agency_id, classification FROM (SELECT r.*, classification "
        "FROM routes r JOIN route_classes USING (route_id) WHERE classification = 'mixed' "
        "ORDER BY route_id LIMIT 50)"
    ),
)
def mixed_route_details(spark, sf):
    t = tables(spark, sf)
    details = explore.route_details(subset.route_class(_trips(t)), t["routes"])
    return explore.mixed_routes(details, ["route_short_name", "agency_id"])


# --- rules ------------------------------------------------------------------------------------

_NULLS = ("trip_id", "route_id", "stop_id", "parent_station", "service_id")
# what the fixture must break: parents are not complete, and agencies end before route ids do
_RULES = QualityRules(
    required={
        "stops": ("stop_id", "stop_name", "parent_station", "zone_id"),
        "routes": ("route_id", "agency_id"),
        "trips": ("trip_id", "route_id"),
        "stop_times": ("trip_id", "stop_id", "stop_sequence", "pickup_type", "drop_off_type"),
    },
    bounds={"agency": (1, 10), "stops": (1, 10**9), "routes": (0, 1)},
    foreign_keys=(
        ("trips", "route_id", "routes", "route_id"),
        ("routes", "agency_id", "agency", "agency_id"),
        ("stop_times", "trip_id", "trips", "trip_id"),
        ("stop_times", "trip_id", "frequencies", "trip_id"),
    ),
)


@query(
    "rule_not_null",
    static_sql("SELECT COUNT(*) AS rows, COUNT(*) - COUNT(stop_id) nulls_stop_id, COUNT(*) - COUNT(parent_station) nulls_parent_station FROM stops"),
)
def rule_not_null(spark, sf):
    return rules.column_profile(tables(spark, sf)["stops"], ["stop_id", "parent_station"])


@query(
    "rule_row_count",
    static_sql("SELECT 'agency' AS \"table\", COUNT(*) observed, COUNT(*) || ' rows outside expected [1, 10]' detail FROM agency HAVING NOT COUNT(*) BETWEEN 1 AND 10"),
)
def rule_row_count(spark, sf):
    t = {"agency": tables(spark, sf)["agency"]}
    only = QualityRules(required={}, bounds={"agency": (1, 10)}, foreign_keys=())
    found = rules.quality_report(
        spark, rules.with_version(t, "v"), {"v": {"agency": t["agency"].columns}}, only
    )
    return found.select("table", "observed", "detail")


@query(
    "rule_orphans",
    static_sql("SELECT COUNT(*) orphans FROM routes WHERE agency_id IS NOT NULL AND agency_id NOT IN (SELECT agency_id FROM agency)"),
)
def rule_orphans(spark, sf):
    t = tables(spark, sf)
    return rules.orphan_rows(t["routes"], "agency_id", t["agency"], "agency_id")


@query(
    "rule_orphan_keys",
    static_sql("SELECT trip_id, COUNT(*) child_rows FROM stop_times WHERE trip_id NOT IN (SELECT trip_id FROM frequencies) GROUP BY trip_id"),
)
def rule_orphan_keys(spark, sf):
    t = tables(spark, sf)
    return rules.orphan_keys(t["stop_times"], "trip_id", t["frequencies"], "trip_id")


@query(
    "quality_report",
    static_sql(
        """
        SELECT * FROM (
          SELECT 'agency' AS "table", 'row_count_range' AS "check", CAST(NULL AS VARCHAR) AS "column", COUNT(*) observed,
                 COUNT(*) || ' rows outside expected [1, 10]' detail FROM agency
          UNION ALL SELECT 'routes', 'row_count_range', NULL, COUNT(*), COUNT(*) || ' rows outside expected [0, 1]' FROM routes
          UNION ALL SELECT 'stops', 'required_columns', NULL, 1, 'missing column(s): [''zone_id'']'
          UNION ALL SELECT 'stop_times', 'required_columns', NULL, 2, 'missing column(s): [''pickup_type'', ''drop_off_type'']'
          UNION ALL SELECT 'stops', 'not_null', 'parent_station', COUNT(*), 'parent_station has ' || COUNT(*) || ' null value(s)'
            FROM stops WHERE parent_station IS NULL
          UNION ALL SELECT 'routes', 'referential_integrity', 'agency_id', COUNT(*), COUNT(*) || ' agency_id value(s) not found in agency.agency_id'
            FROM routes WHERE agency_id NOT IN (SELECT agency_id FROM agency)
          UNION ALL SELECT 'stop_times', 'referential_integrity', 'trip_id', COUNT(*), COUNT(*) || ' trip_id value(s) not found in frequencies.trip_id'
            FROM stop_times WHERE trip_id NOT IN (SELECT trip_id FROM frequencies)
          UNION ALL SELECT 'stop_times', 'referential_integrity', 'trip_id', COUNT(*), COUNT(*) || ' trip_id value(s) not found in trips.trip_id'
            FROM stop_times WHERE trip_id NOT IN (SELECT trip_id FROM trips)
        ) WHERE observed > 0
        """
    ),
)
def quality_report(spark, sf):
    t = tables(spark, sf)
    layout = {"v": {name: df.columns for name, df in t.items()}}
    found = rules.quality_report(spark, rules.with_version(t, "v"), layout, _RULES)
    return found.select("table", "check", "column", "observed", "detail")


_REPORT_SQL = SQL["quality_report"]


@query("report_lines", f"SELECT \"table\" || '.' || \"check\" || ': ' || detail AS line FROM ({_REPORT_SQL})")
def report_lines(spark, sf):
    """Each violation as one line of text."""
    t = tables(spark, sf)
    layout = {"v": {name: df.columns for name, df in t.items()}}
    return rules.report_lines(rules.quality_report(spark, rules.with_version(t, "v"), layout, _RULES)).select("line")


@query(
    "gate_versions",
    static_sql(
        "SELECT v snapshot_version FROM (VALUES ('all'), ('placed')) versions(v) "
        "WHERE v = 'placed' OR NOT EXISTS (SELECT 1 FROM stops WHERE parent_station IS NULL)"
    ),
)
def gate_versions(spark, sf):
    """Two versions of the stops, the second without those that break a rule: which of them pass."""
    stops = tables(spark, sf)["stops"]
    versions = {"all": stops, "placed": stops.where("parent_station IS NOT NULL")}
    tagged = [df.withColumn("snapshot_version", F.lit(v)) for v, df in versions.items()]
    layout = {v: {"stops": df.columns} for v, df in versions.items()}
    ruled = QualityRules(required={"stops": ("stop_id", "parent_station")}, bounds={}, foreign_keys=())
    report = rules.quality_report(spark, {"stops": tagged[0].unionByName(tagged[1])}, layout, ruled)
    named = tagged[0].select("snapshot_version").unionByName(tagged[1].select("snapshot_version")).distinct()
    return rules.passed_versions(named, report)


@query(
    "replay_order",
    "SELECT 'feed_2026080' || r_regionkey AS version, row_number() OVER (ORDER BY r_regionkey) AS position, "
    "(SELECT COUNT(*) FROM nation WHERE n_regionkey = r_regionkey) AS rows FROM region",
)
def replay_order(spark, sf):
    """Nations published region by region, newest first, and replayed oldest first with the rows of each artifact."""
    root, nations = scratch_path(spark, "replay"), table(spark, sf, "nation")
    regions = sorted(r[0] for r in table(spark, sf, "region").select("r_regionkey").collect())
    for region in reversed(regions):
        version = f"feed_2026080{region}"
        folder = manifest.new_data(root, version)
        publish.write_artifact(nations.where(F.col("n_regionkey") == region), folder, "nation")
        publish.publish(spark, root, version, folder)
    counted = []
    for position, found in enumerate(snapshots.snapshots(spark, root), start=1):
        counts = publish.artifact_counts(snapshots.load_tables(spark, found))
        counted.append(counts.select(F.lit(found.version).alias("version"), F.lit(position).cast("long").alias("position"), F.col("value").alias("rows")))
    return reduce(DataFrame.unionByName, counted)


_REPLAYED = ("stops", "trips", "routes", "stop_times")


@query(
    "replay_report",
    static_sql(
        "SELECT v snapshot_version, 'rows' AS kind, a.* FROM (VALUES ('feed_20260805'), ('feed_20260819')) versions(v), "
        "(SELECT 'stops' AS name, COUNT(*) AS value FROM zone UNION ALL SELECT 'trips', COUNT(*) FROM trip_classes "
        "UNION ALL SELECT 'routes', COUNT(*) FROM route_classes "
        "UNION ALL SELECT 'stop_times', COUNT(*) FROM stop_times WHERE trip_id IN (SELECT trip_id FROM profile)) a "
        "UNION ALL SELECT 'feed_20260812', 'missing_input', 'stops', 1"
    ),
)
def replay_report(spark, sf):
    """Three versions derived in one pass, the second without stops: what is reported, and what is published."""
    root = scratch_path(spark, "replay")
    for name in (*_REPLAYED, "agency"):
        landed = tables(spark, sf)[name]
        for version in ("feed_20260805", "feed_20260812", "feed_20260819"):
            if (version, name) != ("feed_20260812", "stops"):
                landed = publish.write_artifact(landed, f"{root}/bronze/{version}", name)  # made once, then copied
    lenient = QualityRules(required={}, bounds={}, foreign_keys=())
    report, counts = replay_history(spark, f"{root}/bronze", f"{root}/history", PREFIX, lenient)
    told = report.select("snapshot_version", F.col("check").alias("kind"), F.col("table").alias("name"), F.col("observed").alias("value"))
    made = counts.where(F.col("artifact").isin(*_REPLAYED))
    return told.unionByName(made.select("snapshot_version", F.lit("rows").alias("kind"), F.col("artifact").alias("name"), "value"))


# --- exploration ------------------------------------------------------------------------------

@query(
    "dataset_inventory",
    " UNION ALL ".join(
        f"SELECT '{n}' AS \"table\", (SELECT COUNT(*) FROM {n}) AS rows, "
        f"(SELECT COUNT(*) FROM information_schema.columns WHERE table_name = '{n}') AS columns, "
        f"'{n}.parquet' AS parquet"
        for n in GIVEN
    ),
)
def dataset_inventory(spark, sf):
    folder = snapshots.Snapshot("", sf)
    return explore.dataset_inventory({n: table(spark, sf, n) for n in snapshots.table_paths(spark, folder)})


@query(
    "stop_name_top25",
    static_sql("SELECT stop_name, COUNT(*) stops FROM zone GROUP BY stop_name ORDER BY stops DESC, stop_name LIMIT 25"),
)
def stop_name_top25(spark, sf):
    return explore.most_frequent_names(subset.zone_stops(tables(spark, sf)["stops"], PREFIX))


@query("stop_name_unique", static_sql("SELECT COUNT(*) AS rows, COUNT(DISTINCT stop_name) unique_names FROM zone"))
def stop_name_unique(spark, sf):
    return explore.unique_names(subset.zone_stops(tables(spark, sf)["stops"], PREFIX))


@query("stop_names_sorted", static_sql("SELECT DISTINCT stop_name FROM zone"))
def stop_names_sorted(spark, sf):
    return explore.sorted_names(subset.zone_stops(tables(spark, sf)["stops"], PREFIX))


@query(
    "parent_station_unique",
    static_sql("SELECT COUNT(DISTINCT parent_station) + CAST(MAX(CAST(parent_station IS NULL AS INT)) AS BIGINT) n FROM stops"),
)
def parent_station_unique(spark, sf):
    stops = tables(spark, sf)["stops"]
    return stops.agg(explore.distinct_values(F.col("parent_station")).alias("n"))


@query(
    "universe_metrics",
    static_sql("SELECT 'total_trips' metric, COUNT(DISTINCT trip_id) AS value FROM trips UNION ALL SELECT 'zone_trips', COUNT(*) FROM profile"),
)
def universe_metrics(spark, sf):
    t = tables(spark, sf)
    return explore.universe(t["trips"], _profile(t).select("trip_id"))


@query(
    "feed_vs_subset",
    static_sql(
        "SELECT 'stops' metric, (SELECT COUNT(*) FROM stops) feed_rows, (SELECT COUNT(*) FROM zone) subset_rows "
        "UNION ALL SELECT 'trips', (SELECT COUNT(*) FROM trips), (SELECT COUNT(*) FROM trip_classes) "
        "UNION ALL SELECT 'routes', (SELECT COUNT(*) FROM routes), (SELECT COUNT(*) FROM routes JOIN route_classes USING (route_id))"
    ),
)
def feed_vs_subset(spark, sf):
    t = tables(spark, sf)
    return explore.feed_against_subset(t, subset.city_subset(t, PREFIX))


_DIST = """distances AS (SELECT 2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(
  pow(sin((radians(stop_lat) - radians(47.378177::DOUBLE)) / 2), 2)
  + cos(radians(47.378177::DOUBLE)) * cos(radians(stop_lat)) * pow(sin((radians(stop_lon) - radians(8.540192::DOUBLE)) / 2), 2)))) distance_km,
  stop_id FROM stops)"""


@query("haversine_distance", static_sql("SELECT stop_id, round(distance_km, 6) distance_km FROM distances", _DIST))
def haversine_distance(spark, sf):
    found = explore.with_distance(tables(spark, sf)["stops"])
    return found.select("stop_id", F.round("distance_km", 6).alias("distance_km"))


@query(
    "haversine_radius",
    static_sql(
        "SELECT CAST(r AS BIGINT) radius_km, (SELECT COUNT(*) FROM distances WHERE distance_km <= r) stops "
        "FROM (VALUES (5), (10), (15), (20), (25)) v(r)",
        _DIST,
    ),
)
def haversine_radius(spark, sf):
    return explore.radius_counts(tables(spark, sf)["stops"])


@query(
    "typed_stop_times",
    static_sql("SELECT trip_id, stop_id, stop_sequence, CAST(arrival_s AS BIGINT) arrival_s, CAST(departure_s AS BIGINT) departure_s FROM stop_seconds"),
)
def typed_stop_times(spark, sf):
    return tables(spark, sf)["stop_times"].select(
        "trip_id",
        "stop_id",
        "stop_sequence",
        clock_seconds(F.col("arrival_time")).cast("bigint").alias("arrival_s"),
        clock_seconds(F.col("departure_time")).cast("bigint").alias("departure_s"),
    )


def _landed_times(spark: SparkSession, sf: str) -> DataFrame:
    """Stop times as they are landed, all text, some of it spoilt."""
    times = tables(spark, sf)["stop_times"]
    stop = F.col("stop_id")
    return times.select(
        F.col("trip_id").cast("string").alias("trip_id"),
        stop.cast("string").alias("stop_id"),
        F.when(stop % 11 == 0, F.concat(F.lit("no. "), "stop_sequence")).otherwise(F.concat(F.lit(" "), "stop_sequence")).alias("stop_sequence"),
        F.when(stop % 7 == 0, F.replace("arrival_time", F.lit(":"), F.lit("."))).when(stop % 7 == 1, F.lit("")).otherwise(F.col("arrival_time")).alias("arrival_time"),
        F.col("departure_time"),
    )


@query(
    "typed_timetable",
    static_sql(
        "SELECT CAST(trip_id AS VARCHAR) trip_id, CAST(stop_id AS VARCHAR) stop_id, CASE WHEN stop_id % 11 <> 0 THEN stop_sequence END stop_sequence, "
        "CASE WHEN stop_id % 7 > 1 THEN CAST(arrival_s AS BIGINT) END arrival_time, CAST(departure_s AS BIGINT) departure_time FROM stop_seconds"
    ),
)
def typed_timetable(spark, sf):
    return typed.typed_view(_landed_times(spark, sf), "stop_times")


@query(
    "typed_rejects",
    static_sql(
        "SELECT 'stop_times' AS \"table\", CAST(trip_id AS VARCHAR) trip_id, CAST(stop_id AS VARCHAR) stop_id, 'stop_sequence' AS \"column\", 'integer' AS type, "
        "'no. ' || stop_sequence AS text FROM stop_times WHERE stop_id % 11 = 0 UNION ALL "
        "SELECT 'stop_times', CAST(trip_id AS VARCHAR), CAST(stop_id AS VARCHAR), 'arrival_time', 'clock', replace(arrival_time, ':', '.') "
        "FROM stop_times WHERE stop_id % 7 = 0"
    ),
)
def typed_rejects(spark, sf):
    found = typed.typed_rejects(_landed_times(spark, sf), "stop_times", ["trip_id", "stop_id"])
    return found.select("table", F.col("row_key.trip_id"), F.col("row_key.stop_id"), "column", "type", "text")


# --- summaries --------------------------------------------------------------------------------

@query(
    "network_summary",
    static_sql(
        "SELECT (SELECT COUNT(*) FROM zone) total_stops, (SELECT COUNT(*) FROM trip_classes) total_trips, "
        "(SELECT COUNT(*) FROM routes JOIN route_classes USING (route_id)) total_routes, "
        "(SELECT COUNT(*) FROM agency WHERE agency_id IN (SELECT agency_id FROM routes JOIN route_classes USING (route_id))) total_agencies, "
        "(SELECT COUNT(*) FROM subset_stop_times) total_stop_times"
    ),
)
def network_summary(spark, sf):
    found = subset.city_subset(tables(spark, sf), PREFIX)
    return summaries.network_summary(
        {n: found[n] for n in ("stops", "trips", "routes", "agencies", "stop_times")}
    )


@query(
    "service_composition",
    static_sql(
        "SELECT 'trips' AS level, trip_type service_class, COUNT(*) n FROM trip_classes GROUP BY trip_type "
        "UNION ALL SELECT 'routes', classification, COUNT(*) FROM route_classes GROUP BY classification"
    ),
)
def service_composition(spark, sf):
    t = tables(spark, sf)
    return summaries.service_composition(_trips(t), _routes(t))


@query(
    "agency_summary",
    static_sql(
        "SELECT a.agency_id, agency_name, COUNT(DISTINCT r.route_id) route_count, COUNT(t.trip_id) trip_count "
        "FROM agency a LEFT JOIN routes r USING (agency_id) LEFT JOIN trips t ON t.route_id = r.route_id "
        "GROUP BY a.agency_id, agency_name"
    ),
)
def agency_summary(spark, sf):
    t = tables(spark, sf)
    return summaries.agency_summary(t["agency"], t["routes"], t["trips"])


_ROUTE_SUMMARY = """route_sums AS (
  SELECT r.route_id, COALESCE(n, 0) trip_count, COALESCE(m, 0) stop_count FROM routes r
  LEFT JOIN (SELECT route_id, COUNT(*) n FROM trips GROUP BY route_id) USING (route_id)
  LEFT JOIN (SELECT route_id, COUNT(DISTINCT stop_id) m FROM stop_times JOIN trips USING (trip_id) GROUP BY route_id) USING (route_id))"""


def _route_summary(spark, sf):
    t = tables(spark, sf)
    return summaries.route_summary(t["routes"], t["trips"], route_stops(t["stop_times"], t["trips"]))


query("route_summary", static_sql("SELECT * FROM route_sums", _ROUTE_SUMMARY))(_route_summary)


@query(
    "route_totals",
    static_sql(
        "SELECT COUNT(*) route_count, CAST(SUM(trip_count) AS BIGINT) trip_count, CAST(SUM(stop_count) AS BIGINT) stop_count FROM route_sums",
        _ROUTE_SUMMARY,
    ),
)
def route_totals(spark, sf):
    return summaries.route_totals(_route_summary(spark, sf))


@query("stop_utilization", static_sql("SELECT stop_id, COUNT(*) stop_events FROM stop_times GROUP BY stop_id"))
def stop_utilization(spark, sf):
    return summaries.stop_utilization(tables(spark, sf)["stop_times"])


@query("trip_distribution", static_sql("SELECT route_id, COUNT(*) trip_count FROM trips GROUP BY route_id"))
def trip_distribution(spark, sf):
    return summaries.trips_per(tables(spark, sf)["trips"], "route_id")


@query("trips_per_service", static_sql("SELECT service_id, COUNT(*) trip_count FROM trips GROUP BY service_id"))
def trips_per_service(spark, sf):
    return summaries.trips_per(tables(spark, sf)["trips"], "service_id")


@query(
    "route_stop_events",
    static_sql("SELECT route_id, stop_id, COUNT(*) events FROM stop_times JOIN trips USING (trip_id) GROUP BY route_id, stop_id"),
)
def route_stop_events(spark, sf):
    t = tables(spark, sf)
    return summaries.route_stop_events(t["stop_times"], t["trips"])


@query(
    "agency_route_trips",
    static_sql(
        "SELECT agency_id, route_id, COUNT(*) trip_count, CAST(GROUPING(agency_id) * 2 + GROUPING(route_id) AS INT) AS level "
        "FROM trips JOIN routes USING (route_id) GROUP BY ROLLUP (agency_id, route_id)"
    ),
)
def agency_route_trips(spark, sf):
    t = tables(spark, sf)
    return summaries.agency_route_trips(t["routes"], t["trips"])


# --- profiling --------------------------------------------------------------------------------

@query(
    "profile_name_variants",
    "SELECT lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))) normal_name, COUNT(DISTINCT s) variants, COUNT(*) AS rows "
    "FROM (SELECT CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END s FROM part) GROUP BY 1 HAVING COUNT(DISTINCT s) > 1",
)
def profile_name_variants(spark, sf):
    spelled = table(spark, sf, "part").select(
        F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name")).alias("name")
    )
    return summaries.name_variants(spelled, "name")


@query("profile_stop_kinds", static_sql("SELECT stop_kind AS value, COUNT(*) AS rows FROM stops GROUP BY stop_kind"))
def profile_stop_kinds(spark, sf):
    return summaries.value_distribution(tables(spark, sf)["stops"], "stop_kind")


@query(
    "profile_missing_values",
    static_sql(
        " UNION ALL ".join(
            f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", COUNT(*) AS rows, COUNT(*) - COUNT({c}) nulls, "
            f"round((COUNT(*) - COUNT({c})) / COUNT(*), 6) null_share FROM {t}"
            for t, cols in (
                ("agency", ("agency_id", "agency_name")),
                ("calendar", ("service_id",)),
                ("calendar_dates", ("service_id", "date")),
                ("frequencies", ("trip_id", "headway_min")),
                ("routes", ("route_id", "agency_id", "route_short_name")),
                ("stop_times", ("trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time")),
                ("stops", ("stop_id", "stop_name", "stop_lat", "stop_lon", "parent_station", "stop_kind")),
                ("trips", ("trip_id", "route_id", "service_id")),
            )
            for c in cols
        )
    ),
)
def profile_missing_values(spark, sf):
    t = tables(spark, sf)
    found = summaries.missing_values(dict(t.items()))
    return found.withColumn("null_share", F.round("null_share", 6))


@query(
    "profile_duplicate_names",
    static_sql("SELECT stop_name, COUNT(*) stops FROM stops GROUP BY stop_name HAVING COUNT(*) > 1"),
)
def profile_duplicate_names(spark, sf):
    return summaries.duplicate_names(tables(spark, sf)["stops"])


@query(
    "profile_station_structure",
    static_sql(
        """SELECT COUNT(*) FILTER (WHERE known AND kids > 0) stations, COUNT(*) FILTER (WHERE child) platforms,
        COUNT(*) FILTER (WHERE known AND NOT child AND kids = 0) single_stops,
        CAST(COALESCE(SUM(kids) FILTER (WHERE NOT known), 0) AS BIGINT) orphan_platforms
        FROM (SELECT s.stop_id IS NOT NULL known, s.parent_station IS NOT NULL child, COALESCE(n, 0) kids
              FROM stops s FULL JOIN (SELECT parent_station stop_id, COUNT(*) n FROM stops
                                      WHERE parent_station IS NOT NULL GROUP BY 1) c ON s.stop_id = c.stop_id)"""
    ),
)
def profile_station_structure(spark, sf):
    return summaries.station_structure(tables(spark, sf)["stops"])


@query(
    "profile_coordinate_anomalies",
    "SELECT c_custkey stop_id, CASE WHEN c_acctbal IS NULL THEN 'missing' WHEN abs(c_acctbal / 50) > 90 OR abs(c_nationkey * 10) > 180 "
    "THEN 'out of range' WHEN c_acctbal / 50 = 0 AND c_nationkey = 0 THEN 'null island' END reason FROM customer WHERE reason IS NOT NULL",
)
def profile_coordinate_anomalies(spark, sf):
    placed = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("stop_id"),
        (F.col("c_acctbal") / 50).alias("stop_lat"),
        (F.col("c_nationkey") * 10).alias("stop_lon"),
    )
    return summaries.coordinate_anomalies(placed)


@query(
    "profile_outlier_trips",
    static_sql(
        "SELECT p.* FROM lengths p, fences WHERE total_stops < q1 - 1.5 * (q3 - q1) OR total_stops > q3 + 1.5 * (q3 - q1)",
        "lengths AS (SELECT trip_id, COUNT(*) total_stops FROM stop_times GROUP BY trip_id)",
        "ranked AS (SELECT total_stops, row_number() OVER (ORDER BY total_stops) rn, COUNT(*) OVER () n FROM lengths)",
        "fences AS (SELECT MIN(total_stops) FILTER (WHERE rn >= n * 0.25::DOUBLE) q1, MIN(total_stops) FILTER (WHERE rn >= n * 0.75::DOUBLE) q3 FROM ranked)",
    ),
)
def profile_outlier_trips(spark, sf):
    times = tables(spark, sf)["stop_times"]
    return summaries.outlier_trips(times.groupBy("trip_id").agg(F.count(F.lit(1)).alias("total_stops")))


# --- sources and sinks ------------------------------------------------------------------------

@query(
    "csv_members",
    "SELECT CAST(c_custkey AS VARCHAR) c_custkey, CASE WHEN c_nationkey > 20 THEN 'a \"quoted\", name' ELSE c_name END c_name, "
    "CASE WHEN c_nationkey > 3 THEN c_mktsegment END c_mktsegment FROM customer",
)
def csv_members(spark, sf):
    """The customer table as a CSV member, converted: every column text, blanks null."""
    folder = scratch_path(spark, "members")
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("c_custkey"),
        F.when(F.col("c_nationkey") > 20, F.lit('a "quoted", name')).otherwise(F.col("c_name")).alias("c_name"),
        F.when(F.col("c_nationkey") > 3, F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    rows.write.option("header", True).option("escape", '"').csv(f"{folder}/in/customer.txt")
    text = members.read_member(spark, f"{folder}/in/customer.txt")
    return publish.write_artifact(text, f"{folder}/out", "customer")


@query(
    "csv_line_breaks",
    "SELECT CAST(c_custkey AS VARCHAR) c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || chr(10) || ', \"' || c_mktsegment || chr(10) "
    "WHEN c_custkey % 3 = 1 THEN '5\" ' || c_name ELSE c_name END c_name FROM customer",
)
def csv_line_breaks(spark, sf):
    """The customer table as a CSV member with line breaks, commas and quotes inside its fields."""
    folder = scratch_path(spark, "members")
    key, name = F.col("c_custkey"), F.col("c_name")
    broken = F.concat(name, F.lit('\n, "'), "c_mktsegment", F.lit("\n"))
    rows = table(spark, sf, "customer").select(
        key.cast("string").alias("c_custkey"),
        F.when(key % 3 == 0, broken).when(key % 3 == 1, F.concat(F.lit('5" '), name)).otherwise(name).alias("c_name"),
    )
    rows.write.options(header=True, escape='"', ignoreTrailingWhiteSpace=False).csv(f"{folder}/customer.txt")
    return members.read_member(spark, f"{folder}/customer.txt")


@query("published_subset", static_sql("SELECT route_id, agency_id, route_short_name FROM routes"))
def published_subset(spark, sf):
    """Routes written aside, published under a version, found as the newest and read back."""
    root = scratch_path(spark, "silver")
    for version in ("feed_20260812", "feed_20260805"):
        routes = tables(spark, sf)["routes"]
        folder = manifest.new_data(root, version)
        publish.write_artifact(routes, folder, "routes")
        publish.publish(spark, root, version, folder)
    newest = publish.published_latest(spark, root)
    assert newest == "feed_20260812"
    latest = snapshots.latest_snapshot(spark, root)
    return snapshots.load_tables(spark, latest)["routes"]
