"""Network summaries and data profiling over a subset (or any set of timetable tables)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitspark.operators.explore import class_counts, labelled_counts
from transitspark.operators.graph import route_stops
from transitspark.operators.sequence import nearest_rank


def network_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of every table."""
    rows = labelled_counts(tables)
    return rows.agg(
        *[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(f"total_{n}") for n in tables]
    )


def service_composition(trips_with_class: DataFrame, routes_with_class: DataFrame) -> DataFrame:
    """Trips and routes per service class."""
    def level(df: DataFrame, column: str, name: str) -> DataFrame:
        return class_counts(df, column).select(
            F.lit(name).alias("level"), F.col(column).alias("service_class"), "n"
        )

    return level(trips_with_class, "trip_type", "trips").unionByName(
        level(routes_with_class, "classification", "routes")
    )


def trips_per(trips: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Trips per route or per service."""
    return trips.groupBy(*by, column).agg(F.count(F.lit(1)).alias("trip_count"))


def agency_summary(
    agencies: DataFrame, routes: DataFrame, trips: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Routes and trips per agency; trips are counted per route before any join."""
    per_route = trips_per(trips, "route_id", by)
    owned = (
        routes.select(*by, "route_id", "agency_id")
        .distinct()
        .join(per_route, [*by, "route_id"], "left")
        .groupBy(*by, "agency_id")
        .agg(
            F.count(F.lit(1)).alias("route_count"),
            F.coalesce(F.sum("trip_count"), F.lit(0)).alias("trip_count"),
        )
    )
    joined = agencies.select(*by, "agency_id", "agency_name").join(
        owned, [*by, "agency_id"], "left"
    )
    return joined.fillna(0, ["route_count", "trip_count"])


def route_summary(
    routes: DataFrame, trips: DataFrame, served: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Trips and distinct stops per route; `served` is `graph.route_stops`."""
    keys = [*by, "route_id"]
    stops = served.groupBy(*keys).agg(F.count(F.lit(1)).alias("stop_count"))
    return (
        routes.select(*keys)
        .distinct()
        .join(trips_per(trips, "route_id", by), keys, "left")
        .join(stops, keys, "left")
        .fillna(0, ["trip_count", "stop_count"])
    )


def route_totals(summary: DataFrame) -> DataFrame:
    """The global row over a route summary."""
    return summary.agg(
        F.count(F.lit(1)).alias("route_count"),
        F.sum("trip_count").alias("trip_count"),
        F.sum("stop_count").alias("stop_count"),
    )


def stop_utilization(stop_times: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stop times per stop."""
    return stop_times.groupBy(*by, "stop_id").agg(F.count(F.lit(1)).alias("stop_events"))


def route_stop_events(stop_times: DataFrame, trips: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stop times per route and stop."""
    return route_stops(stop_times, trips, by)


def agency_route_trips(
    routes: DataFrame, trips: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Trips per agency and route with totals per agency and over all.

    `level` is 0 for a route row, 1 for an agency total, 3 for the grand total. The roll-up
    runs over one row per route.
    """
    per_route = trips_per(trips, "route_id", by)
    owned = per_route.join(
        routes.select(*by, "route_id", "agency_id").distinct(), [*by, "route_id"], "inner"
    )
    sets = owned.rollup("agency_id", "route_id") if not by else owned.groupingSets(
        [[*by, "agency_id", "route_id"], [*by, "agency_id"], [*by]], *by, "agency_id", "route_id"
    )
    return sets.agg(
        F.sum("trip_count").alias("trip_count"),
        (F.grouping("agency_id") * 2 + F.grouping("route_id")).cast("int").alias("level"),
    )


# --- profiling --------------------------------------------------------------------------------


def normal_name(name: Column) -> Column:
    """A name without case, outer blanks and repeated blanks."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def name_variants(table: DataFrame, name: str) -> DataFrame:
    """Names written in more than one way."""
    spelled = table.where(F.col(name).isNotNull()).groupBy(
        normal_name(F.col(name)).alias("normal_name"), F.col(name).alias("spelling")
    ).agg(F.count(F.lit(1)).alias("n"))
    return (
        spelled.groupBy("normal_name")
        .agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("rows"))
        .where(F.col("variants") > 1)
    )


def value_distribution(table: DataFrame, column: str) -> DataFrame:
    """Rows per value, null included."""
    return table.groupBy(F.col(column).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def missing_values(tables: dict[str, DataFrame]) -> DataFrame:
    """Null rows and null share of every column of every table: one aggregate per table."""
    parts = []
    for name, df in tables.items():
        found = F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"))
                for c in df.columns
            ]
        )
        profile = df.agg(F.count(F.lit(1)).alias("rows"), found.alias("found"))
        parts.append(
            profile.select(F.lit(name).alias("table"), "rows", F.explode("found").alias("f")).select(
                "table",
                "f.column",
                "rows",
                "f.nulls",
                F.try_divide(F.col("f.nulls"), F.col("rows")).alias("null_share"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def duplicate_names(stops: DataFrame) -> DataFrame:
    """Stop names used by more than one stop."""
    counted = stops.where(F.col("stop_name").isNotNull()).groupBy("stop_name")
    return counted.agg(F.count(F.lit(1)).alias("stops")).where(F.col("stops") > 1)


def station_structure(stops: DataFrame) -> DataFrame:
    """Stations, platforms, stops on their own, and platforms whose parent is unknown."""
    children = (
        stops.where(F.col("parent_station").isNotNull())
        .groupBy(F.col("parent_station").alias("stop_id"))
        .agg(F.count(F.lit(1)).alias("children"))
    )
    own = stops.select("stop_id", F.col("parent_station").isNotNull().alias("is_child"))
    met = own.join(children, "stop_id", "full_outer")
    known, kids = F.col("is_child").isNotNull(), F.coalesce("children", F.lit(0))
    return met.agg(
        F.count_if(known & (kids > 0)).alias("stations"),
        F.count_if(F.col("is_child")).alias("platforms"),
        F.count_if(known & ~F.col("is_child") & (kids == 0)).alias("single_stops"),
        F.coalesce(F.sum(F.when(~known, kids)), F.lit(0)).alias("orphan_platforms"),
    )


def coordinate_anomalies(stops: DataFrame) -> DataFrame:
    """Stops without a usable position, with the reason."""
    lat, lon = (F.col(c).try_cast("double") for c in ("stop_lat", "stop_lon"))
    reason = (
        F.when(lat.isNull() | lon.isNull(), F.lit("missing"))
        .when((F.abs(lat) > 90) | (F.abs(lon) > 180), F.lit("out of range"))
        .when((lat == 0) & (lon == 0), F.lit("null island"))
    )
    return stops.select("stop_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def stop_count_fences(trip_lengths: DataFrame, factor: float = 1.5) -> DataFrame:
    """Quartiles of stops per trip and the fences `factor` interquartile ranges beyond them."""
    q = nearest_rank(trip_lengths, [], "total_stops", {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    return q.select(
        "q1",
        "q3",
        (F.col("q1") - spread * factor).alias("low"),
        (F.col("q3") + spread * factor).alias("high"),
    )


def outlier_trips(trip_lengths: DataFrame, factor: float = 1.5) -> DataFrame:
    """Trips with unusually few or many stops. The two fences are read to the driver."""
    fences = stop_count_fences(trip_lengths, factor).first()
    if fences is None or fences["low"] is None:
        return trip_lengths.where(F.lit(False))
    low, high = float(fences["low"]), float(fences["high"])
    return trip_lengths.where((F.col("total_stops") < low) | (F.col("total_stops") > high))
