"""The city subset: stops of a zone, the trips and routes touching them, service classes.

Every function takes `by`: columns (such as a snapshot version) that are part of every key, so
that the same plan works on one snapshot and on a whole history read as one table.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitspark.config import ZONE_PREFIX, need
from transitspark.operators.keys import unique_keys

INTERNAL, CROSSING, MIXED = "internal", "crossing", "mixed"
_MARK = "__in_zone"
TRIP_HELPERS = ("trip_type", "total_stops", "zone_stops")

Stage = Callable[[str, DataFrame], DataFrame]


def zone_stops(stops: DataFrame, prefix: str = ZONE_PREFIX) -> DataFrame:
    """Stops whose name starts with the prefix; a null name is outside."""
    return stops.where(F.col("stop_name").startswith(prefix))


def trip_profile(stop_times: DataFrame, in_zone: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per trip that touches the zone: stop-time rows in all, and rows at zone stops.

    One pass over `stop_times`, two columns wide. The zone side is made unique before the left
    join, since a left join multiplies on duplicates where a semi join would not. Both counts
    combine map-side, so a trip with very many rows costs one row per input split.
    """
    marker = unique_keys(in_zone, [*by, "stop_id"]).withColumn(_MARK, F.lit(True))
    return (
        stop_times.select(*by, "trip_id", "stop_id")
        .join(marker, [*by, "stop_id"], "left")
        .groupBy(*by, "trip_id")
        .agg(
            F.count(F.lit(1)).alias("total_stops"),
            F.count_if(F.col(_MARK)).alias("zone_stops"),
        )
        .where(F.col("zone_stops") > 0)
    )


def trip_class(profile: DataFrame) -> DataFrame:
    """`internal` if every stop-time row lies in the zone, else `crossing`."""
    all_inside = F.col("total_stops") == F.col("zone_stops")
    return profile.withColumn(
        "trip_type", F.when(all_inside, F.lit(INTERNAL)).otherwise(F.lit(CROSSING))
    )


def classified_trips(trips: DataFrame, profile: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trips touching the zone, all source columns plus class and both counts."""
    keys = [*by, "trip_id"]
    joined = trips.join(trip_class(profile), keys, "inner")
    return joined.select(*trips.columns, *TRIP_HELPERS)


def route_class(trips_with_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One class per route; two different trip classes make it `mixed`.

    Counts instead of a collected set: fixed-width buffers that combine map-side.
    """
    counted = trips_with_class.groupBy(*by, "route_id").agg(
        F.count(F.lit(1)).alias("trips"),
        F.count_if(F.col("trip_type") == INTERNAL).alias("inside"),
    )
    kind = (
        F.when(F.col("inside") == F.col("trips"), F.lit(INTERNAL))
        .when(F.col("inside") == 0, F.lit(CROSSING))
        .otherwise(F.lit(MIXED))
    )
    return counted.select(*by, "route_id", kind.alias("classification"))


def classified_routes(routes: DataFrame, classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Routes with at least one trip in the zone, all source columns plus the class."""
    joined = routes.join(classes, [*by, "route_id"], "inner")
    return joined.select(*routes.columns, "classification")


def of_class(df: DataFrame, column: str, value: str | None, like: DataFrame) -> DataFrame:
    """Rows of one class (all if None) with exactly the columns of the source table."""
    picked = df if value is None else df.where(F.col(column) == value)
    return picked.select(*like.columns)


def rows_of(
    table: DataFrame, owners: DataFrame, key: str, by: Sequence[str] = (), unique: bool = False
) -> DataFrame:
    """Rows of `table` whose key occurs in `owners` (semi join).

    A right side that repeats its keys is reduced first, map-side, so that a key holding a large
    share of the owners never lands in one task.
    """
    keys = [*by, key]
    right = owners.select(*keys) if unique else unique_keys(owners, keys)
    return table.join(right, keys, "left_semi").select(*table.columns)


#: What each artifact is derived from: input tables, and artifacts before it.
DERIVED_FROM: dict[str, tuple[str, ...]] = {
    "stops": ("in:stops",),
    "trip_ids": ("in:stop_times", "stops"),
    "trips": ("in:trips", "trip_ids"),
    "internal_trips": ("trips",),
    "crossing_trips": ("trips",),
    "routes": ("in:routes", "trips"),
    "internal_routes": ("routes",),
    "crossing_routes": ("routes",),
    "mixed_routes": ("routes",),
    "stop_times": ("in:stop_times", "trip_ids"),
    "internal_stop_times": ("stop_times", "internal_trips"),
    "crossing_stop_times": ("stop_times", "crossing_trips"),
    "calendar": ("in:calendar", "trips"),
    "calendar_dates": ("in:calendar_dates", "trips"),
    "agencies": ("in:agency", "routes"),
    "frequencies": ("in:frequencies", "trips"),
}


def dependents(table: str) -> list[str]:
    """The artifacts that cannot be made without an input table, directly or not."""
    lost: list[str] = []
    for artifact, sources in DERIVED_FROM.items():  # sources come before what is made of them
        if f"in:{table}" in sources or any(s in lost for s in sources):
            lost.append(artifact)
    return lost


def wanted_inputs(have: Collection[str]) -> dict[str, list[str]]:
    """The columns the subset needs of each table, if these tables are there; optional ones only where present."""
    trips, routes = ["trip_id", "route_id"], ["route_id"]
    if "calendar" in have or "calendar_dates" in have:
        trips.append("service_id")
    if "agency" in have:
        routes.append("agency_id")
    wanted = {"stops": ["stop_id", "stop_name"], "stop_times": ["trip_id", "stop_id"], "trips": trips, "routes": routes}
    optional = {"calendar": "service_id", "calendar_dates": "service_id", "agency": "agency_id", "frequencies": "trip_id"}
    return wanted | {name: [column] for name, column in optional.items() if name in have}


def require_inputs(have: Mapping[str, Sequence[str]], by: Sequence[str] = ()) -> None:
    """A `MissingInput` if the tables, given by their columns, do not hold what the subset needs."""
    for name, columns in wanted_inputs(have).items():
        need(have, name, *by, *columns)


def city_subset(
    tables: dict[str, DataFrame],
    prefix: str = ZONE_PREFIX,
    by: Sequence[str] = (),
    stage: Stage = lambda name, df: df,
) -> dict[str, DataFrame]:
    """All artifacts of the subset, by name; an absent optional table gives no artifact.

    `stage(name, df)` is called on every artifact and on the helpers `_profile`, `_trips` and
    `_routes` in dependency order. A job passes a function that writes and reads back, so each
    step is computed once and later joins see true sizes; the default keeps everything lazy.
    """
    require_inputs({name: df.columns for name, df in tables.items()}, by)
    stops_in, times_in, trips_in, routes_in = (tables[n] for n in ("stops", "stop_times", "trips", "routes"))

    out: dict[str, DataFrame] = {}

    def add(name: str, df: DataFrame) -> DataFrame:
        out[name] = stage(name, df)
        return out[name]

    stops = add("stops", zone_stops(stops_in, prefix))
    profile = stage("_profile", trip_profile(times_in, stops, by))
    add("trip_ids", profile.select(*by, "trip_id"))

    tagged = stage("_trips", classified_trips(trips_in, profile, by))
    trips = add("trips", of_class(tagged, "trip_type", None, trips_in))
    for kind in (INTERNAL, CROSSING):
        add(f"{kind}_trips", of_class(tagged, "trip_type", kind, trips_in))

    ranked = stage("_routes", classified_routes(routes_in, route_class(tagged, by), by))
    routes = add("routes", of_class(ranked, "classification", None, routes_in))
    for kind in (INTERNAL, CROSSING, MIXED):
        add(f"{kind}_routes", of_class(ranked, "classification", kind, routes_in))

    times = add("stop_times", rows_of(times_in, profile, "trip_id", by, unique=True))
    for kind in (INTERNAL, CROSSING):
        # trips of one class are a part of all zone trips, so the small table is enough
        owners = out[f"{kind}_trips"]
        add(f"{kind}_stop_times", rows_of(times, owners, "trip_id", by, unique=True))

    for name in ("calendar", "calendar_dates"):
        if name in tables:
            add(name, rows_of(tables[name], trips, "service_id", by))
    if "agency" in tables:
        add("agencies", rows_of(tables["agency"], routes, "agency_id", by))
    if "frequencies" in tables:
        add("frequencies", rows_of(tables["frequencies"], trips, "trip_id", by, unique=True))
    return out
