import pytest
from conftest import frame, values
from pyspark.sql import functions as F

from transitspark.config import MissingInput
from transitspark.operators.subset import city_subset, classified_trips, trip_profile, zone_stops


def test_artifacts_of_the_small_universe(spark, universe):
    universe["agency"] = frame(spark, "agency_id string, agency_name string", [("A1", "Agency 1"), ("A2", "Agency 2")])
    universe["calendar"] = frame(spark, "service_id string, monday bigint", [("SVC1", 1), ("SVC_UNUSED", 1)])
    found = city_subset(universe)
    assert values(found["stops"], "stop_id") == ["Z1", "Z2"]
    assert values(found["trips"], "trip_id") == ["T_CROSSING", "T_INTERNAL"]
    assert values(found["routes"], "route_id") == ["R1", "R2"]
    assert values(found["internal_trips"], "trip_id") == ["T_INTERNAL"]
    assert values(found["crossing_trips"], "trip_id") == ["T_CROSSING"]
    assert values(found["internal_routes"], "route_id") == ["R1"]
    assert values(found["crossing_routes"], "route_id") == ["R2"]
    assert values(found["mixed_routes"]) == []
    assert values(found["agencies"], "agency_id") == ["A1"]
    assert values(found["calendar"], "service_id") == ["SVC1"]
    assert "frequencies" not in found and "calendar_dates" not in found
    assert values(found["internal_stop_times"], "stop_id") == ["Z1", "Z2"]
    assert found["stop_times"].count() == 4


def test_artifacts_have_the_columns_of_their_source(spark, universe):
    found = city_subset(universe)
    for name in ("trips", "internal_trips", "crossing_trips"):
        assert found[name].columns == universe["trips"].columns
    for name in ("routes", "internal_routes", "crossing_routes", "mixed_routes"):
        assert found[name].columns == universe["routes"].columns
    assert found["crossing_stop_times"].columns == universe["stop_times"].columns


def test_prefix_is_case_sensitive_and_null_is_outside(spark):
    stops = frame(spark, "stop_id string, stop_name string", [("1", "zürich a"), ("2", None), ("3", "Zürich")])
    assert values(zone_stops(stops), "stop_id") == ["3"]
    assert values(zone_stops(stops, "zü"), "stop_id") == ["1"]


def test_a_route_with_both_kinds_of_trips_is_mixed(spark, universe):
    more = frame(spark, "trip_id string, route_id string, service_id string", [("T2", "R1", "SVC1")])
    times = frame(spark, "trip_id string, stop_id string, stop_sequence bigint", [("T2", "Z1", 1), ("T2", "X1", 2)])
    universe["trips"] = universe["trips"].union(more)
    universe["stop_times"] = universe["stop_times"].union(times)
    found = city_subset(universe)
    assert values(found["mixed_routes"], "route_id") == ["R1"]
    assert values(found["internal_routes"]) == []


def test_counts_are_rows_and_duplicate_stops_do_not_multiply(spark, universe):
    twice = universe["stops"].union(universe["stops"])
    again = frame(spark, "trip_id string, stop_id string, stop_sequence bigint", [("T_CROSSING", "Z1", 1), (None, "Z1", 1)])
    profile = trip_profile(universe["stop_times"].union(again), zone_stops(twice))
    assert values(profile) == [(None, 1, 1), ("T_CROSSING", 3, 2), ("T_INTERNAL", 2, 2)]
    assert values(classified_trips(universe["trips"], profile), "trip_id") == ["T_CROSSING", "T_INTERNAL"]


def test_trip_ids_keep_ids_without_a_trip(spark, universe):
    ghost = frame(spark, "trip_id string, stop_id string, stop_sequence bigint", [("GHOST", "Z1", 1)])
    universe["stop_times"] = universe["stop_times"].union(ghost)
    found = city_subset(universe)
    assert "GHOST" in values(found["trip_ids"], "trip_id")
    assert "GHOST" not in values(found["trips"], "trip_id")
    assert "GHOST" in values(found["stop_times"], "trip_id")


def test_versions_do_not_mix(spark, universe):
    """The same ids in two versions, in one of which the crossing trip stays inside."""
    both = {}
    for name, df in universe.items():
        other = df
        if name == "stop_times":
            other = df.withColumn("stop_id", F.when(F.col("stop_id") == "X1", "Z2").otherwise(F.col("stop_id")))
        both[name] = df.withColumn("v", F.lit("a")).union(other.withColumn("v", F.lit("b")))
    found = city_subset(both, by=("v",))
    assert values(found["crossing_trips"], "v", "trip_id") == [("a", "T_CROSSING")]
    assert values(found["internal_trips"], "v", "trip_id") == [("a", "T_INTERNAL"), ("b", "T_CROSSING"), ("b", "T_INTERNAL")]


def test_absent_input_is_named(universe):
    del universe["stops"]
    with pytest.raises(MissingInput, match="stops"):
        city_subset(universe)


def test_one_trip_with_a_third_of_all_rows(spark):
    """Counts stay whole when one trip and one stop dominate."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("trip_id"),
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id")).alias("stop_id"),
    )
    zone = frame(spark, "stop_id bigint", [(0,)])
    row = trip_profile(rows, zone).where("trip_id = 0").first()
    assert (row["total_stops"], row["zone_stops"]) == (10_000, 5_000)
