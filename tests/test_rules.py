import pytest
from pyspark.sql import functions as F

from transitspark.config import QualityRules
from transitspark.operators.rules import report_lines, report_texts, validate_snapshot

RULES = QualityRules(
    bounds={"stops": (10, 1000), "routes": (5, 50), "trips": (10, 10_000), "stop_times": (10, 100_000)}
)


@pytest.fixture
def tables(spark):
    n = spark.range
    text = lambda c: F.col(c).cast("string")
    return {
        "routes": n(10).select(F.concat(F.lit("R"), text("id")).alias("route_id")),
        "stop_times": n(2000).selectExpr("concat('T', id div 10) trip_id", "concat('S', (id * 7) % 20) stop_id", "id % 10 stop_sequence"),
        "stops": n(20).selectExpr("concat('S', id) stop_id", "concat('Stop ', id) stop_name", "46.5D stop_lat", "7.5D stop_lon"),
        "trips": n(200).selectExpr("concat('T', id) trip_id", "concat('R', id % 10) route_id"),
    }


def found(spark, tables, rules=RULES):
    report = report_lines(validate_snapshot(spark, "v1", tables, rules))
    return [r["line"] for r in report.orderBy("ordinal").collect()]


def test_a_good_snapshot_passes(spark, tables):
    report = validate_snapshot(spark, "v1", tables, RULES)
    assert report.count() == 0 and report_texts(report).count() == 0


def test_missing_column(spark, tables):
    tables["stops"] = tables["stops"].drop("stop_lat", "stop_lon")
    assert found(spark, tables) == ["stops.required_columns: missing column(s): ['stop_lat', 'stop_lon']"]


def test_nulls_are_counted_per_column(spark, tables):
    tables["stops"] = tables["stops"].withColumn("stop_name", F.when(F.col("stop_id") > "S5", F.col("stop_name")))
    assert len(found(spark, tables)) == 1
    assert found(spark, tables)[0].startswith("stops.not_null: stop_name has ")


def test_row_count_bounds_are_inclusive(spark, tables):
    tables["routes"] = tables["routes"].limit(2)
    first = found(spark, tables)
    assert first[0] == "routes.row_count_range: 2 rows outside expected [5, 50]"
    edge = QualityRules(bounds={"stops": (20, 20)}, foreign_keys=())
    assert found(spark, tables, edge) == []


def test_an_empty_table_is_out_of_range(spark, tables):
    tables["routes"] = tables["routes"].where("false")
    assert found(spark, tables)[0] == "routes.row_count_range: 0 rows outside expected [5, 50]"


def test_orphans_are_rows_and_nulls_do_not_count(spark, tables):
    key = F.when(F.col("trip_id").isin("T1", "T2"), F.lit("NOPE")).when(F.col("trip_id") != "T3", F.col("route_id"))
    tables["trips"] = tables["trips"].withColumn("route_id", key)
    assert found(spark, tables) == [
        "trips.not_null: route_id has 1 null value(s)",
        "trips.referential_integrity: 2 route_id value(s) not found in routes.route_id",
    ]


def test_only_present_tables_are_checked(spark, tables):
    assert found(spark, {"trips": tables["trips"]}) == []


def test_order_and_text(spark, tables):
    tables["stops"] = tables["stops"].drop("stop_lat").limit(5)
    report = validate_snapshot(spark, "v1", tables, RULES)
    checks = [(r["table"], r["check"]) for r in report.orderBy("ordinal").collect()]
    assert checks == [
        ("stops", "required_columns"),
        ("stops", "row_count_range"),
        ("stop_times", "referential_integrity"),
    ]
    [told] = report_texts(report).collect()
    assert told["snapshot_version"] == "v1"
    assert told["text"].split("\n  - ") == ["snapshot v1 failed validation:", *found(spark, tables)]


def test_one_hot_orphan_key(spark, tables):
    hot = spark.range(9000).selectExpr("'T0' trip_id", "'GONE' stop_id", "id % 10 stop_sequence")
    tables["stop_times"] = tables["stop_times"].union(hot)
    assert found(spark, tables) == [
        "stop_times.referential_integrity: 9000 stop_id value(s) not found in stops.stop_id"
    ]
