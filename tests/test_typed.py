import datetime

from conftest import frame, values
from pyspark.sql import functions as F

from transitspark.operators import typed
from transitspark.operators.graph import hops
from transitspark.operators.typed import typed_rejects, typed_view

TIMES = [
    ("t", "a", "1", "08:00:00", "08:00:30", "0"), ("t", "b", " 2 ", "25:10:00", "25:10:00", ""), ("t", "c", "x", "8 o'clock", None, "1.5"),
    ("t", "d", "10", "23:59:60", "00:00:00", "9" * 30), ("t", "d", "10", "23:59:60", "00:00:00", "9" * 30), (None, None, None, None, None, None),
]


def landed(spark):
    return frame(spark, "trip_id string, stop_id string, stop_sequence string, arrival_time string, departure_time string, pickup_type string", TIMES)


def test_values_are_read_or_rejected(spark):
    view = typed_view(landed(spark), "stop_times")
    assert dict(view.dtypes) == {"trip_id": "string", "stop_id": "string", "stop_sequence": "bigint", "arrival_time": "bigint", "departure_time": "bigint", "pickup_type": "bigint"}
    assert values(view.where("stop_id IN ('a', 'b')"), "stop_sequence", "arrival_time", "departure_time", "pickup_type") == [(1, 28800, 28830, 0), (2, 90600, 90600, None)]
    bad = typed_rejects(landed(spark), "stop_times", ["trip_id", "stop_id"])
    got = sorted((r["row_key"]["stop_id"], r["column"], r["type"], r["text"]) for r in bad.collect())
    twice = [("d", "arrival_time", "clock", "23:59:60"), ("d", "pickup_type", "integer", "9" * 30)]
    assert got == sorted([("c", "arrival_time", "clock", "8 o'clock"), ("c", "pickup_type", "integer", "1.5"), ("c", "stop_sequence", "integer", "x"), *twice, *twice])
    assert {r["table"] for r in bad.collect()} == {"stop_times"}


def test_days_and_numbers(spark):
    rows = frame(spark, "service_id string, start_date string, end_date string, monday string", [("s", "20260805", "20260231", "1"), ("u", "2026-08-05", "", "true")])
    assert values(typed_view(rows, "calendar"), "start_date", "end_date", "monday") == [(None, None, None), (datetime.date(2026, 8, 5), None, 1)]
    assert values(typed_rejects(rows, "calendar", ["service_id"]), "column", "text") == [("end_date", "20260231"), ("monday", "true"), ("start_date", "2026-08-05")]
    stops = frame(spark, "stop_id string, stop_lat string, stop_lon string", [("a", "47.378", "NaN"), ("b", "1e3", "Infinity"), ("c", "north", None)])
    assert sorted(values(typed_view(stops, "stops").select("stop_id", "stop_lat", "stop_lon"))) == [("a", 47.378, None), ("b", 1000.0, None), ("c", None, None)]
    assert values(typed_rejects(stops, "stops", ["stop_id"]), "text") == ["Infinity", "NaN", "north"]


def test_unknown_tables_and_empty_ones(spark):
    rows = frame(spark, "a string", [("1",)])
    assert typed_view(rows, "notes").dtypes == [("a", "string")] and typed_rejects(rows, "notes", ["a"]).count() == 0
    assert typed_view(landed(spark).limit(0), "stop_times").count() == 0 == typed_rejects(landed(spark).limit(0), "stop_times", ["trip_id"]).count()
    assert set(typed.COLUMN_TYPES["stop_times"].values()) == {"integer", "clock", "number"}


def test_text_sequences_order_hops_as_numbers(spark):
    """Hops of a landed table equal those of its typed view."""
    rows = [("t", s, str(n)) for n, s in enumerate("abcdefghijkl", start=1)]
    text = frame(spark, "trip_id string, stop_id string, stop_sequence string", rows)
    view = typed_view(text, "stop_times")
    want = list(zip("abcdefghijk", "bcdefghijkl"))
    ends = [c for c in hops(view).columns if c.endswith("stop_id")]
    assert values(hops(view).select(*ends)) == values(hops(text).select(*ends)) == want
    assert view.agg(F.max("stop_sequence")).first()[0] == 12
