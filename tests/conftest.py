from __future__ import annotations

import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from transitspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", shuffle_partitions=4, memory="4g")


def frame(spark, schema: str, rows):
    return spark.createDataFrame(rows, schema)


def values(df, *columns):
    """Sorted rows as tuples, or plain values for one column."""
    rows = [tuple(r) for r in df.select(*(columns or df.columns)).collect()]
    flat = [r[0] for r in rows] if len(columns) == 1 else rows
    return sorted(flat, key=lambda r: tuple((v is not None, str(v)) for v in (r if isinstance(r, tuple) else (r,))))


@pytest.fixture
def universe(spark):
    """Four stops, three trips: one inside the zone, one crossing, one elsewhere."""
    return {
        "stops": frame(spark, "stop_id string, stop_name string", [("Z1", "Zürich HB"), ("Z2", "Zürich Oerlikon"), ("X1", "Bern"), ("X2", "Basel")]),
        "routes": frame(spark, "route_id string, agency_id string", [("R1", "A1"), ("R2", "A1")]),
        "trips": frame(spark, "trip_id string, route_id string, service_id string", [("T_INTERNAL", "R1", "SVC1"), ("T_CROSSING", "R2", "SVC1"), ("T_IGNORED", "R1", "SVC1")]),
        "stop_times": frame(spark, "trip_id string, stop_id string, stop_sequence bigint", [("T_INTERNAL", "Z1", 1), ("T_INTERNAL", "Z2", 2), ("T_CROSSING", "Z1", 1), ("T_CROSSING", "X1", 2), ("T_IGNORED", "X2", 1)]),
    }
