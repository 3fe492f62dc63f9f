"""Every registered query against its SQL, on the smallest given tables."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from transitspark.checks.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict, detail, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert verdict == "ok", detail


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries())


def test_flagship(spark):
    rows = {r["trip_type"]: r["n"] for r in entry.entry(spark).collect()}
    assert rows == {"internal": 53, "crossing": 964}


def test_classes_divide_the_subset(spark):
    q = lambda n: entry.queries()[n](spark, SF)
    ids = lambda n, c: [r[0] for r in q(n).select(c).collect()]
    internal, crossing = ids("internal_trips", "trip_id"), ids("crossing_trips", "trip_id")
    assert not set(internal) & set(crossing)
    assert sorted(internal + crossing) == sorted(ids("subset_trips", "trip_id"))
    parts = [r for n in ("internal_routes", "crossing_routes", "mixed_routes") for r in ids(n, "route_id")]
    assert sorted(parts) == sorted(ids("subset_routes", "route_id"))
    assert set(ids("subset_stop_times", "trip_id")) == set(ids("subset_trip_ids", "trip_id"))
