"""Graph operators against plain Python on random graphs, one with a dominating hub."""

import heapq
import random

import pytest
from conftest import frame, values
from pyspark.sql import functions as F

from transitspark.operators import graph


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(3)
    found = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    found += [(5, rng.randrange(300)) for _ in range(90)]  # the hub
    return sorted(set(found + [(400 + i, 401 + i) for i in range(40)]))  # and a long chain


def edge_frame(spark, edges):
    return frame(spark, "source_stop_id bigint, target_stop_id bigint", edges)


def test_components(spark, edges):
    parent = list(range(500))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    nodes = spark.range(500).select(F.col("id").alias("stop_id"))
    got = {r["stop_id"]: r["component"] for r in graph.connected_components(nodes, edge_frame(spark, edges)).collect()}
    assert got == {i: root(i) for i in range(500)}


def test_components_without_edges(spark):
    nodes = frame(spark, "stop_id bigint", [(1,), (2,)])
    assert values(graph.connected_components(nodes, edge_frame(spark, [(1, 1)]))) == [(1, 1), (2, 2)]


def distances(edges, start):
    best, heap = {}, [(0, start)]
    while heap:
        d, x = heapq.heappop(heap)
        if x in best:
            continue
        best[x] = d
        for a, b, w in edges:
            if a == x and b not in best:
                heapq.heappush(heap, (d + w, b))
    return best


def test_hops_and_times(spark, edges):
    rng = random.Random(4)
    weighted = [(a, b, rng.randint(0, 50)) for a, b in edges]
    sources = frame(spark, "stop_id bigint", [(5,), (400,), (999,)])
    got = {(r["source"], r["stop_id"]): r["hops"] for r in graph.shortest_hops(edge_frame(spark, edges), sources).collect()}
    assert got == {(s, x): d for s in (5, 400, 999) for x, d in distances([(a, b, 1) for a, b in edges], s).items()}
    travel = frame(spark, "source_stop_id bigint, target_stop_id bigint, min_travel_s bigint", weighted)
    some = frame(spark, "stop_id bigint", [(5,)])
    got = {r["stop_id"]: r["travel_s"] for r in graph.shortest_times(travel, some).collect()}
    assert got == distances(weighted, 5)


def test_negative_weights_are_refused(spark):
    travel = frame(spark, "source_stop_id bigint, target_stop_id bigint, min_travel_s bigint", [(1, 2, -1)])
    with pytest.raises(ValueError):
        graph.shortest_times(travel, frame(spark, "stop_id bigint", [(1,)]))


TIMES = [("a", 1, 10), ("a", 2, 20), ("a", 3, 20), ("a", 4, 10), ("b", 1, 10), ("b", 900, 20), ("b", 900, 20), ("c", 1, 7)]


@pytest.mark.parametrize("block", [1, 2, 512])
def test_consecutive_stops(spark, block):
    times = frame(spark, "trip_id string, stop_sequence int, stop_id int", TIMES)
    pairs = graph.hops(times, block_size=block)
    assert values(pairs) == sorted([("a", 10, 20, 1), ("a", 20, 20, 1), ("a", 20, 10, 1), ("b", 10, 20, 1), ("b", 20, 20, 1)], key=str)
    trips = frame(spark, "trip_id string, route_id string", [("a", "R"), ("b", "R")])
    assert values(graph.stop_edges(pairs, trips)) == [(10, 20, 1, 2), (20, 10, 1, 1), (20, 20, 1, 2)]


def test_travel_times_of_repeated_rows(spark):
    rows = [("a", 1, 10, 0, 5)] * 3 + [("a", 2, 20, 65, 70)]
    times = frame(spark, "trip_id string, stop_sequence int, stop_id int, arr int, dep int", rows)
    found = graph.edge_travel_times(graph.hops(times, times=("arr", "dep")))
    assert values(found) == [(10, 10, 2, -5, -5.0), (10, 20, 1, 60, 60.0)]
    delays = frame(spark, "stop_id int, delay_s int", [(20, 10), (20, 20)])
    assert values(graph.delayed_travel_times(found, delays), "target_stop_id", "expected_travel_s") == [(10, -5.0), (20, 75.0)]


def test_stations(spark):
    stops = frame(spark, "stop_id int, parent_station int", [(10, 1), (20, 1), (7, None)])
    times = frame(spark, "trip_id string, stop_sequence int, stop_id int", [("a", 1, 10), ("a", 2, 20), ("a", 3, 7)])
    trips = frame(spark, "trip_id string, route_id string", [("a", "R")])
    assert values(graph.station_edges(times, stops, trips)) == [(1, 7, 1, 1)]


def test_transfers_and_degree(spark):
    served = frame(spark, "route_id string, stop_id int, events int", [("A", 1, 1), ("B", 1, 1), ("C", 1, 1), ("B", 2, 1), ("D", 2, 1), ("A", 3, 1), ("B", 3, 1)])
    assert values(graph.transfer_hubs(served)) == [(1, 3, 3), (2, 2, 1), (3, 2, 1)]
    start = frame(spark, "route_id string", [("A",)])
    assert values(graph.transfer_neighbours(served, start)) == [("B", 2), ("C", 1)]
    assert values(graph.degrees(edge_frame(spark, [(1, 2), (1, 3), (2, 2)]))) == [(1, 2, 0, 2), (2, 1, 2, 3), (3, 0, 1, 1)]


def test_text_sequences_order_as_numbers(spark):
    rows = [("T", f"S{i:02}", str(i)) for i in range(1, 13)]
    found = graph.hops(spark.createDataFrame(rows, "trip_id string, stop_id string, stop_sequence string"))
    pairs = {(r["source_stop_id"], r["target_stop_id"]) for r in found.collect()}
    assert pairs == {(f"S{i:02}", f"S{i + 1:02}") for i in range(1, 12)}


def test_a_trip_of_several_routes_counts_once(spark):
    pairs = frame(spark, "trip_id string, source_stop_id string, target_stop_id string, hops int", [("t", "a", "b", 1), ("t", "a", "b", 2), ("u", "a", "b", 1), ("v", "a", "b", 1), ("gone", "a", "b", 1)])
    trips = frame(spark, "trip_id string, route_id string", [("t", "r1"), ("t", "r2"), ("t", "r1"), ("u", "r1"), ("v", None)])
    edge = graph.stop_edges(pairs, trips).first()
    assert (edge["route_count"], edge["trip_count"]) == (2, 3)


def test_the_clock_may_be_the_order(spark):
    times = frame(spark, "trip_id string, stop_id int, stop_sequence bigint", [("a", 1, 50), ("a", 2, 10), ("a", 3, 100_000), ("b", 4, None), ("a", 2, 10)])
    found = graph.hops(times, times=("stop_sequence", "stop_sequence"), block_size=60)
    assert values(found) == sorted([("a", 2, 2, 1, 0), ("a", 2, 1, 1, 40), ("a", 1, 3, 1, 99_950)], key=str)


def test_equal_times_and_later_shortcuts(spark):
    chain = [(i, i + 1, 1) for i in range(1, 30)] + [(1, i, 100 - 2 * i) for i in range(2, 31)] + [(30, 1, 0), (5, 5, 0)]
    travel = frame(spark, "source_stop_id bigint, target_stop_id bigint, min_travel_s bigint", chain)
    got = {r["stop_id"]: r["travel_s"] for r in graph.shortest_times(travel, frame(spark, "stop_id bigint", [(1,)])).collect()}
    assert got == distances(chain, 1)
