"""Network graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitspark.checks.registry import query
from transitspark.checks.roles import PREFIX, static_sql, table, tables
from transitspark.functions.clock import clock_seconds
from transitspark.operators import graph, subset

_HOPS = """hops AS (
  SELECT trip_id, stop_id source_stop_id, nxt target_stop_id FROM (
    SELECT trip_id, stop_id, lead(stop_id) OVER (PARTITION BY trip_id ORDER BY stop_sequence, stop_id) nxt FROM stop_times)
  WHERE nxt IS NOT NULL)"""
_EDGES = """edges AS (
  SELECT source_stop_id, target_stop_id, COUNT(DISTINCT route_id) route_count, COUNT(DISTINCT trip_id) trip_count
  FROM hops JOIN trips USING (trip_id) GROUP BY 1, 2)"""
_SERVED = """served AS (SELECT route_id, stop_id, COUNT(*) events FROM stop_times JOIN trips USING (trip_id) GROUP BY 1, 2)"""
_TRAVEL = """timed AS (
  SELECT stop_id source_stop_id, nxt target_stop_id, nxt_arrival - departure_s travel_s FROM (
    SELECT *, lead(stop_id) OVER w nxt, lead(arrival_s) OVER w nxt_arrival FROM stop_seconds
    WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence, stop_id, arrival_s, departure_s)) WHERE nxt IS NOT NULL),
travel AS (SELECT source_stop_id, target_stop_id, COUNT(*) hops, CAST(MIN(travel_s) AS BIGINT) min_travel_s, AVG(travel_s) mean_travel_s
  FROM timed GROUP BY 1, 2)"""
# line items of an order are delivered in no order of time, so this takes the stops of a trip by their arrival
_FORWARD = """onward AS (
  SELECT stop_id source_stop_id, nxt target_stop_id, nxt_arrival - arrival_s travel_s FROM (
    SELECT *, lead(stop_id) OVER w nxt, lead(arrival_s) OVER w nxt_arrival FROM stop_seconds
    WINDOW w AS (PARTITION BY trip_id ORDER BY arrival_s, stop_id)) WHERE nxt IS NOT NULL),
travel AS (SELECT source_stop_id, target_stop_id, CAST(MIN(travel_s) AS BIGINT) min_travel_s FROM onward GROUP BY 1, 2)"""


def _hops(t) -> DataFrame:
    return graph.hops(t["stop_times"], block_size=4)


def _edges(t) -> DataFrame:
    return graph.stop_edges(_hops(t), t["trips"])


def _served(t) -> DataFrame:
    return graph.route_stops(t["stop_times"], t["trips"])


def _travel(t) -> DataFrame:
    timed = t["stop_times"].withColumns(
        {
            "arrival_s": clock_seconds(F.col("arrival_time")),
            "departure_s": clock_seconds(F.col("departure_time")),
        }
    )
    return graph.edge_travel_times(graph.hops(timed, times=("arrival_s", "departure_s"), block_size=4))


def _first_stop(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.min("stop_id").alias("stop_id"))


@query("graph_nodes", static_sql("SELECT DISTINCT stop_id, stop_name, stop_lat latitude, stop_lon longitude FROM stops"))
def graph_nodes(spark, sf):
    return graph.graph_nodes(tables(spark, sf)["stops"])


@query(
    "graph_hops",
    static_sql("SELECT source_stop_id, target_stop_id, COUNT(*) hops FROM hops GROUP BY 1, 2", _HOPS),
)
def graph_hops(spark, sf):
    pairs = _hops(tables(spark, sf))
    return pairs.groupBy("source_stop_id", "target_stop_id").agg(F.sum("hops").alias("hops"))


@query("graph_edges", static_sql("SELECT * FROM edges", _HOPS, _EDGES))
def graph_edges(spark, sf):
    return _edges(tables(spark, sf))


@query(
    "station_edges",
    static_sql(
        "SELECT source_stop_id, target_stop_id, COUNT(DISTINCT route_id) route_count, COUNT(DISTINCT trip_id) trip_count FROM ("
        "SELECT trip_id, station source_stop_id, lead(station) OVER (PARTITION BY trip_id ORDER BY stop_sequence, station) target_stop_id FROM ("
        "SELECT trip_id, stop_sequence, COALESCE(parent_station, stop_id) station FROM stop_times LEFT JOIN stops USING (stop_id))) "
        "JOIN trips USING (trip_id) WHERE source_stop_id <> target_stop_id GROUP BY 1, 2"
    ),
)
def station_edges(spark, sf):
    t = tables(spark, sf)
    return graph.station_edges(t["stop_times"], t["stops"], t["trips"])


@query(
    "transfer_hubs",
    static_sql("SELECT stop_id, COUNT(*) route_count, COUNT(*) * (COUNT(*) - 1) // 2 transfer_pairs FROM served GROUP BY stop_id", _SERVED),
)
def transfer_hubs(spark, sf):
    return graph.transfer_hubs(_served(tables(spark, sf)))


@query(
    "transfer_neighbours",
    static_sql(
        "SELECT route_id, COUNT(*) shared_stops FROM served WHERE stop_id IN (SELECT stop_id FROM served JOIN busiest USING (route_id)) "
        "AND route_id NOT IN (SELECT route_id FROM busiest) GROUP BY route_id",
        _SERVED,
        "busiest AS (SELECT route_id FROM served GROUP BY route_id ORDER BY SUM(events) DESC, route_id LIMIT 1)",
    ),
)
def transfer_neighbours(spark, sf):
    """Routes one change away from the busiest route."""
    served = _served(tables(spark, sf))
    busiest = served.groupBy("route_id").agg(F.sum("events").alias("n"))
    busiest = busiest.orderBy(F.desc("n"), "route_id").limit(1)
    return graph.transfer_neighbours(served, busiest)


@query(
    "graph_degree",
    static_sql(
        "SELECT stop_id, COUNT(*) FILTER (WHERE o) out_degree, COUNT(*) FILTER (WHERE NOT o) in_degree, COUNT(*) degree FROM ("
        "SELECT source_stop_id stop_id, true o FROM edges UNION ALL SELECT target_stop_id, false FROM edges) GROUP BY stop_id",
        _HOPS,
        _EDGES,
    ),
)
def graph_degree(spark, sf):
    return graph.degrees(_edges(tables(spark, sf)))


_LABELS = """both_ways AS (SELECT source_stop_id a, target_stop_id b FROM {e} UNION SELECT target_stop_id, source_stop_id FROM {e}),
labels(stop_id, component) USING KEY (stop_id) AS (
  SELECT stop_id, stop_id FROM {n}
  UNION
  SELECT b, MIN(l.component) FROM labels l JOIN both_ways ON a = l.stop_id JOIN recurring.labels r ON r.stop_id = b
  WHERE l.component < r.component GROUP BY b)"""


@query(
    "graph_components",
    static_sql("SELECT stop_id, component FROM labels", _HOPS, _EDGES, _LABELS.format(e="edges", n="stops")),
)
def graph_components(spark, sf):
    t = tables(spark, sf)
    return graph.connected_components(t["stops"], _edges(t))


_INTERNAL = """inner_edges AS (SELECT DISTINCT source_stop_id, target_stop_id FROM hops
  JOIN trip_classes USING (trip_id) WHERE trip_type = 'internal')"""


def _internal_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the zone served by internal trips alone: many small ones."""
    found = subset.city_subset(tables(spark, sf), PREFIX)
    return graph.connected_components(found["stops"], graph.hops(found["internal_stop_times"]))


query(
    "internal_components",
    static_sql("SELECT stop_id, component FROM labels", _HOPS, _INTERNAL, _LABELS.format(e="inner_edges", n="zone")),
)(_internal_components)


@query(
    "internal_component_sizes",
    static_sql(
        "SELECT component, COUNT(*) stops FROM labels GROUP BY component",
        _HOPS,
        _INTERNAL,
        _LABELS.format(e="inner_edges", n="zone"),
    ),
)
def internal_component_sizes(spark, sf):
    return graph.component_sizes(_internal_components(spark, sf))


@query(
    "graph_bfs",
    static_sql(
        "SELECT source, stop_id, MIN(hops) hops FROM walk GROUP BY 1, 2",
        _HOPS,
        _EDGES,
        """walk(source, stop_id, hops) USING KEY (stop_id) AS (
          SELECT MIN(stop_id), MIN(stop_id), 0 FROM stops
          UNION
          SELECT ANY_VALUE(w.source), e.target_stop_id, MIN(w.hops) + 1 FROM walk w JOIN edges e ON e.source_stop_id = w.stop_id
          LEFT JOIN recurring.walk r ON r.stop_id = e.target_stop_id WHERE r.stop_id IS NULL GROUP BY e.target_stop_id)""",
    ),
)
def graph_bfs(spark, sf):
    t = tables(spark, sf)
    return graph.shortest_hops(_edges(t), _first_stop(t["stops"]))


@query(
    "edge_travel_times",
    static_sql("SELECT source_stop_id, target_stop_id, hops, min_travel_s, round(mean_travel_s, 6) mean_travel_s FROM travel", _TRAVEL),
)
def edge_travel_times(spark, sf):
    return _travel(tables(spark, sf)).withColumn("mean_travel_s", F.round("mean_travel_s", 6))


_STOP_DELAY = "stop_delay AS (SELECT user_id target_stop_id, AVG(floor(value)) mean_delay_s FROM events GROUP BY 1)"


@query(
    "delayed_travel_times",
    static_sql(
        "SELECT source_stop_id, target_stop_id, hops, min_travel_s, round(mean_travel_s, 6) mean_travel_s, round(mean_delay_s, 6) mean_delay_s, "
        "round(mean_travel_s + COALESCE(mean_delay_s, 0), 6) expected_travel_s FROM travel LEFT JOIN stop_delay USING (target_stop_id)",
        _TRAVEL,
        _STOP_DELAY,
    ),
)
def delayed_travel_times(spark, sf):
    seen = table(spark, sf, "events").select(
        F.col("user_id").alias("stop_id"), F.floor("value").alias("delay_s")
    )
    found = graph.delayed_travel_times(_travel(tables(spark, sf)), seen)
    names = ("mean_travel_s", "mean_delay_s", "expected_travel_s")
    return found.withColumns({c: F.round(c, 6) for c in names})


@query(
    "fastest_times",
    static_sql(
        "SELECT source, stop_id, travel_s FROM ride",
        _FORWARD,
        """ride(source, stop_id, travel_s) USING KEY (stop_id) AS (
          SELECT MIN(stop_id), MIN(stop_id), CAST(0 AS DOUBLE) FROM stops
          UNION
          SELECT ANY_VALUE(w.source), e.target_stop_id, MIN(w.travel_s + e.min_travel_s) FROM ride w JOIN travel e ON e.source_stop_id = w.stop_id
          LEFT JOIN recurring.ride r ON r.stop_id = e.target_stop_id
          WHERE w.travel_s + e.min_travel_s < COALESCE(r.travel_s, 1e18) GROUP BY e.target_stop_id)""",
    ),
)
def fastest_times(spark, sf):
    """Least scheduled travel time from the first stop; trips run by arrival, and stops take no time."""
    t = tables(spark, sf)
    arrival = clock_seconds(F.col("arrival_time"))
    timed = t["stop_times"].withColumn("stop_sequence", arrival)
    onward = graph.hops(timed, times=("stop_sequence", "stop_sequence"), block_size=24 * 3600)
    return graph.shortest_times(graph.edge_travel_times(onward), _first_stop(t["stops"]))
