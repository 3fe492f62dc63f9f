"""Stop, station and route graphs from timetables, and their basic metrics."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from transitspark.operators.keys import per_key, unique_keys, with_integer
from transitspark.operators.sequence import block_of, with_neighbour
from transitspark.session import Rounds, rewritten, scratch_path


def graph_nodes(stops: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One node per stop."""
    return stops.select(
        *by,
        "stop_id",
        "stop_name",
        F.col("stop_lat").try_cast("double").alias("latitude"),
        F.col("stop_lon").try_cast("double").alias("longitude"),
    ).distinct()


def hops(
    stop_times: DataFrame,
    by: Sequence[str] = (),
    times: tuple[str, str] | None = None,
    block_size: int = 512,
) -> DataFrame:
    """Consecutive stop pairs per trip: source, target, `hops` (how often).

    `times` names the (arrival, departure) columns in seconds; then `travel_s` from the departure
    at the source to the arrival at the target is added. Equal rows are merged first (map-side)
    and come back as hops of a stop to itself. A trip is split in blocks of `block_size` stop
    sequences, so no trip is sorted in one task however long it is.
    """
    key = [*by, "trip_id"]
    clock = list(times) if times else []
    own = [c for c in dict.fromkeys(clock) if c != "stop_sequence"]
    rows = (
        with_integer(stop_times, "stop_sequence")
        .where(F.col("trip_id").isNotNull())
        .groupBy(*key, "stop_sequence", "stop_id", *own)
        .agg(F.count(F.lit(1)).alias("__copies"))
    )
    values = ["stop_id", clock[0]] if times else ["stop_id"]
    # the copies close the order only so that both sides of the link use one shuffle of `rows`
    paired = with_neighbour(
        rows,
        key,
        ["stop_sequence", "stop_id", *own, "__copies"],
        block_of(F.col("stop_sequence"), block_size),
        values,
        "__next",
    )
    nxt = F.col("__next")
    step = [nxt["stop_id"].alias("target"), F.lit(1).cast("bigint").alias("hops")]
    again = [F.col("stop_id").alias("target"), (F.col("__copies") - 1).alias("hops")]
    if times:
        arrival, departure = (F.col(c) for c in clock)
        step.append((nxt[clock[0]] - departure).alias("travel_s"))
        again.append((arrival - departure).alias("travel_s"))
    found = F.array_compact(
        F.array(
            F.when(nxt.isNotNull(), F.struct(*step)),
            F.when(F.col("__copies") > 1, F.struct(*again)),
        )
    )
    exploded = paired.select(*key, F.col("stop_id").alias("source_stop_id"), F.explode(found).alias("h"))
    extra = [F.col("h.travel_s")] if times else []
    return exploded.select(
        *key, "source_stop_id", F.col("h.target").alias("target_stop_id"), "h.hops", *extra
    )


def stop_edges(pairs: DataFrame, trips: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges of the stop graph with the number of distinct routes and trips using them.

    Counted in steps instead of by two distinct counts, which would double every hop: hops once per
    trip, then per edge and route, then per edge. A trip listed under several routes counts once.
    """
    ends = [*by, "source_stop_id", "target_stop_id"]
    once = pairs.select(*by, "trip_id", "source_stop_id", "target_stop_id").distinct()
    owner = per_key(trips, [*by, "trip_id"], F.collect_set("route_id").alias("__routes"))
    used = once.join(owner, [*by, "trip_id"]).select(*ends, F.posexplode_outer("__routes").alias("__at", "route_id"))
    trip = F.when(F.coalesce("__at", F.lit(0)) == 0, 1).otherwise(0)
    per_route = used.groupBy(*ends, "route_id").agg(F.sum(trip).alias("__trips"))
    return per_route.groupBy(*ends).agg(
        F.count("route_id").alias("route_count"), F.sum("__trips").alias("trip_count")
    )


def to_stations(stop_times: DataFrame, stops: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stop times with every platform replaced by its parent station."""
    station = F.min(F.coalesce("parent_station", "stop_id")).alias("__station")
    parent = per_key(stops, [*by, "stop_id"], station)
    joined = stop_times.join(parent, [*by, "stop_id"], "left")
    return joined.withColumn("stop_id", F.coalesce("__station", "stop_id")).select(*stop_times.columns)


def station_edges(
    stop_times: DataFrame, stops: DataFrame, trips: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Edges between stations; moves inside one station are dropped."""
    pairs = hops(to_stations(stop_times, stops, by), by)
    apart = pairs.where(F.col("source_stop_id") != F.col("target_stop_id"))
    return stop_edges(apart, trips, by)


def edge_travel_times(timed_hops: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scheduled travel time per edge, kept apart from the topology."""
    known = timed_hops.where(F.col("travel_s").isNotNull())
    return known.groupBy(*by, "source_stop_id", "target_stop_id").agg(
        F.sum("hops").alias("hops"),
        F.min("travel_s").cast("bigint").alias("min_travel_s"),
        (F.sum(F.col("travel_s") * F.col("hops")) / F.sum("hops")).alias("mean_travel_s"),
    )


def delayed_travel_times(
    travel: DataFrame, stop_delays: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Travel times plus the mean arrival delay at the target stop (none known = none added).

    `stop_delays`: `stop_id`, `delay_s`.
    """
    at_target = stop_delays.withColumnRenamed("stop_id", "target_stop_id")
    delay = per_key(at_target, [*by, "target_stop_id"], F.avg("delay_s").alias("mean_delay_s"))
    added = travel.join(delay, [*by, "target_stop_id"], "left")
    total = F.col("mean_travel_s") + F.coalesce("mean_delay_s", F.lit(0.0))
    return added.withColumn("expected_travel_s", total).select(
        *travel.columns, "mean_delay_s", "expected_travel_s"
    )


def route_stops(stop_times: DataFrame, trips: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Which route serves which stop, and how many stop times it has there.

    This is the route graph in factored form: two routes are neighbours when they share a stop.
    It has one row per (route, stop); listing the neighbours as pairs would grow with the square
    of the routes at a hub.
    """
    # counted per trip and stop first, so a join sees each pair once
    visits = stop_times.groupBy(*by, "trip_id", "stop_id").agg(F.count(F.lit(1)).alias("__n"))
    owner = trips.select(*by, "trip_id", "route_id")
    return (
        visits.join(owner, [*by, "trip_id"], "inner")
        .groupBy(*by, "route_id", "stop_id")
        .agg(F.sum("__n").alias("events"))
    )


def transfer_hubs(served: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per stop: routes meeting there and how many route pairs can change between them."""
    routes = F.count(F.lit(1))
    return served.groupBy(*by, "stop_id").agg(
        routes.alias("route_count"),
        F.expr("count(1) * (count(1) - 1) div 2").alias("transfer_pairs"),
    )


def transfer_neighbours(served: DataFrame, start: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Routes one change away from any of the `start` routes, with the stops to change at.

    Stop by stop, never pair by pair: stops of the start routes, then the routes there.
    """
    key = [*by, "route_id"]
    chosen = unique_keys(start, key)
    stops = unique_keys(served.join(chosen, key, "left_semi"), [*by, "stop_id"])
    reached = served.join(stops, [*by, "stop_id"], "left_semi")
    return (
        reached.join(chosen, key, "left_anti")
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("shared_stops"))
    )


def degrees(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Outgoing, incoming and total number of edges per node."""
    ends = edges.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("source_stop_id").alias("stop_id"), F.lit(True).alias("out")),
                F.struct(F.col("target_stop_id").alias("stop_id"), F.lit(False).alias("out")),
            )
        ).alias("e"),
    ).select(*by, "e.*")
    return ends.groupBy(*by, "stop_id").agg(
        F.count_if(F.col("out")).alias("out_degree"),
        F.count_if(~F.col("out")).alias("in_degree"),
        F.count(F.lit(1)).alias("degree"),
    )


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Component of every node, named by its smallest member.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
    MapReduce and Beyond", 2014) on links that point from a node to a smaller one: each step
    moves links to the smallest node known, by one min per node and one join, so a hub costs its
    links and never pairs of its neighbours. The number of rounds grows with the logarithm of the
    size. Every round is written to shared storage; two numbers taken while writing tell whether
    it changed anything.

    `nodes`: `stop_id`. `edges`: `source_stop_id`, `target_stop_id`, direction ignored.
    """
    a, b = F.col("a"), F.col("b")
    shape = {
        "links": F.count(F.lit(1)),
        "sum": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
    }
    ends = F.col("source_stop_id"), F.col("target_stop_id")
    first = (
        edges.where(ends[0] != ends[1])
        .select(F.greatest(*ends).alias("a"), F.least(*ends).alias("b"))
        .distinct()
    )
    rounds = Rounds(edges.sparkSession, "components")
    links, seen = rounds.keep(first, **shape)
    before = None
    while seen["links"] and seen != before:
        # large star: whoever is linked to b is linked to the smallest node b knows
        lowest = per_key(links, ["a"], F.min("b").alias("m"))
        onward = lowest.select(F.col("a").alias("b"), "m")
        large = links.join(onward, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        large = large.distinct()
        # small star: a and all it is linked to are linked to the smallest of them
        floor = per_key(large, ["a"], F.min("b").alias("m"))
        moved = F.array(
            F.struct(b.alias("a"), F.col("m").alias("b")), F.struct(a.alias("a"), F.col("m").alias("b"))
        )
        small = large.join(floor, "a").select(F.explode(moved).alias("p")).select("p.*")
        before = seen
        links, seen = rounds.keep(small.where(a != b).distinct(), **shape)
    labels = links.select(a.alias("stop_id"), b.alias("component"))
    return (
        nodes.select("stop_id")
        .distinct()
        .join(labels, "stop_id", "left")
        .select("stop_id", F.coalesce("component", "stop_id").alias("component"))
    )


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("stops"))


def shortest_hops(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Fewest hops from each source stop to every stop it reaches (breadth first).

    Only the stops found last are joined with the edges in a round; each round is a new folder of
    one table, so nothing is written twice. A few sources at a time: the result has a row per
    source and reached stop. Runs until nothing new is reached.
    """
    spark = edges.sparkSession
    table = scratch_path(spark, "hops")
    schema = sources.select(
        F.col("stop_id").alias("source"), "stop_id", F.lit(0).alias("hops")
    ).schema
    step = rewritten(edges.select("source_stop_id", "target_stop_id").distinct(), "steps")

    def keep(found: DataFrame, depth: int) -> tuple[DataFrame, int]:
        seen = Observation(f"hops-{depth}")
        folder = f"{table}/hops={depth}"
        found.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(folder)
        return spark.read.schema(found.schema).parquet(folder), seen.get["n"]

    pairs = sources.select(F.col("stop_id").alias("source"), "stop_id").distinct()
    frontier, _ = keep(pairs, 0)
    for depth in itertools.count(1):
        reached = spark.read.schema(schema).parquet(table).select("source", "stop_id")
        out = frontier.join(step, F.col("stop_id") == F.col("source_stop_id"))
        fresh = out.select("source", F.col("target_stop_id").alias("stop_id")).distinct()
        frontier, found = keep(fresh.join(reached, ["source", "stop_id"], "left_anti"), depth)
        if found == 0:
            return spark.read.schema(schema).parquet(table)


def shortest_times(
    travel: DataFrame, sources: DataFrame, weight: str = "min_travel_s"
) -> DataFrame:
    """Least total travel time from each source stop; edges of negative weight are an error.

    Only stops whose time just improved are joined with the edges in a round, so the work falls
    with the number of improvements; ends when none improves. The edges are dealt out by their
    source once and kept, so a round sends the stops to them and never the edges.
    """
    spark = travel.sparkSession
    known = travel.where(F.col(weight).isNotNull()).select(
        "source_stop_id", "target_stop_id", F.col(weight).alias("w")
    )
    step, measured = Rounds(spark, "steps").keep(known, lowest=F.min("w"))
    if measured["lowest"] is not None and measured["lowest"] < 0:
        raise ValueError("shortest_times needs weights that are not negative")
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = step.repartition(dealt, "source_stop_id").sortWithinPartitions("source_stop_id").persist()
    total = F.lit(0).cast("double").alias("total")
    start = sources.select(F.col("stop_id").alias("source"), "stop_id", total).distinct()
    rounds = Rounds(spark, "times")
    best, _ = rounds.keep(start, n=F.count(F.lit(1)))
    improved, measured = best, {"improved": 1}
    while measured["improved"]:
        offer = (
            improved.join(step, F.col("stop_id") == F.col("source_stop_id"))
            .groupBy("source", F.col("target_stop_id").alias("stop_id"))
            .agg(F.min(F.col("total") + F.col("w")).alias("offer"))
        )
        better = F.col("total").isNull() | (F.col("offer") < F.col("total"))
        merged, measured = rounds.keep(
            best.join(offer, ["source", "stop_id"], "full_outer").select(
                "source",
                "stop_id",
                F.least("total", "offer").alias("total"),
                F.coalesce(better, F.lit(False)).alias("better"),
            ),
            improved=F.count_if("better"),
        )
        best = merged.select("source", "stop_id", "total")
        improved = merged.where("better").select("source", "stop_id", "total")
    step.unpersist()
    return best.withColumnRenamed("total", "travel_s")
