"""Exploration of a snapshot: inventory, radius, names, class shares."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitspark.config import RADII_KM, ZONE_CENTRE
from transitspark.functions.geo import distance_km
from transitspark.operators.subset import MIXED


def dataset_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per table, largest first. Parquet counts come from the footers."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"),
            "rows",
            F.lit(len(df.columns)).cast("bigint").alias("columns"),
            F.lit(f"{name}.parquet").alias("parquet"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted).orderBy(F.desc("rows"), "table")


def with_distance(stops: DataFrame, centre: tuple[float, float] = ZONE_CENTRE) -> DataFrame:
    """Adds `distance_km`; coordinates may be text."""
    lat, lon = (F.col(c).try_cast("double") for c in ("stop_lat", "stop_lon"))
    return stops.withColumn("distance_km", distance_km(lat, lon, centre))


def within_radius(stops: DataFrame, radius_km: float, centre=ZONE_CENTRE) -> DataFrame:
    return with_distance(stops, centre).where(F.col("distance_km") <= radius_km)


def radius_counts(
    stops: DataFrame, radii: Sequence[int] = RADII_KM, centre: tuple[float, float] = ZONE_CENTRE
) -> DataFrame:
    """Stops within each radius, all radii in one pass."""
    counts = with_distance(stops, centre).agg(
        F.array(
            *[
                F.struct(
                    F.lit(r).cast("bigint").alias("radius_km"),
                    F.count_if(F.col("distance_km") <= r).alias("stops"),
                )
                for r in radii
            ]
        ).alias("found")
    )
    return counts.select(F.explode("found").alias("f")).select("f.*")


def distinct_values(column: Column) -> Column:
    """Number of distinct values where null is a value too."""
    return F.count_distinct(column) + F.max(column.isNull().cast("bigint"))


def unique_names(stops: DataFrame) -> DataFrame:
    names = stops.groupBy("stop_name").agg(F.count(F.lit(1)).alias("n"))
    return names.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("unique_names")
    )


def most_frequent_names(stops: DataFrame, k: int = 25) -> DataFrame:
    """The k most frequent names; equal counts are ordered by name."""
    counted = stops.groupBy("stop_name").agg(F.count(F.lit(1)).alias("stops"))
    return counted.orderBy(F.desc("stops"), F.asc_nulls_last("stop_name")).limit(k)


def sorted_names(stops: DataFrame) -> DataFrame:
    return stops.select("stop_name").distinct().orderBy(F.asc_nulls_first("stop_name"))


def labelled_counts(counts: dict[str, DataFrame], label: str = "metric") -> DataFrame:
    """One row per named table with its number of rows."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias(label), "value")
        for name, df in counts.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def universe(trips: DataFrame, trip_ids: DataFrame) -> DataFrame:
    """Distinct trips of the feed against trips touching the zone."""
    total = trips.select("trip_id").distinct()
    return labelled_counts({"total_trips": total, "zone_trips": trip_ids})


def feed_against_subset(feed: dict[str, DataFrame], subset: dict[str, DataFrame]) -> DataFrame:
    """Rows of stops, trips and routes in the feed and in the subset."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("metric"), F.lit(side).alias("side"), "n"
        )
        for side, tables in (("feed", feed), ("subset", subset))
        for name, df in tables.items()
        if name in ("stops", "trips", "routes")
    ]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("metric").agg(
        F.max(F.when(F.col("side") == "feed", F.col("n"))).alias("feed_rows"),
        F.max(F.when(F.col("side") == "subset", F.col("n"))).alias("subset_rows"),
    )


def class_counts(classified: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return classified.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))


def class_shares(classified: DataFrame, column: str) -> DataFrame:
    """Counts per class and their percentage. The window sees one row per class: three at most."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy()) * 100
    return class_counts(classified, column).withColumn("pct", F.round(share, 2))


def route_details(classes: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes with their class; a column of the table named like the class is not touched."""
    return routes.join(classes.select("route_id", "classification"), "route_id", "inner")


def mixed_routes(details: DataFrame, columns: Sequence[str], k: int = 50) -> DataFrame:
    """The first k mixed routes, in route order."""
    mixed = details.where(F.col("classification") == MIXED)
    return mixed.orderBy("route_id").select(*columns, "classification").limit(k)
