"""Ordered neighbours and carried values that do not put one key in one task.

A plain window by key sorts all rows of a key in one task. Here a key is cut into blocks of its
ordering; the window runs per (key, block), and a summary of one row per block links the blocks.
With blocks sized for the usual key, the summary has one row per key and no links, and AQE makes
the last join a broadcast of nothing.

Keys must not be null; `order` should be total over the values asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK, _EDGE, _LINK = "__block", "__edge", "__link"


def block_of(order: Column, size: int) -> Column:
    """Block number of an integer ordering column."""
    return F.floor(order / size).cast("bigint")


def _linked(
    within: DataFrame, links: DataFrame, keys: Sequence[str], name: str
) -> DataFrame:
    joined = within.join(links.where(F.col(_LINK).isNotNull()), [*keys, _BLOCK], "left")
    value = F.coalesce(F.col(name), F.col(_LINK))
    return joined.withColumn(name, value).drop(_LINK, _BLOCK)


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    values: Sequence[str],
    name: str,
    following: bool = True,
) -> DataFrame:
    """Adds struct `name`: `values` of the next (or previous) row of the key, null at its end."""
    blocked = df.withColumn(_BLOCK, block)
    columns = blocked.columns
    item = F.struct(*values)
    shift = F.lead if following else F.lag
    local = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    # value by value: a struct would be made before the shuffle, which the search for ends could then not share
    there = F.struct(*[shift(F.col(v)).over(local).alias(v) for v in values])
    within = blocked.withColumn(name, F.when(shift(F.lit(True)).over(local), there)).select(*columns, name)

    # the row of a block that another block's neighbour can be: its first one, or its last
    back = F.lag if following else F.lead
    ends = blocked.withColumn(_EDGE, back(F.lit(True)).over(local)).where(F.col(_EDGE).isNull())
    edges = ends.select(*keys, _BLOCK, item.alias(_EDGE))
    across = Window.partitionBy(*keys).orderBy(_BLOCK)
    links = edges.select(*keys, _BLOCK, shift(F.col(_EDGE)).over(across).alias(_LINK))
    return _linked(within, links, keys, name)


def with_carried(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    marker: Column,
    name: str,
) -> DataFrame:
    """Adds `name`: the last non-null `marker` at or before each row of the key."""
    blocked = df.withColumn(name, marker).withColumn(_BLOCK, block)
    columns = [c for c in blocked.columns if c != name]
    ordered = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    local = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.last(name, ignorenulls=True).over(local)
    within = blocked.select(*columns, carried.alias(name))

    # what a block hands on is what its last row carries
    last = blocked.select(*keys, _BLOCK, carried.alias(_EDGE), F.lead(F.lit(True)).over(ordered).alias(_LINK))
    edges = last.where(F.col(_LINK).isNull()).select(*keys, _BLOCK, _EDGE)
    before = (
        Window.partitionBy(*keys)
        .orderBy(_BLOCK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    link = F.last(_EDGE, ignorenulls=True).over(before)
    links = edges.select(*keys, _BLOCK, link.alias(_LINK))
    return _linked(within, links, keys, name)


def nearest_rank(
    df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]
) -> DataFrame:
    """Exact quantiles per key: the smallest value reached by a share of the rows.

    Rows are first counted per distinct value, which combines map-side; the window then runs
    over distinct values of a key only. Meant for values of a small domain, such as whole
    seconds of delay or numbers of stops. Adds `row_count` and one column per share.
    """
    hist = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    ordered = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    ranked = hist.select(
        *keys,
        value,
        "__n",
        F.sum("__n").over(ordered).alias("__upto"),
        F.sum("__n").over(whole).alias("__all"),
    )
    reached = [
        F.min(F.when(F.col("__upto") >= F.col("__all") * share, F.col(value))).alias(label)
        for label, share in shares.items()
    ]
    return ranked.groupBy(*keys).agg(F.sum("__n").alias("row_count"), *reached)
