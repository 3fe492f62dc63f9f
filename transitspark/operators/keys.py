"""Grouped sides of joins whose other side may be dominated by one key.

AQE splits an oversized join partition only when the join's own shuffle lies directly below it. A
side that was just grouped by the join key reuses the shuffle of its grouping, which rules the
split out for both sides. So these sides are grouped by the key together with its hash: the
groups are the same, and the join gets a shuffle of its own for the few grouped rows. When the
grouped side is small enough to be broadcast, nothing of this matters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPREAD = "__spread"


def unique_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of `df`."""
    return df.select(*keys, F.xxhash64(*keys).alias(_SPREAD)).distinct().drop(_SPREAD)


def per_key(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """One row per key."""
    grouped = df.groupBy(*keys, F.xxhash64(*keys).alias(_SPREAD))
    return grouped.agg(*aggregates).drop(_SPREAD)


def with_integer(df: DataFrame, column: str) -> DataFrame:
    """`df` with a text `column` read as an integer, as landed tables hold it; unreadable values are null."""
    return df.withColumn(column, F.col(column).try_cast("bigint")) if df.schema[column].dataType.typeName() == "string" else df
