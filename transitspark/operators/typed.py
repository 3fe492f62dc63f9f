"""Typed view of landed timetable tables, which hold text only, and the values that cannot be read.

A table is cast once; a value that is not what its column holds becomes null in the view and one row
in the rejects, with its text. Both are narrow projections of one scan: no shuffle, no join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitspark.functions.clock import clock_seconds

INTEGER, NUMBER, CLOCK, DAY = "integer", "number", "clock", "day"

# --- Fixed values: the timetable format's columns that are no text ---------
COLUMN_TYPES: dict[str, dict[str, str]] = {
    "stops": {"stop_lat": NUMBER, "stop_lon": NUMBER, "location_type": INTEGER, "wheelchair_boarding": INTEGER},
    "routes": {"route_type": INTEGER, "route_sort_order": INTEGER},
    "trips": {"direction_id": INTEGER, "wheelchair_accessible": INTEGER, "bikes_allowed": INTEGER},
    "stop_times": {
        "stop_sequence": INTEGER,
        "arrival_time": CLOCK,
        "departure_time": CLOCK,
        "pickup_type": INTEGER,
        "drop_off_type": INTEGER,
        "shape_dist_traveled": NUMBER,
    },
    "calendar": {
        **dict.fromkeys(("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"), INTEGER),
        "start_date": DAY,
        "end_date": DAY,
    },
    "calendar_dates": {"date": DAY, "exception_type": INTEGER},
    "frequencies": {"start_time": CLOCK, "end_time": CLOCK, "headway_secs": INTEGER, "exact_times": INTEGER},
    "feed_info": {"feed_start_date": DAY, "feed_end_date": DAY},
}
# ----------------------------------------------------------------------------


def _text(column: str) -> Column:
    """The text of a value without white space around it; a blank is null."""
    clean = F.trim(F.col(f"`{column}`").cast("string"))
    return F.when(clean != "", clean)


def read_as(column: str, kind: str) -> Column:
    """A text column as its type: `bigint`, `double`, seconds of the service day (`bigint`) or `date`; null if unreadable."""
    text = _text(column)
    if kind == INTEGER:
        # a cast alone would take 1.5 for 1
        return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))
    if kind == NUMBER:
        number = text.try_cast("double")
        return F.when(F.abs(number) < float("inf"), number)
    if kind == CLOCK:
        return clock_seconds(text).cast("bigint")
    if kind == DAY:
        day = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
        return F.when(text.rlike(r"\A[0-9]{8}\z"), day.try_cast("date"))
    raise ValueError(f"no column type {kind!r}")


def _known(df: DataFrame, table: str, types: Mapping[str, Mapping[str, str]]) -> dict[str, str]:
    return {c: kind for c, kind in types.get(table, {}).items() if c in df.columns}


def typed_view(
    df: DataFrame, table: str, types: Mapping[str, Mapping[str, str]] = COLUMN_TYPES
) -> DataFrame:
    """The table with its known columns typed, under their own names; other columns as they are."""
    known = _known(df, table, types)
    return df.select(*[read_as(c, known[c]).alias(c) if c in known else F.col(f"`{c}`") for c in df.columns])


def typed_rejects(
    df: DataFrame, table: str, key: Sequence[str], types: Mapping[str, Mapping[str, str]] = COLUMN_TYPES
) -> DataFrame:
    """`table`, `row_key`, `column`, `type`, `text` of every value that has a text and cannot be read.

    `row_key` maps the columns of `key` to their text. Rows that repeat are reported each.
    """
    known = _known(df, table, types)
    named = F.map_from_arrays(
        F.array(*[F.lit(k) for k in key]), F.array(*[F.col(f"`{k}`").cast("string") for k in key])
    )
    bad = [
        F.when(
            _text(c).isNotNull() & read_as(c, kind).isNull(),
            F.struct(F.lit(c).alias("column"), F.lit(kind).alias("type"), F.col(f"`{c}`").cast("string").alias("text")),
        )
        for c, kind in known.items()
    ]
    if not bad:
        bad = [F.lit(None).cast("struct<column: string, type: string, text: string>")]
    found = df.select(named.alias("row_key"), F.explode(F.array_compact(F.array(*bad))).alias("b"))
    return found.select(F.lit(table).alias("table"), "row_key", "b.column", "b.type", "b.text")
