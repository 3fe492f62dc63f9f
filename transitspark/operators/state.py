"""State over the append-only ledger: as-of views, changes, snapshot differences, retention."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitspark.config import RETENTION_DAYS
from transitspark.functions.geo import in_box
from transitspark.operators.keys import unique_keys
from transitspark.operators.sequence import with_carried, with_neighbour
from transitspark.session import rewritten

FIRST, APPEARED, CHANGED, DISAPPEARED = "first", "appeared", "changed", "disappeared"


def state_as_of(
    ledger: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    at: Column,
    tie: Sequence[str] = (),
    known_at: Column | None = None,
) -> DataFrame:
    """Latest record per key with `feed_ts <= at`.

    With `known_at` only records ingested by then count: what was known, not what was true.
    The time filter reaches the scan; the latest record is an aggregate that combines
    map-side, so no key is ever gathered or sorted in one place.
    """
    seen = ledger.where(F.col("feed_ts") <= at)
    if known_at is not None:
        seen = seen.where(F.col("ingestion_ts") <= known_at)
    row = F.struct("feed_ts", *values)
    latest = seen.groupBy(*keys).agg(F.max_by(row, F.struct("feed_ts", *tie)).alias("__s"))
    return latest.select(*keys, "__s.*")


def state_at_events(
    events: DataFrame,
    ledger: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    tie: Sequence[str] = (),
    at: str = "event_ts",
    block: Column | None = None,
    name: str = "state",
) -> DataFrame:
    """Each event with the record of its key that held at its own instant: a struct `name`, null if none did.

    Events and records go through one ordering per key, records before events of the same instant, and
    the last record is carried forward. A key is cut into days (or `block`, an expression over
    `feed_ts`) that are ordered side by side and linked by one row each, so neither a key with very
    many events nor one with very many records lands in one task, and no event meets more than one record.
    Of records with one key and instant the highest tie-break counts, without one the highest values. Events whose key or instant is null get null.
    """
    known = events.where(F.col(at).isNotNull() & reduce(and_, [F.col(k).isNotNull() for k in keys]))
    unknown = events.where(F.col(at).isNull() | reduce(or_, [F.col(k).isNull() for k in keys]))
    row, held = F.struct(*events.columns), F.struct("feed_ts", *values)
    records = ledger.where(F.col("feed_ts").isNotNull() & reduce(and_, [F.col(k).isNotNull() for k in keys]))
    states = records.groupBy(*keys, "feed_ts").agg((F.max_by(held, F.struct(*tie)) if tie else F.max(held)).alias(name))
    line = states.withColumns({"__event": F.lit(0).cast("long"), "__row": F.lit(None).cast(events.select(row.alias("r")).schema["r"].dataType)})
    # equal events are told apart by a number, so that the ordering is total
    asked = known.select(
        *keys, F.col(at).cast("timestamp").alias("feed_ts"), row.alias("__row"),
        F.lit(None).cast(states.schema[name].dataType).alias(name),
        (F.monotonically_increasing_id() + 1).alias("__event"),
    )
    whole = line.select(*keys, "feed_ts", "__event", "__row", name).unionByName(asked)
    by = F.to_date("feed_ts") if block is None else block
    carried = with_carried(whole, keys, ["feed_ts", "__event"], by, F.col(name), "__held")
    found = carried.where("__event > 0").select("__row.*", F.col("__held").alias(name))
    return found.unionByName(unknown.withColumn(name, F.lit(None).cast(states.schema[name].dataType)))


def deduplicated(
    ledger: DataFrame, keys: Sequence[str], values: Sequence[str], tie: Sequence[str]
) -> DataFrame:
    """One record per key and feed instant: the one with the highest tie-break."""
    row = F.struct(*values)
    return (
        ledger.groupBy(*keys, "feed_ts")
        .agg(F.max_by(row, F.struct(*tie)).alias("__s"))
        .select(*keys, "feed_ts", "__s.*")
    )


def state_changes(
    ledger: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    tie: Sequence[str] = (),
    block: Column | None = None,
) -> DataFrame:
    """Records whose values differ from the record before them under the same key.

    Adds `change` (`first` or `changed`), `changed_fields`, `previous_ts` and `before`. The
    comparison runs per key and hour (or per `block`), so a key with very many records is split.
    """
    if block is None:
        block = F.date_trunc("hour", "feed_ts")
    previous = with_neighbour(
        ledger, keys, ["feed_ts", *tie], block, ["feed_ts", *values], "__before", following=False
    )
    before = F.col("__before")
    changed = F.array_compact(
        F.array(*[F.when(~before[v].eqNullSafe(F.col(v)), F.lit(v)) for v in values])
    )
    kind = F.when(before.isNull(), F.lit(FIRST)).when(F.size(changed) > 0, F.lit(CHANGED))
    return (
        previous.withColumn("change", kind)
        .where(F.col("change").isNotNull())
        .select(
            *ledger.columns,
            "change",
            F.when(before.isNotNull(), changed).otherwise(F.array()).alias("changed_fields"),
            before["feed_ts"].alias("previous_ts"),
            before.alias("before"),
        )
    )


def snapshot_sequence(records: DataFrame, feed: Sequence[str] = ()) -> DataFrame:
    """Feed instants and the one after each, per feed: `feed_ts`, `next_ts`.

    One row per polled snapshot. The instants of a feed are linked day by day.
    """
    instants = records.select(*feed, "feed_ts").distinct()
    linked = with_neighbour(
        instants.withColumn("__one", F.lit(1)),
        [*feed, "__one"],
        ["feed_ts"],
        F.to_date("feed_ts"),
        ["feed_ts"],
        "__next",
    )
    return linked.select(*feed, "feed_ts", F.col("__next.feed_ts").alias("next_ts"))


def snapshot_deltas(
    records: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    feed: Sequence[str] = (),
    following: DataFrame | None = None,
) -> DataFrame:
    """Differences between each full snapshot and the one right after it.

    `records` hold one row per key and feed instant. Every record is moved to the instant of the
    next snapshot and met there by the record of that snapshot: a full outer join on
    (key, instant). A key missing from the next snapshot is a disappearance, found by comparing
    snapshots, not by a timeout. Join keys are unique on both sides, so a key with very many
    records is spread over all tasks. Keys of the first snapshot appear.

    `following` is the `snapshot_sequence` of the records, for callers that keep it themselves.
    """
    if following is None:
        # one row per poll, written so that Spark knows how small it is and need not shuffle records
        following = rewritten(snapshot_sequence(records, feed), "polls")
    now = F.struct(*values)
    on = list(dict.fromkeys([*feed, *keys, "feed_ts"]))
    current = records.select(*on, now.alias("__after"))
    moved = (
        records.join(following, [*feed, "feed_ts"], "inner")
        .where(F.col("next_ts").isNotNull())
        .select(
            *[c for c in on if c != "feed_ts"],
            F.col("next_ts").alias("feed_ts"),
            F.col("feed_ts").alias("__seen"),
            now.alias("__before"),
        )
    )
    met = current.join(moved, on, "full_outer")
    before, after = F.col("__before"), F.col("__after")
    kind = (
        F.when(before.isNull(), F.lit(APPEARED))
        .when(after.isNull(), F.lit(DISAPPEARED))
        .when(~before.eqNullSafe(after), F.lit(CHANGED))
    )
    return (
        met.withColumn("change", kind)
        .where(F.col("change").isNotNull())
        .select(
            *on,
            "change",
            F.col("__seen").alias("previous_ts"),
            before.alias("before"),
            after.alias("after"),
        )
    )


def within_retention(df: DataFrame, table: str, today: Column, date: str = "feed_date") -> DataFrame:
    """Rows a ledger table still keeps on day `today`; a filter on the partition column."""
    return df.where(F.col(date) > F.date_sub(today, RETENTION_DAYS[table]))


def zone_filter(
    rows: DataFrame,
    stops_in_zone: DataFrame,
    box: tuple[float, float, float, float],
    stop: str = "stop_id",
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """Rows at a stop of the zone, or positioned inside its bounding box between stops.

    Always downstream of the raw ledger, which keeps everything.
    """
    marker = unique_keys(stops_in_zone.select(F.col("stop_id").alias(stop)), [stop])
    marked = rows.join(marker.withColumn("__in_zone", F.lit(True)), stop, "left")
    inside = F.coalesce(F.col("__in_zone"), F.lit(False)) | in_box(F.col(lat), F.col(lon), box)
    return marked.where(inside).select(*rows.columns)
