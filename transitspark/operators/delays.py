"""Delay metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delay_metrics(
    delays: DataFrame,
    keys: Sequence[str],
    delay: str = "delay_s",
    late_after_s: int = 0,
) -> DataFrame:
    """Exact count, mean, median, 95th percentile and share late per key.

    `delay` is in whole seconds. Rows are counted per distinct delay first (map-side), and the
    quantiles are read off that histogram, so a key with very many rows costs its number of
    distinct delays, not its rows.
    """
    hist = (
        delays.where(F.col(delay).isNotNull())
        .groupBy(*keys, F.col(delay).alias("__d"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    ordered = Window.partitionBy(*keys).orderBy("__d")
    whole = Window.partitionBy(*keys)
    ranked = hist.withColumns(
        {"__upto": F.sum("__n").over(ordered), "__all": F.sum("__n").over(whole)}
    )

    def reached(share: float):
        return F.min(F.when(F.col("__upto") >= F.col("__all") * F.lit(share), F.col("__d")))

    late = F.sum(F.when(F.col("__d") > late_after_s, F.col("__n")).otherwise(F.lit(0)))
    return ranked.groupBy(*keys).agg(
        F.sum("__n").alias("updates"),
        (F.sum(F.col("__d") * F.col("__n")) / F.sum("__n")).alias("mean_delay_s"),
        reached(0.5).alias("p50_delay_s"),
        reached(0.95).alias("p95_delay_s"),
        (late / F.sum("__n")).alias("late_share"),
    )


def in_windows(delays: DataFrame, width: str, ts: str = "feed_ts") -> DataFrame:
    """Adds `window_start` of the tumbling window an event falls in."""
    return delays.withColumn("window_start", F.window(ts, width)["start"])


def streamed_delay_metrics(
    delays: DataFrame,
    keys: Sequence[str],
    width: str,
    watermark: str,
    slide: str | None = None,
    delay: str = "delay_s",
    late_after_s: int = 0,
) -> DataFrame:
    """The same metrics over event-time windows of a stream, as exact as in a batch.

    Two aggregates in a row: the first counts rows per window, key and distinct delay, so its state
    is one number per delay in whole seconds and combines map-side; a window that closes hands its
    histogram to the second, which keeps it as one sorted list and reads the quantiles off. A window is written when
    the watermark has passed its end.
    """
    known = delays.where(F.col(delay).isNotNull()).withWatermark("feed_ts", watermark)
    spans = F.window("feed_ts", width, slide) if slide else F.window("feed_ts", width)
    hist = known.groupBy(spans.alias("__w"), *keys, F.col(delay).cast("long").alias("__d")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    bins = F.array_sort(F.collect_list(F.struct("__d", "__n"))).alias("__bins")
    found = hist.groupBy("__w", *keys).agg(F.sum("__n").alias("updates"), bins)

    def total(part) -> Column:
        return F.aggregate("__bins", F.lit(0).cast("long"), lambda acc, b: acc + part(b))

    def reached(share: float) -> Column:
        """The least delay up to which the share of all rows lies."""
        start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("d"))

        def step(acc: Column, b: Column) -> Column:
            upto = acc["upto"] + b["__n"]
            here = acc["d"].isNull() & (upto >= F.col("updates") * F.lit(share))
            return F.struct(upto.alias("upto"), F.when(here, b["__d"]).otherwise(acc["d"]).alias("d"))

        return F.aggregate("__bins", start, step)["d"]

    late = total(lambda b: F.when(b["__d"] > late_after_s, b["__n"]).otherwise(0))
    return found.select(
        F.col("__w.start").alias("window_start"),
        F.col("__w.end").alias("window_end"),
        *keys,
        "updates",
        (total(lambda b: b["__d"] * b["__n"]) / F.col("updates")).alias("mean_delay_s"),
        reached(0.5).alias("p50_delay_s"),
        reached(0.95).alias("p95_delay_s"),
        (late / F.col("updates")).alias("late_share"),
    )
