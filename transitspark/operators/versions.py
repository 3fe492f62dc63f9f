"""Which published versions to process: a table operation over catalogue, installed and history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitspark.config import DEFAULT_CUTOFF
from transitspark.operators.keys import per_key

DISCOVERED, QUEUED, RUNNING, PUBLISHED, FAILED = (
    "discovered", "queued", "running", "published", "failed",
)
IGNORE, KEEP, PROCESS, DIVERGED = "ignore", "keep", "process", "diverged"
HISTORY = (
    "source_url", "state", "attempt", "worker_id", "started_at", "completed_at", "last_error",
)


def after_cutoff(df: DataFrame, cutoff: str | None = DEFAULT_CUTOFF) -> DataFrame:
    """Versions at or after the cutoff, compared as text; None keeps all."""
    return df if cutoff is None else df.where(F.col("version") >= cutoff)


def unique_upstream(upstream: DataFrame, by: Sequence[str] = (), order: str = "position") -> DataFrame:
    """One resource per version: the last one listed."""
    rest = [c for c in upstream.columns if c not in (*by, "version")]
    picked = F.max_by(F.struct(*rest), F.col(order)).alias("__r")
    return upstream.groupBy(*by, "version").agg(picked).select(*by, "version", "__r.*")


def plan_versions(
    upstream: DataFrame,
    installed: DataFrame,
    history: DataFrame,
    now: Column,
    cutoff: str | None = DEFAULT_CUTOFF,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per version with the next record of its history and what to do with it.

    `upstream`: by + `version`, `download_url`, unique per version. `installed`: by + `version`.
    `history`: by + `version` + the columns of `HISTORY`. `action` is `ignore` (below the
    cutoff), `keep`, `process` or `diverged` (published once, not installed now); a version no
    longer upstream is kept as it is. A record left running is set back to queued first, whatever
    else holds, and marked `recovered`. Running the plan on its own result changes nothing.
    """
    keys = [*by, "version"]
    listed = upstream.select(*keys, "download_url", F.lit(True).alias("__listed"))
    there = installed.select(*keys, F.lit(True).alias("__there")).distinct()
    known = history.select(*keys, *HISTORY, F.lit(True).alias("__known"))
    met = listed.join(known, keys, "full_outer").join(there, keys, "left")

    is_listed, is_there, is_known = (
        F.coalesce(F.col(c), F.lit(False)) for c in ("__listed", "__there", "__known")
    )
    stale = F.coalesce(F.col("state") == RUNNING, F.lit(False))
    below = F.lit(False) if cutoff is None else F.col("version") < cutoff
    open_ = is_listed & ~below
    was_published = F.coalesce(F.col("state") == PUBLISHED, F.lit(False))
    corrected = open_ & is_there & ~was_published
    queued = open_ & ~is_there & ~was_published

    action = (
        F.when(~is_listed, F.lit(KEEP))
        .when(below, F.lit(IGNORE))
        .when(is_there, F.lit(KEEP))
        .when(was_published, F.lit(DIVERGED))
        .otherwise(F.lit(PROCESS))
    )
    state = (
        F.when(corrected, F.lit(PUBLISHED)).when(queued | stale, F.lit(QUEUED)).otherwise(F.col("state"))
    )
    fresh = open_ & ~is_known
    return met.select(
        *keys,
        action.alias("action"),
        state.alias("state"),
        F.coalesce("source_url", F.when(fresh, F.col("download_url"))).alias("source_url"),
        F.coalesce("attempt", F.when(fresh, F.lit(0))).cast("int").alias("attempt"),
        F.when(~(stale | corrected), F.col("worker_id")).alias("worker_id"),
        F.when(~stale, F.col("started_at")).alias("started_at"),
        F.when(corrected, now).otherwise(F.col("completed_at")).alias("completed_at"),
        F.col("last_error"),
        stale.alias("recovered"),
    )


def eligible_versions(plan: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Versions to process, oldest first."""
    return plan.where(F.col("action") == PROCESS).orderBy(*by, "version")


def already_present(
    upstream: DataFrame,
    installed: DataFrame,
    cutoff: str | None = DEFAULT_CUTOFF,
    by: Sequence[str] = (),
) -> DataFrame:
    """Upstream versions at or after the cutoff that are installed."""
    return after_cutoff(upstream, cutoff).join(
        installed.select(*by, "version"), [*by, "version"], "left_semi"
    )


def newest_verified(installed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The `latest` version per feed; a query, never stored."""
    verified = installed.where(F.col("status") == "verified")
    return verified.groupBy(*by).agg(F.max("version").alias("latest"))


def version_status(installed: DataFrame, failed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every installed or just failed version: `verified` (the newest), `superseded`, `failed`.

    A failure of this run hides what is installed under the same version. The newest version is
    an aggregate joined back, not a window, so a feed with very many versions stays spread out.
    """
    keys = [*by, "version"]
    verified = installed.where(F.col("status") == "verified")
    newest = per_key(verified, by, F.max("version").alias("latest"))
    ranked = installed.select(*keys, "extract_path").join(newest, list(by), "left")
    bad = failed.select(*keys, F.lit(True).alias("__failed")).distinct()
    met = ranked.join(bad, keys, "full_outer")
    is_failed = F.coalesce(F.col("__failed"), F.lit(False))
    status = (
        F.when(is_failed, F.lit("failed"))
        .when(F.col("version") == F.col("latest"), F.lit("verified"))
        .otherwise(F.lit("superseded"))
    )
    return met.select(
        *keys,
        status.alias("status"),
        F.when(~is_failed, F.col("extract_path")).alias("extract_path"),
    )


def pointer_problems(installed: DataFrame, pointers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Feeds whose `latest` pointer does not name the directory of their newest verified version.

    `pointers`: by + `target` (a directory name; no row = no pointer).
    """
    newest = newest_verified(installed, by)
    paths = installed.select(
        *by, F.col("version").alias("latest"), F.element_at(F.split("extract_path", "/"), -1).alias("dir")
    )
    wanted = newest.join(paths, [*by, "latest"], "left")
    met = wanted.join(pointers.where(F.col("target").isNotNull()), list(by), "full_outer")
    has_latest, has_target = F.col("latest").isNotNull(), F.col("target").isNotNull()
    problem = (
        F.when(~has_latest & has_target, F.lit("pointer without a verified version"))
        .when(has_latest & ~has_target, F.lit("verified version without a pointer"))
        .when(has_latest & F.col("dir").isNull(), F.lit("newest version is not installed"))
        .when(F.col("dir") != F.col("target"), F.lit("pointer names another directory"))
    )
    return met.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(
        *by, "latest", "dir", "target", "problem"
    )


def run_summary(
    upstream: DataFrame,
    installed_before: DataFrame,
    installed_after: DataFrame,
    attempted: DataFrame,
    failed: DataFrame,
    cutoff: str | None = DEFAULT_CUTOFF,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row of counts for a run; bytes are those of the versions it installed."""
    keys = [*by, "version"]
    fresh = installed_after.join(installed_before.select(*keys), keys, "left_anti")
    one = F.lit(1).cast("bigint")
    parts = {
        "discovered": (upstream, one),
        "already_present": (already_present(upstream, installed_before, cutoff, by), one),
        "attempted": (attempted, one),
        "failed": (failed, one),
        "bytes_installed": (fresh, F.col("archive_size_bytes").cast("bigint")),
    }
    rows = None
    for name, (df, amount) in parts.items():
        part = df.agg(F.sum(amount).alias("amount")).select(F.lit(name).alias("name"), "amount")
        rows = part if rows is None else rows.unionByName(part)
    total = {
        n: F.coalesce(F.max(F.when(F.col("name") == n, F.col("amount"))), F.lit(0).cast("bigint"))
        for n in parts
    }
    return rows.agg(
        *[c.alias(n) for n, c in total.items()],
        (total["attempted"] - total["failed"]).alias("succeeded"),
    )
