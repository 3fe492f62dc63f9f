"""The ledger as days and states that are written once and listed by a manifest.

A day holds all messages of one `feed_date`; a state holds, as of the end of a day, the message of every
key. A replay reads the newest state before its instant and the days after that, instead of the ledger
from its beginning. Retention takes days out of the manifest once a state covers them, so what they led to stays
known. Days and states are dates in UTC, the time zone sessions are set to.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitspark.config import RETENTION_DAYS
from transitspark.operators.state import state_as_of
from transitspark.plans.realtime import LEDGER_SCHEMA, RAW
from transitspark.sources import files, manifest

_DAY, _STATE, _EXPIRED = "day=", "state=", "expired="
_VALUES = ["entity_type", "entity_id", "value", "feed_version", "ingestion_ts"]
_TIE = ["ingestion_ts", "entity_id"]
_NEVER = date(1, 1, 2)


def _dated(names: dict[str, str], kind: str) -> dict[date, str]:
    return {date.fromisoformat(n.removeprefix(kind)): path for n, path in names.items() if n.startswith(kind)}


def _expired(names: dict[str, str]) -> date:
    return max(_dated(names, _EXPIRED), default=_NEVER)


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    reader = spark.read.schema(LEDGER_SCHEMA)
    return reader.parquet(*paths) if paths else spark.createDataFrame([], LEDGER_SCHEMA)


def archive_days(spark: SparkSession, messages: DataFrame, root: str) -> list[date]:
    """Publishes the days of `messages`, each of which replaces what was archived for it; the days published.

    `messages` hold whole days. States that cover a replaced day leave with the same manifest, since they may no
    longer be right. Messages without a feed instant belong to no day and stay in the ledger alone, and a
    day that has expired stays so.
    """
    names = manifest.published(spark, root)
    folder = manifest.new_data(root, "days")
    rows = messages.select(*LEDGER_SCHEMA.names).where(F.col("feed_date") > F.lit(_expired(names).isoformat()).cast("date"))
    rows.withColumn("__day", F.col("feed_date")).hint("rebalance", "__day").write.partitionBy("__day").parquet(folder)
    days = {}
    for entry in files.children(spark, folder):
        if entry.is_dir and entry.name.startswith("__day="):
            days[date.fromisoformat(entry.name.removeprefix("__day="))] = f"{folder}/{entry.name}"
    if days:
        stale = {f"{_STATE}{d}": None for d in _dated(names, _STATE) if d >= min(days)}
        manifest.commit(spark, root, {f"{_DAY}{d}": path for d, path in days.items()} | stale)
    return sorted(days)


def _parts(names: dict[str, str], until: date) -> list[str]:
    """The newest state at or before the day `until` and the days after it up to `until`."""
    if until < _expired(names):
        raise ValueError(f"days before {_expired(names)} have expired")
    states = {d: p for d, p in (_dated(names, _EXPIRED) | _dated(names, _STATE)).items() if d <= until}
    base = max(states, default=_NEVER)
    days = [path for d, path in sorted(_dated(names, _DAY).items()) if base < d <= until]
    return [states[base], *days] if states else days


def state_through(spark: SparkSession, root: str, day: date) -> str:
    """Publishes the state at the end of a day, made from the state before it and the days since; its folder."""
    names = manifest.published(spark, root)
    known = (_dated(names, _STATE) | _dated(names, _EXPIRED)).get(day)
    if known:
        return known
    end = F.lit(datetime.combine(day, datetime.min.time()).isoformat()).cast("timestamp") + F.expr("INTERVAL 1 DAY - INTERVAL 1 MICROSECOND")
    held = state_as_of(_read(spark, _parts(names, day)), ["key"], _VALUES, end, _TIE)
    folder = manifest.new_data(root, "state")
    held.withColumn("feed_date", F.to_date("feed_ts")).select(*LEDGER_SCHEMA.names).write.parquet(folder)
    manifest.commit(spark, root, {f"{_STATE}{day}": folder})
    return folder


def replay(spark: SparkSession, root: str, at: datetime) -> DataFrame:
    """The message of every key that held at an instant (UTC): the rows of `ledger_at` over the whole ledger."""
    names = manifest.published(spark, root)
    whole_days = at.date() - timedelta(days=1)
    if whole_days < _expired(names):
        raise ValueError(f"days up to {_expired(names)} have expired")
    last = _dated(names, _DAY).get(at.date())
    rows = _read(spark, _parts(names, whole_days) + ([last] if last else []))
    return state_as_of(rows, ["key"], _VALUES, F.lit(at.isoformat()).cast("timestamp"), _TIE)


def read_days(spark: SparkSession, root: str) -> DataFrame:
    """All messages of the days that are kept."""
    return _read(spark, list(_dated(manifest.published(spark, root), _DAY).values()))


def expire(spark: SparkSession, root: str, today: date, table: str = RAW) -> list[date]:
    """Takes the days a table no longer keeps on `today` out of the archive; the days taken out.

    The state at the end of the last of them is published first, so any later instant can still be replayed. A
    run that fails before its manifest, or is repeated, changes nothing. Files go with `manifest.prune`.
    """
    last = today - timedelta(days=RETENTION_DAYS[table])
    names = manifest.published(spark, root)
    gone = sorted(d for d in _dated(names, _DAY) if d <= last)
    if gone:
        folder = state_through(spark, root, gone[-1])
        changes = {f"{_DAY}{d}": None for d in gone}
        changes |= {f"{_STATE}{d}": None for d in _dated(manifest.published(spark, root), _STATE) if d <= gone[-1]}
        changes |= {f"{_EXPIRED}{d}": None for d in _dated(names, _EXPIRED)}
        manifest.commit(spark, root, changes | {f"{_EXPIRED}{gone[-1]}": folder})
    return gone
