"""Days, states and retention of the archived ledger against the whole ledger."""

from datetime import date, datetime

import pytest
from conftest import frame, values
from pyspark.sql import functions as F

from transitspark.plans import archive
from transitspark.plans.realtime import LEDGER_SCHEMA, ledger_at
from transitspark.sources import manifest


def messages(spark, days):
    """Key a changes every day, b on odd days, c is seen on the first day only."""
    rows = [(k, d, h) for d in days for k, h in (("a", 3), ("a", 20), ("b", 9), ("c", 5)) if not (k == "b" and d % 2 == 0) and not (k == "c" and d > 1)]
    rows = frame(spark, "key string, d int, h int", rows)
    ts = F.make_timestamp(F.lit(2026), F.lit(1), "d", "h", F.lit(0), F.lit(0))
    row = rows.select("key", F.concat_ws("-", "d", "h").alias("value"), F.lit("VEHICLE_POSITION").alias("entity_type"), F.col("key").alias("entity_id"), ts.alias("feed_ts"), ts.alias("ingestion_ts"), F.lit("2.0").alias("feed_version"), F.to_date(ts).alias("feed_date"))
    return row.select(*LEDGER_SCHEMA.names)


def held(df):
    return values(df, "key", "value")


def whole(spark, days, at):
    return held(ledger_at(messages(spark, days), F.lit(at.isoformat()).cast("timestamp")))


def test_replay_reads_a_state_and_what_follows(spark, tmp_path):
    root, at = str(tmp_path), datetime(2026, 1, 9, 12)
    assert len(archive.archive_days(spark, messages(spark, range(1, 11)), root)) == 10
    full = archive.replay(spark, root, at)
    archive.state_through(spark, root, date(2026, 1, 4))
    archive.state_through(spark, root, date(2026, 1, 7))
    short = archive.replay(spark, root, at)
    assert held(short) == held(full) == whole(spark, range(1, 11), at)
    folders = {f.split("/_data/")[1].split("/part-")[0].split("/", 1)[1] for f in short.inputFiles()}
    assert folders == {"state", "days/__day=2026-01-08", "days/__day=2026-01-09"}
    assert len({f.rpartition("/")[0] for f in full.inputFiles()}) == 9


def test_a_replaced_day_takes_its_states_out(spark, tmp_path):
    root, at = str(tmp_path), datetime(2026, 1, 6)
    archive.archive_days(spark, messages(spark, [1, 2, 4, 5]), root)
    archive.state_through(spark, root, date(2026, 1, 2))
    archive.state_through(spark, root, date(2026, 1, 4))
    archive.archive_days(spark, messages(spark, [3]), root)
    assert [n for n in manifest.published(spark, root) if n.startswith("state")] == ["state=2026-01-02"]
    assert held(archive.replay(spark, root, at)) == whole(spark, range(1, 6), at)


def test_retention_drops_days_once_a_state_covers_them(spark, tmp_path):
    root, at = str(tmp_path), datetime(2026, 1, 9, 12)
    archive.archive_days(spark, messages(spark, range(1, 11)), root)
    assert archive.expire(spark, root, date(2026, 1, 12)) == [date(2026, 1, d) for d in range(1, 6)]
    numbers = manifest._numbers(spark, root)
    assert archive.expire(spark, root, date(2026, 1, 12)) == [] and manifest._numbers(spark, root) == numbers
    assert sorted(r[0] for r in archive.read_days(spark, root).select(F.dayofmonth("feed_date")).distinct().collect()) == [6, 7, 8, 9, 10]
    assert held(archive.replay(spark, root, at)) == whole(spark, range(1, 11), at)
    with pytest.raises(ValueError):
        archive.replay(spark, root, datetime(2026, 1, 3))
    # days that have expired do not come back, and later ones still lean on what they led to
    assert archive.archive_days(spark, messages(spark, [2, 7]), root) == [date(2026, 1, 7)]
    assert archive.expire(spark, root, date(2026, 1, 14)) == [date(2026, 1, 6), date(2026, 1, 7)]
    manifest.prune(spark, root, keep=1)
    assert {p.name for p in tmp_path.rglob("__day=*")} == {f"__day=2026-01-{d:02d}" for d in (8, 9, 10)}
    assert held(archive.replay(spark, root, at)) == whole(spark, range(1, 11), at)
    assert archive.replay(spark, str(tmp_path / "none"), at).isEmpty()
