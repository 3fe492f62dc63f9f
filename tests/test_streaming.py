"""Streams over several files against the same rows as a batch."""

import json
import random
from collections import Counter

import pytest
from conftest import frame, values
from pyspark.sql import functions as F

from transitspark.operators import delays, state
from transitspark.operators.realtime import trip_update_rows, ledger_entities
from transitspark.plans import realtime as realtime_jobs
from transitspark.streaming import ledger

T0 = 1_767_225_600  # 2026-01-01T00:00:00Z


def poll(folder, number, entities, ts=None):
    header = {"gtfs_realtime_version": "2.0", "incrementality": 0, "timestamp": T0 + 30 * number if ts is None else ts}
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"header": header, **e}) for e in entities]
    (folder / f"poll-{number:04d}.json").write_text("\n".join(lines))


def vehicle(name, stop):
    return {"id": f"e-{name}", "vehicle": {"vehicle": {"id": name}, "stop_id": stop, "timestamp": T0}}


def drain(query):
    query.awaitTermination()


def test_ledger_in_cycles(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "ledger"), str(tmp_path / "cp")
    poll(src, 0, [vehicle("a", "1"), vehicle("b", "1")])
    start = lambda: ledger.start_table(ledger.raw_messages(ledger.stream_entities(spark, str(src))), out, cp, every=None)
    drain(start())
    poll(src, 1, [vehicle("a", "2"), {"id": "gone", "is_deleted": True, "vehicle": {}}])
    (src / "poll-0002.json").write_text("not json\n")
    drain(start())
    found = spark.read.parquet(out)
    assert values(found, "key") == ["vehicle.a", "vehicle.a", "vehicle.b"]
    assert values(ledger.read_unreadable(spark, str(src)), "line") == ["not json"]
    drain(realtime_jobs.start_unreadable(spark, str(src), str(tmp_path / "root"), every=None))
    assert values(spark.read.parquet(str(tmp_path / "root" / realtime_jobs.UNREADABLE)), "line") == ["not json"]
    # one ingestion instant per cycle
    assert found.where(f"feed_ts = timestamp_seconds({T0})").select("ingestion_ts").distinct().count() == 1
    batch = ledger.raw_messages(ledger.read_entities(spark, str(src)))
    columns = ("key", "entity_type", "entity_id", "feed_date")
    assert values(found, *columns) == values(batch, *columns)


def test_repeats_are_dropped_once_per_instant(spark, tmp_path):
    src = tmp_path / "in"
    poll(src, 0, [vehicle("a", "1")])
    poll(src, 1, [vehicle("a", "1")], ts=T0)
    poll(src, 2, [vehicle("a", "1"), {"id": "u"}])
    rows = ledger.normalized(ledger.raw_messages(ledger.stream_entities(spark, str(src))))
    drain(ledger.start_table(rows, str(tmp_path / "out"), str(tmp_path / "cp"), every=None))
    got = spark.read.parquet(str(tmp_path / "out")).select("key", F.unix_seconds("feed_ts").alias("t"))
    batch = ledger.normalized(ledger.raw_messages(ledger.read_entities(spark, str(src))))
    assert values(got) == [("vehicle.a", T0), ("vehicle.a", T0 + 60)]
    assert values(got) == values(batch.select("key", F.unix_seconds("feed_ts")))


def test_two_entities_of_one_key_both_stay(spark, tmp_path):
    src = tmp_path / "in"
    twin = {**vehicle("a", "2"), "id": "twin"}
    poll(src, 0, [vehicle("a", "1"), twin, twin, {"vehicle": {}}])
    rows = ledger.normalized(ledger.raw_messages(ledger.stream_entities(spark, str(src))))
    drain(ledger.start_table(rows, str(tmp_path / "out"), str(tmp_path / "cp"), every=None))
    batch = ledger.normalized(ledger.raw_messages(ledger.read_entities(spark, str(src))))
    for got in (spark.read.parquet(str(tmp_path / "out")), batch):
        assert values(got, "key", "entity_id") == [("vehicle.a", "e-a"), ("vehicle.a", "twin")]
    assert ledger.read_unreadable(spark, str(src)).count() == 1


POLLS = [{"a": 1, "b": 1}, {"a": 1, "b": 2}, {"b": 2}, {"a": 3, "b": 2}, {"c": 1}]
WANT = [
    ("a", 0, "appeared", None, 1), ("b", 0, "appeared", None, 1), ("b", 1, "changed", 1, 2), ("a", 2, "disappeared", 1, None),
    ("a", 3, "appeared", None, 3), ("a", 4, "disappeared", 3, None), ("b", 4, "disappeared", 2, None), ("c", 4, "appeared", None, 1),
]


def flat(found):
    number = ((F.unix_seconds("feed_ts") - T0) / 30).cast("int").alias("n")
    return sorted(values(found.select("key", number, "change", "before.v", F.col("after.v").alias("w"))), key=lambda r: (r[1], r[0]))


def snapshot_rows(spark, numbers):
    rows = [(k, n, v) for n in numbers for k, v in POLLS[n].items()]
    return frame(spark, "key string, n int, v int", rows).selectExpr("key", f"timestamp_seconds({T0} + 30 * n) feed_ts", "v", "n id")


def test_differences_of_snapshots(spark):
    assert flat(state.snapshot_deltas(snapshot_rows(spark, range(5)), ["key"], ["v"])) == WANT


def deltas_job(tmp_path):
    return {"keys": ["key"], "values": ["v"], "out": str(tmp_path / "out"), "state": str(tmp_path / "state"), "tie": ["id"]}


def run_deltas(spark, tmp_path, pieces, hold=1):
    """Each piece is a file and a micro-batch of its own."""
    src = str(tmp_path / "in")
    for piece in pieces:
        piece.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(pieces[0].schema).option("maxFilesPerTrigger", 1).parquet(src)
    drain(ledger.start_deltas(stream, checkpoint=str(tmp_path / "cp"), every=None, hold=hold, **deltas_job(tmp_path)))


@pytest.mark.parametrize("batches", [[[0], [1], [2], [3], [4]], [[0, 1], [2, 3, 4]], [[0, 1, 2, 3, 4]]])
def test_differences_do_not_depend_on_batches(spark, tmp_path, batches):
    run_deltas(spark, tmp_path, [snapshot_rows(spark, numbers) for numbers in batches])
    out = str(tmp_path / "out")
    # the newest snapshot is open until it is closed by a newer one or by the flush
    assert flat(spark.read.parquet(out)) == [r for r in WANT if r[1] < 4]
    for _ in range(2):
        ledger.flush_deltas(spark, **deltas_job(tmp_path))
        assert flat(spark.read.parquet(out)) == WANT
    assert not (tmp_path / "out_late").exists() and not (tmp_path / "state_work").exists()


@pytest.mark.parametrize("cuts", [range(1, 9), (1, 4, 6), (3, 8)])
def test_a_snapshot_may_be_split_at_any_row(spark, tmp_path, cuts):
    rows = [(k, n, v) for n in range(5) for k, v in POLLS[n].items()]
    ends = [0, *cuts, len(rows)]
    whole = "key", f"timestamp_seconds({T0} + 30 * n) feed_ts", "v", "n id"
    pieces = [frame(spark, "key string, n int, v int", rows[a:b]).selectExpr(*whole) for a, b in zip(ends, ends[1:])]
    run_deltas(spark, tmp_path, pieces)
    ledger.flush_deltas(spark, **deltas_job(tmp_path))
    assert flat(spark.read.parquet(str(tmp_path / "out"))) == WANT
    assert not (tmp_path / "out_late").exists()


def test_the_stream_goes_on_after_a_flush(spark, tmp_path):
    run_deltas(spark, tmp_path, [snapshot_rows(spark, [0, 1])])
    ledger.flush_deltas(spark, **deltas_job(tmp_path))
    run_deltas(spark, tmp_path, [snapshot_rows(spark, [2, 3]), snapshot_rows(spark, [4])])
    ledger.flush_deltas(spark, **deltas_job(tmp_path))
    assert flat(spark.read.parquet(str(tmp_path / "out"))) == WANT


def test_the_copy_with_the_highest_tie_wins_across_batches(spark, tmp_path):
    rows = lambda *r: frame(spark, "key string, n int, v int, id int", list(r)).selectExpr("key", f"timestamp_seconds({T0} + 30 * n) feed_ts", "v", "id")
    run_deltas(spark, tmp_path, [rows(("a", 0, 1, 5)), rows(("a", 0, 2, 9), ("a", 0, 7, 3)), rows(("a", 1, 2, 1))])
    ledger.flush_deltas(spark, **deltas_job(tmp_path))
    assert flat(spark.read.parquet(str(tmp_path / "out"))) == [("a", 0, "appeared", None, 2)]


def test_instants_that_overlap_need_a_longer_hold(spark, tmp_path):
    pieces = [snapshot_rows(spark, [n]) for n in (1, 0, 3, 2, 4)]
    run_deltas(spark, tmp_path, pieces, hold=2)
    ledger.flush_deltas(spark, **deltas_job(tmp_path))
    assert flat(spark.read.parquet(str(tmp_path / "out"))) == WANT


def test_late_records_are_set_aside(spark, tmp_path):
    run_deltas(spark, tmp_path, [snapshot_rows(spark, n) for n in ([0, 2], [3], [1], [4])])
    out = str(tmp_path / "out")
    assert values(spark.read.parquet(f"{out}_late"), "key", "v") == [("a", 1), ("b", 2)]
    # snapshot 0 and those after it are compared without the late one
    assert [r[:3] for r in flat(spark.read.parquet(out))] == [("a", 0, "appeared"), ("b", 0, "appeared"), ("a", 2, "disappeared"), ("b", 2, "changed"), ("a", 3, "appeared")]


def test_changes_as_of_and_known(spark):
    rows = [("k", 0, 1, 0), ("k", 30, 1, 31), ("k", 4000, 2, 9000), ("k", 9000, 2, 9001), ("m", 5, 7, 6)]
    df = frame(spark, "key string, s bigint, v int, i bigint", rows).selectExpr("key", "timestamp_seconds(s) feed_ts", "timestamp_seconds(i) ingestion_ts", "v", "s")
    for block in (None, F.lit(0), F.col("s")):
        found = state.state_changes(df, ["key"], ["v"], block=block)
        assert values(found, "key", "s", "change", "changed_fields") == [("k", 0, "first", []), ("k", 4000, "changed", ["v"]), ("m", 5, "first", [])]
    at = lambda s: F.timestamp_seconds(F.lit(s))
    assert values(state.state_as_of(df, ["key"], ["v"], at(4000)), "key", "v") == [("k", 2), ("m", 7)]
    assert values(state.state_as_of(df, ["key"], ["v"], at(4000), known_at=at(4000)), "key", "v") == [("k", 1), ("m", 7)]


@pytest.mark.parametrize("block", [None, "0", "date_trunc('minute', feed_ts)"])
def test_state_at_the_instant_of_each_event(spark, block):
    """A dominating key, ties, repeated events, null keys and instants, keys without records."""
    rng = random.Random(7)
    records = [("hot" if rng.random() < 0.7 else rng.choice("abc"), rng.randrange(0, 400_000, 10), rng.randrange(5), i) for i in range(300)]
    events = [("hot" if rng.random() < 0.7 else rng.choice("abcd"), rng.randrange(-5, 400_000), i) for i in range(200)]
    events += [events[0], events[0], (None, 5, 900), ("hot", None, 901), *((r[0], r[1], 1000 + r[3]) for r in records[:50])]
    records += [(None, 7, 1, 999), ("hot", None, 1, 998)]
    ledger_rows = frame(spark, "key string, s bigint, v int, id int", records).selectExpr("key", "timestamp_seconds(s) feed_ts", "v", "id")
    asked = frame(spark, "key string, s bigint, n int", events).selectExpr("key", "timestamp_seconds(s) event_ts", "n", "s AS state_s")

    def held(key, s):
        seen = [(r[1], r[3], r[2]) for r in records if r[0] == key and key is not None and s is not None and r[1] is not None and r[1] <= s]
        return (max(seen)[1], max(seen)[2]) if seen else (None, None)

    found = state.state_at_events(asked, ledger_rows, ["key"], ["v", "id"], ["id"], block=block and F.expr(block))
    assert found.columns == [*asked.columns, "state"]
    got = Counter((r["n"], r["state"]["id"] if r["state"] else None, r["state"]["v"] if r["state"] else None) for r in found.collect())
    assert got == Counter((n, *held(k, s)) for k, s, n in events)
    assert state.state_at_events(asked, ledger_rows.limit(0), ["key"], ["v"]).where("state IS NOT NULL").count() == 0


def test_zone_and_retention(spark):
    rows = frame(spark, "stop_id string, latitude double, longitude double, d string", [("in", 0.0, 0.0, "2026-01-08"), ("out", 47.32, 8.51, "2026-01-01"), (None, 47.32, 8.51, "2026-01-02"), ("out", None, None, "2025-12-01")])
    zone = frame(spark, "stop_id string", [("in",), ("in",)])
    assert values(state.zone_filter(rows, zone, (47.3, 8.5, 47.35, 8.52)), "d") == ["2026-01-01", "2026-01-02", "2026-01-08"]
    dated = rows.withColumn("feed_date", F.to_date("d"))
    today = F.lit("2026-01-08").cast("date")
    assert values(state.within_retention(dated, "transit.snapshots.raw", today), "d") == ["2026-01-02", "2026-01-08"]
    assert state.within_retention(dated, "transit.metrics.operational", today).count() == 3


def test_windows_of_a_stream_equal_the_batch_once_closed(spark, tmp_path):
    src = tmp_path / "in"
    for n in range(40):
        update = {"trip": {"trip_id": "t", "route_id": f"r{n % 2}"}, "stop_time_update": [{"stop_sequence": 1, "arrival": {"delay": n * 10 - 60}}]}
        poll(src, n, [{"id": f"u{n}", "trip_update": update}])
    rows = lambda df: trip_update_rows(ledger_entities(ledger.raw_messages(df))).withColumnRenamed("arrival_delay_s", "delay_s")
    found = delays.streamed_delay_metrics(rows(ledger.stream_entities(spark, str(src))), ["route_id"], "5 minutes", "1 minute")
    drain(ledger.start_table(found, str(tmp_path / "out"), str(tmp_path / "cp"), every=None))
    columns = ("window_start", "route_id", "updates", "mean_delay_s", "p50_delay_s", "p95_delay_s", "late_share")
    batch = delays.delay_metrics(delays.in_windows(rows(ledger.read_entities(spark, str(src))), "5 minutes"), ["route_id", "window_start"])
    closed = batch.where(F.col("window_start") + F.expr("interval 5 minutes") <= F.timestamp_seconds(F.lit(T0 + 39 * 30 - 60)))
    assert values(spark.read.parquet(str(tmp_path / "out")), *columns) == values(closed, *columns)
    assert closed.count() == 6


def test_all_tables_from_landed_polls(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "root")
    update = lambda d: {"id": "u", "trip_update": {"trip": {"trip_id": "t", "route_id": "r"}, "stop_time_update": [{"stop_id": "s", "arrival": {"delay": d}}]}}
    for cycle in range(3):
        for n in (2 * cycle, 2 * cycle + 1):
            poll(src, n, [vehicle("a", str(n // 2)), update(n)], ts=T0 + 600 * n)
        drain(realtime_jobs.start_raw(spark, str(src), root, every=None))
        for query in realtime_jobs.start_derived(spark, root, every=None).values():
            drain(query)
    realtime_jobs.flush_deltas(spark, root)
    raw = realtime_jobs.read_ledger(spark, root)
    assert raw.count() == 12
    assert spark.read.parquet(f"{root}/{realtime_jobs.NORMALIZED}").count() == 12
    deltas = spark.read.parquet(f"{root}/{realtime_jobs.DELTAS}")
    got = values(deltas.select("key", ((F.unix_seconds("feed_ts") - T0) / 600).cast("int").alias("n"), "change"))
    assert got == sorted([("trip.t", 0, "appeared"), ("vehicle.a", 0, "appeared"), ("vehicle.a", 2, "changed"), ("vehicle.a", 4, "changed")] + [("trip.t", n, "changed") for n in range(1, 6)], key=lambda r: [str(x) for x in r])
    metrics = spark.read.parquet(f"{root}/{realtime_jobs.METRICS}")
    assert values(metrics, "route_id", "stop_id", "updates", "mean_delay_s") == [("r", "s", 1, 2.0), ("r", "s", 2, 0.5)]
    at = lambda s: F.timestamp_seconds(F.lit(s))
    held = realtime_jobs.ledger_at(raw, at(T0 + 1300)).withColumn("t", F.unix_seconds("feed_ts") - T0)
    assert values(held, "key", "t") == [("trip.t", 1200), ("vehicle.a", 1200)]
    summary = realtime_jobs.explore(spark, str(src), str(tmp_path / "summary"))
    assert summary.count() == 6 and {tuple(r) for r in summary.select("entity_counts.total", "entity_counts.unknown").collect()} == {(2, 0)}


def test_a_failed_cycle_does_not_end_the_stream(spark, tmp_path):
    src = tmp_path / "in"
    poll(src, 0, [vehicle("a", "1")])
    runs = []

    def step(batch, batch_id):
        runs.append(batch_id)
        if len(runs) == 1:
            raise RuntimeError("first cycle")

    def start():
        rows = ledger.stream_entities(spark, str(src))
        return rows.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    assert realtime_jobs.keep_going(start, pause_s=0) == 1
    assert runs == [0, 0]


def test_a_poisonous_cycle_is_set_aside_and_the_others_go_on(spark, tmp_path):
    src, out, aside = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "aside")
    for n, name in enumerate(["a", "poison", "c"]):
        poll(src, n, [vehicle(name, "1"), vehicle("x", str(n))])
    runs = []

    def step(batch, batch_id):
        runs.append(batch_id)
        fail = F.when(F.col("id") == "e-poison", F.raise_error(F.lit("bad entity")).cast("string")).otherwise(F.col("id"))
        ledger.write_batch(batch.select(fail.alias("id"), F.lit(1).alias("n")), batch_id, out)

    def start():
        rows = ledger.stream_entities(spark, str(src)).select("id", "vehicle")
        lines = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(str(src))
        return ledger.start_guarded(lines, step, aside, str(tmp_path / "cp"), every=None, tries=3)

    assert ledger.read_aside(spark, aside).count() == 0
    assert realtime_jobs.keep_going(start, pause_s=0) == 2
    bad = next(i for i in set(runs) if runs.count(i) == 3)
    assert sorted(runs) == sorted([0, 1, 2, bad, bad])
    assert values(spark.read.parquet(out), "id") == ["e-a", "e-c", "e-x", "e-x"]
    told = ledger.read_aside(spark, aside).collect()
    assert [(r["batch_id"], r["tries"], r["rows_kept"]) for r in told] == [(bad, 3, True)]
    assert "bad entity" in told[0]["error"] and "logOffset" in told[0]["offsets"]
    drain(start())
    assert len(runs) == 5  # nothing is tried again
    mended = lambda batch, batch_id: ledger.write_batch(batch.select("id", F.lit(1).alias("n")), batch_id, out)
    assert ledger.retry_aside(spark, aside, mended) == [bad] and ledger.retry_aside(spark, aside, mended) == []
    assert values(spark.read.parquet(out), "id") == ["e-a", "e-c", "e-poison", "e-x", "e-x", "e-x"]
    assert ledger.read_aside(spark, aside).count() == 0


def test_a_cycle_that_ends_the_driver_counts_as_tried(spark, tmp_path):
    src, aside = tmp_path / "in", str(tmp_path / "aside")
    poll(src, 0, [vehicle("a", "1")])
    for n in (1, 2):  # left by two processes that never came to the end of the batch
        ledger.files.write_new(spark, f"{aside}/attempts/batch_id=0/{n}", "")
    runs = []
    drain(ledger.start_guarded(ledger.stream_entities(spark, str(src)), lambda *a: runs.append(a), aside, str(tmp_path / "cp"), every=None, tries=2))
    assert runs == [] and ledger.read_aside(spark, aside).count() == 1


def test_guarded_ledger_feeds_the_derived_tables(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "root")
    poll(src, 0, [vehicle("a", "1"), {"id": "u"}])
    drain(realtime_jobs.start_guarded_raw(spark, str(src), root, every=None))
    poll(src, 1, [vehicle("a", "2")])
    drain(realtime_jobs.start_guarded_raw(spark, str(src), root, every=None))
    raw = realtime_jobs.read_ledger(spark, root)
    assert raw.columns == realtime_jobs.LEDGER_SCHEMA.names
    batch = ledger.raw_messages(ledger.read_entities(spark, str(src)))
    columns = ("key", "entity_id", "feed_ts", "feed_date", "entity_type")
    assert values(raw, *columns) == values(batch, *columns)
    drain(realtime_jobs.start_derived(spark, root, every=None)[realtime_jobs.NORMALIZED])
    assert values(spark.read.parquet(f"{root}/{realtime_jobs.NORMALIZED}"), "key") == ["vehicle.a", "vehicle.a"]
