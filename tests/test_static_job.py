import os

import pytest
from conftest import values
from pyspark.sql import functions as F

from transitspark.__main__ import main
from transitspark.config import QualityRules
from transitspark.operators.rules import report_lines
from transitspark.operators.subset import DERIVED_FROM, city_subset, dependents
from transitspark.plans.static import publish_each, publish_latest, replay_history
from transitspark.sources import files, manifest
from transitspark.sources.publish import HistoryWriter, published_latest, read_history
from transitspark.sources.snapshots import latest_snapshot, load_history, snapshots

RULES = QualityRules(
    required={"stops": ("stop_id", "stop_name")}, bounds={"stops": (1, 100)},
)
GOOD = ("gtfs_fp2026_20260722", "gtfs_fp2026_20260729")
BAD = "gtfs_fp2026_20260805"


@pytest.fixture
def bronze(tmp_path, universe):
    root = tmp_path / "bronze"
    for version in (*GOOD, BAD):
        for name, df in universe.items():
            if version == BAD and name == "stops":
                df = df.withColumn("stop_name", F.lit(None).cast("string"))
            df.coalesce(1).write.parquet(str(root / version / f"{name}.parquet"))
    (root / ".staging").mkdir()
    os.symlink(root / BAD, root / "latest")
    return str(root)


def test_reserved_names_and_order(spark, bronze):
    assert [s.version for s in snapshots(spark, bronze)] == [*GOOD, BAD]
    assert latest_snapshot(spark, bronze).version == BAD


def test_no_snapshot_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        latest_snapshot(spark, str(tmp_path / "nothing"))


def lines(report):
    return values(report_lines(report), "snapshot_version", "line")


def per_artifact(counts):
    return {(r[0], r[1]): r[2] for r in counts.collect()}


def test_latest_fails_and_writes_nothing(spark, bronze, tmp_path):
    silver = str(tmp_path / "silver")
    report, counts = publish_latest(spark, bronze, silver, rules=RULES)
    assert [v for v, _ in lines(report)] == [BAD] and counts.count() == 0
    assert published_latest(spark, silver) is None


def test_each_in_turn_skips_the_bad_version(spark, bronze, tmp_path):
    silver = str(tmp_path / "silver")
    report, counts = publish_each(spark, bronze, silver, rules=RULES)
    got = per_artifact(counts)
    assert {v for v, _ in lines(report)} == {BAD} and {v for v, _ in got} == set(GOOD)
    assert published_latest(spark, silver) == GOOD[-1]
    assert got[GOOD[0], "trips"] == 2 and got[GOOD[0], "mixed_routes"] == 0
    folder = snapshots(spark, silver)[0].path
    trips = spark.read.parquet(f"{folder}/internal_trips.parquet")
    assert values(trips, "trip_id") == ["T_INTERNAL"]
    assert sorted(os.listdir(folder)) == sorted(f"{n}.parquet" for v, n in got if v == GOOD[0])
    # publishing an older version again replaces it and does not move latest
    publish_each(spark, bronze, silver, rules=RULES)
    assert published_latest(spark, silver) == GOOD[-1]


def test_history_in_one_pass_equals_one_by_one(spark, bronze, tmp_path):
    silver, history = str(tmp_path / "silver"), str(tmp_path / "history")
    told, counts = publish_each(spark, bronze, silver, rules=RULES)
    report, at_once = replay_history(spark, bronze, history, rules=RULES)
    assert lines(report) == lines(told) and [v for v, _ in lines(report)] == [BAD]
    assert per_artifact(at_once) == {k: n for k, n in per_artifact(counts).items() if n}
    _, again = replay_history(spark, bronze, history, rules=RULES)
    assert per_artifact(again) == per_artifact(at_once)
    crossing = read_history(spark, history, "crossing_trips")
    assert values(crossing, "snapshot_version", "trip_id") == [(v, "T_CROSSING") for v in GOOD]


def test_a_version_that_now_fails_is_withdrawn(spark, bronze, tmp_path):
    history = str(tmp_path / "history")
    replay_history(spark, bronze, history, rules=RULES)
    spark.createDataFrame([("Z1", None)], "stop_id string, stop_name string").write.mode("overwrite").parquet(f"{bronze}/{GOOD[0]}/stops.parquet")
    replay_history(spark, bronze, history, rules=RULES)
    trips = read_history(spark, history, "trips")
    assert {v for v in values(trips, "snapshot_version")} == {GOOD[1]}


def test_a_failed_write_leaves_the_table_as_it_was(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.sql("SELECT 1 a, 'v1' snapshot_version")
    writer = HistoryWriter(spark, root)
    writer.write(rows, "t", ["v1"])
    with pytest.raises(FileNotFoundError):
        read_history(spark, root, "t")  # nothing is published before the manifest
    writer.commit()
    with pytest.raises(Exception, match="no luck"):
        HistoryWriter(spark, root).write(rows.withColumn("a", F.when(F.col("a") > 0, F.raise_error(F.lit("no luck")).cast("int"))), "t", ["v1"])
    assert values(read_history(spark, root, "t")) == [(1, "v1")]


def test_a_failure_between_data_and_manifest_changes_nothing(spark, bronze, tmp_path, monkeypatch):
    history, silver = str(tmp_path / "history"), str(tmp_path / "silver")
    replay_history(spark, bronze, history, rules=RULES)
    publish_each(spark, bronze, silver, rules=RULES)
    before, old = manifest.published(spark, history), [s.path for s in snapshots(spark, silver)]
    renamed = [("Z1", "Zürich HB"), ("Z2", "Oerlikon"), ("X1", "Bern"), ("X2", "Basel")]
    spark.createDataFrame(renamed, "stop_id string, stop_name string").write.mode("overwrite").parquet(f"{bronze}/{GOOD[0]}/stops.parquet")
    monkeypatch.setattr(files, "write_new", lambda *_: (_ for _ in ()).throw(OSError("store is gone")))
    for job, root in ((replay_history, history), (publish_each, silver)):
        with pytest.raises(OSError, match="gone"):
            job(spark, bronze, root, rules=RULES)
    monkeypatch.undo()
    assert manifest.published(spark, history) == before and [s.path for s in snapshots(spark, silver)] == old
    assert values(read_history(spark, history, "stops", [GOOD[0]]), "stop_id") == ["Z1", "Z2"]
    replay_history(spark, bronze, history, rules=RULES)
    assert values(read_history(spark, history, "stops", [GOOD[0]]), "stop_id") == ["Z1"]
    # data nobody lists any more goes, what is published stays
    manifest.prune(spark, history, keep=1)
    assert len(os.listdir(f"{history}/_manifests")) == 2 and values(read_history(spark, history, "stops"), "stop_id") == ["Z1", "Z1", "Z2"]


def test_manifests_are_written_once(spark, tmp_path):
    root = str(tmp_path)
    assert manifest.published(spark, root) == {}
    assert [manifest.commit(spark, root, {n: f"{root}/_data/x/{n}"}) for n in ("a", "b")] == [1, 2]
    manifest.commit(spark, root, {"a": None})
    assert manifest.published(spark, root) == {"b": f"{root}/_data/x/b"}
    with pytest.raises(FileExistsError):
        files.write_new(spark, f"{root}/_manifests/000000000003.json", "{}")
    assert manifest.published(spark, root) == {"b": f"{root}/_data/x/b"}
    (tmp_path / "_manifests" / ".half").write_text("{")  # left over from a publisher that died


NO_RULES = QualityRules(required={}, bounds={}, foreign_keys=())


@pytest.mark.parametrize("job", [publish_each, replay_history])
def test_versions_that_lack_inputs_are_left_out(spark, bronze, tmp_path, universe, job):
    """One without a table, one without a column, one with a broken file; the others are published."""
    for version in ("gtfs_fp2026_20260812", "gtfs_fp2026_20260819", "gtfs_fp2026_20260826"):
        for name, df in universe.items():
            df = df.drop("route_id") if (version, name) == ("gtfs_fp2026_20260819", "trips") else df
            if (version, name) != ("gtfs_fp2026_20260812", "stops"):
                df.write.parquet(f"{bronze}/{version}/{name}.parquet")
    broken = tmp_path / "bronze" / "gtfs_fp2026_20260826" / "routes.parquet"
    for part in broken.glob(".*.crc"):
        part.unlink()
    for part in broken.glob("*.parquet"):
        part.write_bytes(b"PAR1 no table")
    report, counts = job(spark, bronze, str(tmp_path / "out"), rules=NO_RULES)
    told = values(report, "snapshot_version", "table", "check", "column")
    assert told == [
        ("gtfs_fp2026_20260812", "stops", "missing_input", None), ("gtfs_fp2026_20260819", "trips", "missing_input", "route_id"),
        ("gtfs_fp2026_20260826", "routes", "missing_input", None),
    ]
    detail = {r["table"]: r["detail"] for r in report.collect()}
    assert detail["routes"] == "table routes is missing; needed by routes, internal_routes, crossing_routes, mixed_routes, agencies"
    # BAD has no stop of the zone, so no rows
    assert {v for (v, _), n in per_artifact(counts).items() if n} == set(GOOD)


def test_a_version_that_fails_while_derived_is_reported(spark, bronze, tmp_path):
    """Its footers can be read, its rows cannot."""
    for part in (tmp_path / "bronze" / GOOD[0] / "stop_times.parquet").glob("*.parquet"):
        data = bytearray(part.read_bytes())
        data[4:60] = b"\xff" * 56
        part.write_bytes(bytes(data))
        (part.parent / f".{part.name}.crc").unlink()
    report, counts = publish_each(spark, bronze, str(tmp_path / "out"), rules=NO_RULES)
    assert values(report, "snapshot_version", "check") == [(GOOD[0], "derivation")]
    assert {v for v, _ in per_artifact(counts)} == {GOOD[1], BAD}


def test_lineage_names_all_artifacts(universe, spark):
    extra = {"agency": "agency_id string", "calendar": "service_id string", "calendar_dates": "service_id string", "frequencies": "trip_id string"}
    made = city_subset({**universe, **{n: spark.createDataFrame([], t) for n, t in extra.items()}})
    assert sorted(made) == sorted(DERIVED_FROM) == sorted(dependents("stops"))
    assert dependents("calendar") == ["calendar"] and "stops" not in dependents("stop_times")


def test_command_line(bronze, tmp_path, capsys):
    args = ["--bronze", bronze, "--silver", str(tmp_path / "silver")]
    assert main(["latest", *args]) == 1  # no table is within the bounds of a real timetable
    assert BAD in capsys.readouterr().err
    with pytest.raises(SystemExit):
        main(["sideways", *args])


def test_history_names_a_column_only_one_version_lacks(spark, bronze, tmp_path, universe):
    lacking = f"{bronze}/gtfs_fp2026_20260812"
    for name, df in universe.items():
        df = df.drop("stop_name") if name == "stops" else df
        df.write.parquet(f"{lacking}/{name}.parquet")
    report, _ = replay_history(spark, bronze, str(tmp_path / "h"), rules=RULES)
    told = [line for v, line in lines(report) if v == "gtfs_fp2026_20260812"]
    assert told == ["stops.required_columns: missing column(s): ['stop_name']"]


def test_versions_of_a_history_are_read_off_the_path_by_plain_searches(spark, tmp_path):
    bronze = str(tmp_path / "bronze")
    for version in ("feed_20260101", "feed_20260102"):
        spark.range(2).write.parquet(f"{bronze}/{version}/stops.parquet")
    stops = load_history(spark, snapshots(spark, bronze))["stops"]
    assert {r[0] for r in stops.select("snapshot_version").distinct().collect()} == {"feed_20260101", "feed_20260102"}
    assert "regexp_extract" not in stops._jdf.queryExecution().optimizedPlan().toString()
