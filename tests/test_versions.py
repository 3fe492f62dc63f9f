from conftest import frame, values
from pyspark.sql import functions as F

from transitspark.functions import names
from transitspark.operators import versions

HISTORY = "version string, source_url string, state string, attempt int, worker_id string, started_at string, completed_at string, last_error string"


def plan(spark, upstream, installed=(), history=(), cutoff="20260101"):
    found = versions.plan_versions(
        frame(spark, "version string, download_url string", [(v, f"u/{v}") for v in upstream]),
        frame(spark, "version string", [(v,) for v in installed]),
        frame(spark, HISTORY, list(history)),
        F.lit("now"),
        cutoff,
    )
    return {r["version"]: r for r in found.collect()}


def record(version, state, attempt=1, worker=None, started="s", completed="c", error=None):
    return (version, "h/" + version, state, attempt, worker, started, completed, error)


def test_below_cutoff_is_ignored_without_a_record(spark):
    got = plan(spark, ["20250101", "20260805"])
    assert got["20250101"]["action"] == "ignore" and got["20250101"]["state"] is None
    assert got["20260805"]["action"] == "process" and got["20260805"]["attempt"] == 0
    assert got["20260805"]["source_url"] == "u/20260805"


def test_the_cutoff_itself_counts(spark):
    assert plan(spark, ["20260101"])["20260101"]["action"] == "process"
    assert plan(spark, ["19990101"], cutoff=None)["19990101"]["action"] == "process"


def test_installed_wins_over_a_failed_record(spark):
    got = plan(spark, ["20260805"], ["20260805"], [record("20260805", "failed", 3, error="boom")])["20260805"]
    assert (got["action"], got["state"], got["attempt"], got["last_error"], got["completed_at"]) == ("keep", "published", 3, "boom", "now")


def test_published_and_installed_is_untouched(spark):
    got = plan(spark, ["20260805"], ["20260805"], [record("20260805", "published", 2, "w")])["20260805"]
    assert (got["state"], got["worker_id"], got["completed_at"]) == ("published", "w", "c")


def test_published_but_gone_is_diverged(spark):
    got = plan(spark, ["20260805"], (), [record("20260805", "published")])["20260805"]
    assert (got["action"], got["state"], got["completed_at"]) == ("diverged", "published", "c")


def test_running_is_recovered_even_if_not_upstream_or_below_cutoff(spark):
    stale = [record(v, "running", 2, "dead-worker") for v in ("20260805", "20250101", "20260901")]
    got = plan(spark, ["20260805", "20250101"], (), stale)
    for v, action in (("20260805", "process"), ("20250101", "ignore"), ("20260901", "keep")):
        r = got[v]
        assert (r["state"], r["worker_id"], r["started_at"], r["recovered"], r["action"]) == ("queued", None, None, True, action)
        assert r["attempt"] == 2 and r["completed_at"] == "c"


def test_failed_queued_and_discovered_are_processed(spark):
    states = {"20260801": "failed", "20260802": "queued", "20260803": "discovered"}
    got = plan(spark, states, (), [record(v, s, error="e") for v, s in states.items()])
    assert all(r["state"] == "queued" and r["action"] == "process" and r["last_error"] == "e" for r in got.values())


def test_the_plan_of_a_plan_is_the_same(spark):
    history = [record("20260801", "failed"), record("20260802", "running", 1, "w"), record("20260803", "published")]
    up = ["20260801", "20260802", "20260803", "20260804"]
    first = plan(spark, up, ["20260804"], history)
    again = plan(spark, up, ["20260804"], [tuple(r[c] for c in ("version", *versions.HISTORY)) for r in first.values()])
    keep = ("version", "action", *versions.HISTORY)
    assert {v: [r[c] for c in keep] for v, r in again.items()} == {v: [r[c] for c in keep] for v, r in first.items()}


def test_last_listed_resource_of_a_version_counts(spark):
    up = frame(spark, "version string, download_url string, position int", [("v", "b", 2), ("v", "a", 1)])
    assert versions.unique_upstream(up).first()["download_url"] == "b"


def test_file_names(spark):
    cases = {
        "GTFS_FP2026_20260805.zip": ("gtfs_fp2026", "20260805"),
        "GTFS_FP2026_2025-09-22.zip": ("gtfs_fp2026", "20250922"),
        "GTFS_FP2026_README.zip": None,
        "x_20260805.Zip": None,
        "x_20260805.ZIP": ("x", "20260805"),
        "20260805.zip": None,
        "_20260805": ("", "20260805"),
    }
    df = frame(spark, "f string", [(c,) for c in cases])
    got = {r["f"]: (r["p"], r["v"]) if r["v"] else None for r in df.select("f", names.file_prefix(F.col("f")).alias("p"), names.file_version(F.col("f")).alias("v")).collect()}
    assert got == cases


def test_hash_verdicts(spark):
    cases = [(None, "skipped"), ("deadbeef", "skipped"), ("z" * 64, "skipped"), ("A" * 64, "ok"), ("b" * 64, "mismatch")]
    df = frame(spark, "h string, want string", cases)
    got = df.select("want", names.hash_verdict(F.col("h"), F.lit("a" * 64)).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_status_and_pointer(spark):
    installed = frame(spark, "feed string, version string, status string, extract_path string", [
        ("f", "20260805", "verified", "/d/gtfs_20260805"), ("f", "20260729", "verified", "/d/gtfs_20260729"), ("f", "20260812", "failed", "/d/gtfs_20260812")])
    failed = frame(spark, "feed string, version string", [("f", "20260819"), ("f", "20260729")])
    got = versions.version_status(installed, failed, ["feed"])
    assert values(got, "version", "status", "extract_path") == [
        ("20260729", "failed", None), ("20260805", "verified", "/d/gtfs_20260805"),
        ("20260812", "superseded", "/d/gtfs_20260812"), ("20260819", "failed", None)]
    pointers = lambda rows: frame(spark, "feed string, target string", rows)
    problems = lambda rows: values(versions.pointer_problems(installed, pointers(rows), ["feed"]), "problem")
    assert problems([("f", "gtfs_20260805")]) == []
    assert problems([("f", "gtfs_20260729")]) == ["pointer names another directory"]
    assert problems([]) == ["verified version without a pointer"]
    assert problems([("f", "gtfs_20260805"), ("g", "x")]) == ["pointer without a verified version"]
