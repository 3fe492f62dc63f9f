import random
from collections import Counter
from datetime import datetime

import pytest
from conftest import frame, values

from pyspark.sql import functions as F

from transitspark.operators.explore import dataset_inventory
from transitspark.plans.landing import HISTORY_SCHEMA, current_history, land
from transitspark.sources import catalog, members, quoted
from transitspark.sources.snapshots import latest_snapshot, load_tables


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_members_become_text_tables(spark, tmp_path):
    src = tmp_path / "in"
    write(src / "stops.txt", "stop_id,stop_name,stop_lat\nS1,Zurich HB,47.378\nS2,Bern,46.949\n")
    write(src / "routes.TXT", "route_id\nR1\nR2\n")
    write(src / "README.md", "no table")
    write(src / "trips.txt", "trip_id,route_id\n" + "".join(f"T{i},R{i % 10}\n" for i in range(5000)))
    (src / "folder.txt").mkdir()
    assert sorted(members.convert_members(spark, str(src), str(tmp_path / "out"))) == ["routes", "stops", "trips"]
    stops = spark.read.parquet(str(tmp_path / "out/stops.parquet"))
    assert {t for _, t in stops.dtypes} == {"string"}
    assert values(stops) == [("S1", "Zurich HB", "47.378"), ("S2", "Bern", "46.949")]
    assert spark.read.parquet(str(tmp_path / "out/trips.parquet")).count() == 5000


def test_quotes_blanks_and_line_breaks(spark, tmp_path):
    write(tmp_path / "a.txt", 'id,name,note\n007,"a ""b"", c",\n008,,""\n')
    assert values(members.read_member(spark, str(tmp_path / "a.txt"))) == [("007", 'a "b", c', None), ("008", None, None)]
    write(tmp_path / "b.txt", 'id,name\n1,"two\nlines"\n2,x\n')
    assert values(members.read_member(spark, str(tmp_path / "b.txt"))) == [("1", "two\nlines"), ("2", "x")]


def odd_member(path, rows=3000):
    """A member with line breaks, doubled quotes, stray quotes, blanks and carriage returns in its fields."""
    rng = random.Random(3)
    plain = ["abc", "x y", "", '""', "ü", 'a "stray', '5" pipe', 'x"y"z']
    quoted = ['"line\nbreak, ""q"" \r\n end"', '"a,b"', '""""', '"\n"', '"\n\n,"', '"x""\n"', '"a\n"",""b"', '"' + "long\n" * 40 + '"']
    lines = [",".join([str(i), *(rng.choice(plain + quoted) for _ in range(3))]) for i in range(rows)]
    path.write_bytes(("id,a,b,c\n" + "\n".join(lines) + "\n\n").encode())
    return str(path)


def test_a_member_with_line_breaks_is_split(spark, tmp_path):
    path = odd_member(tmp_path / "m.txt")
    whole = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    want = Counter(map(tuple, whole.collect()))
    size, kept = (tmp_path / "m.txt").stat().st_size, {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for splits in (64, 3):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size // splits)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            ranges = quoted.text_lines(spark, path).select(F.spark_partition_id().alias("task"), "__range").distinct()
            assert ranges.select("task").distinct().count() >= splits <= ranges.select("__range").distinct().count()
            assert Counter(map(tuple, members.read_member(spark, path).collect())) == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_each_file_of_a_member_has_its_own_header_and_quotes(spark, tmp_path):
    (tmp_path / "m").mkdir()
    for i in range(3):
        odd_member(tmp_path / "m" / f"part-{i}.csv", rows=50)
    assert members.read_member(spark, str(tmp_path / "m")).count() == 150


def test_a_row_of_the_wrong_width_is_an_error(spark, tmp_path):
    write(tmp_path / "a.txt", 'id,name\n1,"two\nlines"\n2,x,y\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        members.read_member(spark, str(tmp_path / "a.txt")).collect()


@pytest.mark.parametrize("line", ["plain", 'a,"b', '"a","b', '"a"b,"c', '"a""', 'a"b', '","', '"', '""', '"""', '""""', 'x,""",', '"a",b"', 'b","c"', '"",""', '",""'])
def test_ends_of_lines(spark, line):
    """Each line against a walk over its characters, from both states."""

    def ends_inside(inside):
        i, at_start = 0, not inside
        while i < len(line):
            if inside:
                j = line.find('"', i)
                if j < 0:
                    return True
                i = j + 2 if line[j : j + 2] == '""' else j + 1
                inside = line[j : j + 2] == '""'
                at_start = False
            elif at_start and line[i] == '"':
                inside, i, at_start = True, i + 1, False
            else:
                at_start, i = line[i] == ",", i + 1
        return inside

    row = frame(spark, "v string", [(line,)]).select(F.col("v").rlike(quoted.ENDS_INSIDE_FROM_OUTSIDE), F.col("v").rlike(quoted.ENDS_INSIDE_FROM_INSIDE)).first()
    assert tuple(row) == (ends_inside(False), ends_inside(True))


def test_inventory(spark):
    found = dataset_inventory({"a": spark.range(3), "b": spark.range(5).selectExpr("id", "id x")})
    assert [tuple(r) for r in found.collect()] == [("b", 5, 2, "b.parquet"), ("a", 3, 1, "a.parquet")]


def test_member_rules(spark, tmp_path):
    good = ["stops.txt", "Trips.txt", "routes.txt", "stop_times.txt", "calendar_dates.txt"]
    for name in good:
        write(tmp_path / "ok" / name, "x\n")
        write(tmp_path / "nested" / ("sub/" + name if name == "routes.txt" else name), "x\n")
        write(tmp_path / "empty" / name, "" if name == "stops.txt" else "x\n")
    write(tmp_path / "empty" / "agency.txt", "")
    found = members.member_verdicts(members.member_inventory(spark, str(tmp_path)))
    got = {r["snapshot"]: (r["passed"], r["problems"]) for r in found.collect()}
    assert got == {
        "ok": (True, []),
        "nested": (False, ["missing routes.txt"]),
        "empty": (False, ["empty stops.txt", "empty agency.txt"]),
    }


LISTING = """{"success": true, "result": {"resources": [
 {"url": "https://d/GTFS_FP2026_20260805.zip", "format": "ZIP", "last_modified": "", "hash": ""},
 {"url": "https://d/GTFS_FP2026_2026-08-12.zip", "format": null, "last_modified": "2026-08-12", "hash": "ff"},
 {"url": "https://d/GTFS_FP2026_20250101.zip", "format": "zip"},
 {"url": "https://d/notes.pdf", "format": "PDF"},
 {"url": "https://d/GTFS_FP2026_README.zip", "format": "zip"}]}}"""


def test_catalogue(spark):
    bodies = frame(spark, "body string", [(LISTING,), ('{"success": false, "error": "no"}',), ("broken",)])
    found = catalog.parse_resources(catalog.listed_resources(bodies))
    assert values(found, "snapshot_dir", "publisher_last_modified", "upstream_hash") == [
        ("gtfs_fp2026_20250101", None, None), ("gtfs_fp2026_20260805", None, None), ("gtfs_fp2026_20260812", "2026-08-12", "ff")]


def test_records_beside_snapshots(spark):
    good = '{"version":"20260805","source_url":"u","downloaded_at":"2026-08-05T10:00:00Z","archive_size_bytes":5,"archive_sha256":"ab","extract_path":"/d/x","status":"verified"}'
    bad = ["{", good[:50], good.replace('"u"', "null"), good.replace("verified", "perhaps"), good.replace("2026-08-05T10", "soon"), good.replace(":5,", ":-5,")]
    found = catalog.installed_snapshots(frame(spark, "body string", [(b,) for b in (good, *bad)]))
    assert values(found, "version", "status") == [("20260805", "verified")]


def test_landing_a_run_and_the_next(spark, tmp_path):
    unpacked, bronze = tmp_path / "unpacked", str(tmp_path / "bronze")
    for name in ("stops", "trips", "routes", "stop_times", "calendar_dates"):
        write(unpacked / "gtfs_fp2026_20260805" / f"{name}.txt", f"{name}_id\n1\n")
        if name != "routes":
            write(unpacked / "gtfs_fp2026_20260812" / f"{name}.txt", f"{name}_id\n1\n")
    resources = catalog.parse_resources(catalog.listed_resources(frame(spark, "body string", [(LISTING,)])))
    paths = (str(unpacked), bronze, str(tmp_path / "catalog"), str(tmp_path / "history"))

    first = land(spark, resources, *paths, now=datetime(2026, 8, 20)).first().asDict()
    assert (first["discovered"], first["already_present"], first["attempted"]) == (3, 0, 2)
    assert (first["succeeded"], first["failed"]) == (1, 1) and first["bytes_installed"] > 0
    latest = latest_snapshot(spark, bronze)
    assert latest.version == "gtfs_fp2026_20260805"
    assert sorted(load_tables(spark, latest)) == ["calendar_dates", "routes", "stop_times", "stops", "trips"]

    write(unpacked / "gtfs_fp2026_20260812" / "routes.txt", "route_id\n1\n")
    second = land(spark, resources, *paths, now=datetime(2026, 8, 21)).first().asDict()
    assert (second["already_present"], second["attempted"], second["succeeded"]) == (1, 1, 1)
    history = spark.read.parquet(paths[3]).where("version = '20260812'").orderBy("recorded_at").collect()
    assert [(r["state"], r["attempt"], r["last_error"]) for r in history] == [("failed", 1, "missing routes.txt"), ("published", 2, None)]

    third = land(spark, resources, *paths, now=datetime(2026, 8, 22)).first().asDict()
    assert (third["already_present"], third["attempted"], third["bytes_installed"]) == (2, 0, 0)


def test_a_bad_version_stops_no_other(spark, tmp_path):
    unpacked, bronze = tmp_path / "unpacked", tmp_path / "bronze"
    listing = LISTING.replace("2026-08-12", "2026-08-06").replace("20250101", "20260807")
    for day in ("05", "06", "07"):
        for name in ("stops", "trips", "routes", "stop_times", "calendar_dates"):
            ragged = "1,2,3\n" if (day, name) == ("06", "trips") else "1\n"
            write(unpacked / f"gtfs_fp2026_202608{day}" / f"{name}.txt", f"{name}_id\n{ragged}")
    (bronze / ".staging/gtfs_fp2026_20260807/ghost.parquet").mkdir(parents=True)
    paths = (str(unpacked), str(bronze), str(tmp_path / "catalog"), str(tmp_path / "history"))
    stale = (("20260806", "u", "running", 4, "w", None, None, None, datetime(2026, 8, 1)), ("20250101", "u", "running", 1, "w", None, None, None, datetime(2026, 8, 1)))
    spark.createDataFrame(list(stale), HISTORY_SCHEMA).write.parquet(paths[3])
    resources = catalog.parse_resources(catalog.listed_resources(frame(spark, "body string", [(listing,)])))
    done = land(spark, resources, *paths, now=datetime(2026, 8, 20)).first()
    assert (done["attempted"], done["succeeded"], done["failed"]) == (3, 2, 1)
    latest = latest_snapshot(spark, str(bronze))
    assert latest.version == "gtfs_fp2026_20260807" and "ghost" not in load_tables(spark, latest)
    now = {r["version"]: (r["state"], r["attempt"]) for r in current_history(spark, paths[3]).collect()}
    assert now == {"20260805": ("published", 1), "20260806": ("failed", 5), "20260807": ("published", 1), "20250101": ("queued", 1)}
    before = spark.read.parquet(paths[3]).count()
    again = land(spark, resources, *paths, now=datetime(2026, 8, 21)).first()
    assert (again["attempted"], again["failed"]) == (1, 1)
    assert spark.read.parquet(paths[3]).count() == before + 1  # what was recovered is not recovered again
