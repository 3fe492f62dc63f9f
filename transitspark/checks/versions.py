"""Catalogue queries: listings, plans of versions, status, member and record rules.

Orders play published resources: a customer is a feed, an order date a version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitspark.checks.registry import query
from transitspark.checks.roles import table
from transitspark.operators import versions
from transitspark.sources import catalog, members

CUTOFF = "19970101"

_URL = """concat('https://data.example/', o_orderkey, '/GTFS_FP', date_format(o_orderdate, 'yyyy'), '_',
  CASE o_orderstatus WHEN 'F' THEN date_format(o_orderdate, 'yyyy-MM-dd')
                     WHEN 'O' THEN date_format(o_orderdate, 'yyyyMMdd') ELSE 'README' END,
  CASE o_orderpriority WHEN '1-URGENT' THEN '.zip' WHEN '2-HIGH' THEN '.ZIP' WHEN '3-MEDIUM' THEN '.Zip' ELSE '' END)"""
_RESOURCE_SQL = """
listed AS (
  SELECT o_custkey feed, o_orderkey position, o_orderkey, o_totalprice,
    'https://data.example/' || o_orderkey || '/GTFS_FP' || strftime(o_orderdate, '%Y') || '_' ||
    CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'O' THEN strftime(o_orderdate, '%Y%m%d') ELSE 'README' END ||
    CASE o_orderpriority WHEN '1-URGENT' THEN '.zip' WHEN '2-HIGH' THEN '.ZIP' WHEN '3-MEDIUM' THEN '.Zip' ELSE '' END url,
    CASE WHEN o_totalprice < 100000 THEN 'Zip' WHEN o_totalprice < 200000 THEN 'CSV' END format,
    CASE WHEN o_totalprice > 50000 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END last_modified,
    CASE WHEN o_totalprice < 80000 THEN '' WHEN o_totalprice < 120000 THEN 'deadbeef' WHEN o_totalprice < 160000 THEN NULL
         ELSE upper(sha256(CAST(o_orderkey AS VARCHAR))) END hash
  FROM orders),
parsed AS (
  SELECT *, regexp_extract(url, '[^/]*$') fn,
    regexp_replace(regexp_extract(url, '[^/]*$'), '\\.(zip|ZIP)$', '') stem FROM listed
  WHERE lower(format) = 'zip' OR lower(url) LIKE '%.zip'),
resources AS (
  SELECT feed, position, replace(regexp_extract(stem, '^(.*)_([^_]*)$', 2), '-', '') AS version,
    lower(regexp_extract(stem, '^(.*)_([^_]*)$', 1)) name_prefix, url download_url, fn original_filename,
    nullif(last_modified, '') publisher_last_modified, nullif(hash, '') upstream_hash
  FROM parsed WHERE regexp_full_match(replace(regexp_extract(stem, '^(.*)_([^_]*)$', 2), '-', ''), '[0-9]{8}'))"""

_TABLES_SQL = """
upstream AS (SELECT o_custkey feed, strftime(o_orderdate, '%Y%m%d') AS version, 'https://u/' || MAX(o_orderkey) download_url
  FROM orders WHERE o_totalprice > 120000 GROUP BY 1, 2),
installed AS (SELECT o_custkey feed, strftime(o_orderdate, '%Y%m%d') AS version,
  CASE WHEN MIN(o_totalprice) < 20000 THEN 'failed' ELSE 'verified' END status,
  '/data/' || o_custkey || '/gtfs_' || strftime(o_orderdate, '%Y%m%d') extract_path, CAST(SUM(o_orderkey) AS BIGINT) archive_size_bytes
  FROM orders WHERE o_totalprice < 250000 GROUP BY 1, 2, 4),
history AS (
  SELECT o_custkey feed, strftime(o_orderdate, '%Y%m%d') AS version, 'https://h/' || o_orderkey source_url,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'running' WHEN '2-HIGH' THEN 'failed' WHEN '3-MEDIUM' THEN 'published'
      WHEN '5-LOW' THEN 'queued' ELSE 'discovered' END state,
    CAST(o_orderkey % 5 AS INT) attempt, CASE WHEN o_orderpriority = '1-URGENT' THEN 'worker-1' END worker_id,
    'started ' || o_orderkey started_at, 'completed ' || o_orderkey completed_at,
    CASE WHEN o_orderpriority = '2-HIGH' THEN 'boom' END last_error
  FROM orders WHERE o_totalprice BETWEEN 200000 AND 400000
  QUALIFY row_number() OVER (PARTITION BY feed, version ORDER BY o_orderkey DESC) = 1)"""
_PLAN_SQL = f"""
met AS (
  SELECT COALESCE(u.feed, h.feed) feed, COALESCE(u.version, h.version) AS version, u.feed IS NOT NULL listed, h.feed IS NOT NULL known,
    i.feed IS NOT NULL there, download_url, COALESCE(state = 'running', false) stale, COALESCE(state = 'published', false) pub, h.* EXCLUDE (feed, version)
  FROM upstream u FULL JOIN history h ON u.feed = h.feed AND u.version = h.version
  LEFT JOIN (SELECT DISTINCT feed, version FROM installed) i ON i.feed = COALESCE(u.feed, h.feed) AND i.version = COALESCE(u.version, h.version)),
plan AS (
  SELECT feed, version,
    CASE WHEN NOT listed THEN 'keep' WHEN version < '{CUTOFF}' THEN 'ignore' WHEN there THEN 'keep' WHEN pub THEN 'diverged' ELSE 'process' END action,
    CASE WHEN listed AND version >= '{CUTOFF}' AND there THEN 'published'
         WHEN listed AND version >= '{CUTOFF}' AND NOT pub THEN 'queued' WHEN stale THEN 'queued' ELSE state END state,
    CASE WHEN known THEN source_url WHEN listed AND version >= '{CUTOFF}' THEN download_url END source_url,
    CASE WHEN known THEN attempt WHEN listed AND version >= '{CUTOFF}' THEN 0 END attempt,
    CASE WHEN stale OR (listed AND version >= '{CUTOFF}' AND there AND NOT pub) THEN NULL ELSE worker_id END worker_id,
    CASE WHEN NOT stale THEN started_at END started_at,
    CASE WHEN listed AND version >= '{CUTOFF}' AND there AND NOT pub THEN 'now' ELSE completed_at END completed_at,
    last_error, stale recovered
  FROM met)"""


def _with(body: str, *parts: str) -> str:
    return f"WITH {', '.join(parts)} {body}"


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    digest = F.upper(F.sha2(F.col("o_orderkey").cast("string"), 256))
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("feed"),
        F.col("o_orderkey").alias("position"),
        F.expr(_URL).alias("url"),
        F.when(price < 100000, F.lit("Zip")).when(price < 200000, F.lit("CSV")).alias("format"),
        F.when(price > 50000, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("")).alias("last_modified"),
        F.when(price < 80000, F.lit(""))
        .when(price < 120000, F.lit("deadbeef"))
        .when(price < 160000, F.lit(None).cast("string"))
        .otherwise(digest)
        .alias("hash"),
    )


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumns(
        {"feed": F.col("o_custkey"), "version": F.date_format("o_orderdate", "yyyyMMdd")}
    )


def _upstream(spark: SparkSession, sf: str) -> DataFrame:
    listed = _orders(spark, sf).where(F.col("o_totalprice") > 120000).select(
        "feed",
        "version",
        F.col("o_orderkey").alias("position"),
        F.concat(F.lit("https://u/"), "o_orderkey").alias("download_url"),
    )
    return versions.unique_upstream(listed, ["feed"])


def _installed(spark: SparkSession, sf: str) -> DataFrame:
    rows = _orders(spark, sf).where(F.col("o_totalprice") < 250000).groupBy("feed", "version")
    return rows.agg(
        F.when(F.min("o_totalprice") < 20000, F.lit("failed")).otherwise(F.lit("verified")).alias("status"),
        F.sum("o_orderkey").alias("archive_size_bytes"),
    ).withColumn(
        "extract_path", F.concat(F.lit("/data/"), "feed", F.lit("/gtfs_"), "version")
    )


def _history(spark: SparkSession, sf: str) -> DataFrame:
    priority, key = F.col("o_orderpriority"), F.col("o_orderkey")
    states = {"1-URGENT": "running", "2-HIGH": "failed", "3-MEDIUM": "published", "5-LOW": "queued"}
    state = F.lit("discovered")
    for name, value in states.items():
        state = F.when(priority == name, F.lit(value)).otherwise(state)
    rows = _orders(spark, sf).where(F.col("o_totalprice").between(200000, 400000)).select(
        "feed",
        "version",
        F.struct(
            F.concat(F.lit("https://h/"), key).alias("source_url"),
            state.alias("state"),
            (key % 5).cast("int").alias("attempt"),
            F.when(priority == "1-URGENT", F.lit("worker-1")).alias("worker_id"),
            F.concat(F.lit("started "), key).alias("started_at"),
            F.concat(F.lit("completed "), key).alias("completed_at"),
            F.when(priority == "2-HIGH", F.lit("boom")).alias("last_error"),
        ).alias("r"),
        key.alias("k"),
    )
    latest = rows.groupBy("feed", "version").agg(F.max_by("r", "k").alias("r"))
    return latest.select("feed", "version", "r.*")


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    return versions.plan_versions(
        _upstream(spark, sf), _installed(spark, sf), _history(spark, sf), F.lit("now"), CUTOFF, ["feed"]
    )


@query("catalog_parse", _with("SELECT *, name_prefix || '_' || version snapshot_dir FROM resources", _RESOURCE_SQL))
def catalog_parse(spark, sf):
    return catalog.parse_resources(_listed(spark, sf), ["feed"])


@query(
    "catalog_listing",
    _with(
        "SELECT feed, o_orderkey answer, CAST(0 AS INT) position, url, format, last_modified, hash FROM listed WHERE NOT o_totalprice > 300000 "
        "UNION ALL SELECT feed, o_orderkey, 1, url || '.zip', 'zip', NULL, NULL FROM listed WHERE NOT o_totalprice > 300000",
        _RESOURCE_SQL,
    ),
)
def catalog_listing(spark, sf):
    """Catalogue answers as JSON text, two resources each; a failed answer lists none."""
    entry = F.struct("url", "format", "last_modified", "hash")
    extra = F.struct(
        F.concat("url", F.lit(".zip")).alias("url"),
        F.lit("zip").alias("format"),
        F.lit(None).cast("string").alias("last_modified"),
        F.lit(None).cast("string").alias("hash"),
    )
    price = table(spark, sf, "orders").select(F.col("o_orderkey").alias("position"), "o_totalprice")
    body = F.to_json(
        F.struct(
            (~(F.col("o_totalprice") > 300000)).alias("success"),
            F.struct(F.array(entry, extra).alias("resources")).alias("result"),
        )
    )
    answers = _listed(spark, sf).join(price, "position").select(
        "feed", F.col("position").alias("answer"), body.alias("body")
    )
    return catalog.listed_resources(answers, by=["feed", "answer"])


@query(
    "checksum_verdict",
    _with(
        "SELECT position, CASE WHEN hash IS NULL OR NOT regexp_full_match(hash, '[0-9a-fA-F]{64}') THEN 'skipped' "
        "WHEN lower(hash) = CASE WHEN o_totalprice < 300000 THEN sha256(CAST(position AS VARCHAR)) ELSE 'other' END THEN 'ok' ELSE 'mismatch' END checksum FROM listed",
        _RESOURCE_SQL,
    ),
)
def checksum_verdict(spark, sf):
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    own = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("position"),
        F.when(F.col("o_totalprice") < 300000, digest).otherwise(F.lit("other")).alias("archive_sha256"),
    )
    archives = _listed(spark, sf).select("position", F.col("hash").alias("upstream_hash"))
    return catalog.checksum_verdicts(archives.join(own, "position")).select("position", "checksum")


@query(
    "version_cutoff",
    _with(f"SELECT feed, version, download_url FROM upstream WHERE version >= '{CUTOFF}'", _TABLES_SQL),
)
def version_cutoff(spark, sf):
    return versions.after_cutoff(_upstream(spark, sf), CUTOFF).select("feed", "version", "download_url")


@query("reconcile_plan", _with("SELECT * FROM plan", _TABLES_SQL, _PLAN_SQL))
def reconcile_plan(spark, sf):
    return _plan(spark, sf)


@query(
    "eligible_versions",
    _with("SELECT feed, version, attempt FROM plan WHERE action = 'process'", _TABLES_SQL, _PLAN_SQL),
)
def eligible_versions(spark, sf):
    return versions.eligible_versions(_plan(spark, sf), ["feed"]).select("feed", "version", "attempt")


@query(
    "already_present",
    _with(f"SELECT COUNT(*) n FROM upstream WHERE version >= '{CUTOFF}' AND (feed, version) IN (SELECT (feed, version) FROM installed)", _TABLES_SQL),
)
def already_present(spark, sf):
    found = versions.already_present(_upstream(spark, sf), _installed(spark, sf), CUTOFF, ["feed"])
    return found.agg(F.count(F.lit(1)).alias("n"))


_FAILED = """bad AS (SELECT DISTINCT feed, version FROM history WHERE state = 'failed')"""


@query(
    "manifest_status",
    _with(
        """SELECT COALESCE(i.feed, b.feed) feed, COALESCE(i.version, b.version) AS version,
        CASE WHEN b.feed IS NOT NULL THEN 'failed' WHEN i.version = l.latest THEN 'verified' ELSE 'superseded' END status,
        CASE WHEN b.feed IS NULL THEN extract_path END extract_path
        FROM installed i FULL JOIN bad b ON i.feed = b.feed AND i.version = b.version
        LEFT JOIN (SELECT feed, MAX(version) latest FROM installed WHERE status = 'verified' GROUP BY feed) l ON l.feed = i.feed""",
        _TABLES_SQL,
        _FAILED,
    ),
)
def manifest_status(spark, sf):
    bad = _history(spark, sf).where(F.col("state") == "failed")
    return versions.version_status(_installed(spark, sf), bad, ["feed"])


_POINTERS = """pointers AS (SELECT feed, 'gtfs_' || CASE WHEN feed < 500 THEN MAX(version) ELSE MIN(version) END target
  FROM installed WHERE status = 'verified' AND archive_size_bytes > 2000 GROUP BY feed)"""


@query(
    "latest_pointer_check",
    _with(
        """SELECT * FROM (SELECT COALESCE(l.feed, p.feed) feed, latest, 'gtfs_' || latest dir, target,
        CASE WHEN latest IS NULL THEN 'pointer without a verified version' WHEN target IS NULL THEN 'verified version without a pointer'
             WHEN 'gtfs_' || latest <> target THEN 'pointer names another directory' END problem
        FROM (SELECT feed, MAX(version) latest FROM installed WHERE status = 'verified' GROUP BY feed) l
        FULL JOIN pointers p ON l.feed = p.feed) WHERE problem IS NOT NULL""",
        _TABLES_SQL,
        _POINTERS,
    ),
)
def latest_pointer_check(spark, sf):
    installed = _installed(spark, sf)
    pointed = installed.where((F.col("status") == "verified") & (F.col("archive_size_bytes") > 2000))
    target = F.when(F.col("feed") < 500, F.max("version")).otherwise(F.min("version"))
    pointers = pointed.groupBy("feed").agg(F.concat(F.lit("gtfs_"), target).alias("target"))
    return versions.pointer_problems(installed, pointers, ["feed"])


@query(
    "landing_summary",
    _with(
        f"""SELECT (SELECT COUNT(*) FROM upstream) discovered,
        (SELECT COUNT(*) FROM upstream WHERE version >= '{CUTOFF}' AND (feed, version) IN (SELECT (feed, version) FROM installed WHERE status = 'failed')) already_present,
        (SELECT COUNT(*) FROM plan WHERE action = 'process') attempted, (SELECT COUNT(*) FROM bad) failed,
        (SELECT COUNT(*) FROM plan WHERE action = 'process') - (SELECT COUNT(*) FROM bad) succeeded,
        (SELECT CAST(SUM(archive_size_bytes) AS BIGINT) FROM installed WHERE status <> 'failed') bytes_installed""",
        _TABLES_SQL,
        _PLAN_SQL,
        _FAILED,
    ),
)
def landing_summary(spark, sf):
    installed = _installed(spark, sf)
    before = installed.where(F.col("status") == "failed")
    attempted = _plan(spark, sf).where(F.col("action") == versions.PROCESS)
    failed = _history(spark, sf).where(F.col("state") == "failed")
    return versions.run_summary(
        _upstream(spark, sf), before, installed, attempted, failed, CUTOFF, ["feed"]
    )


_MEMBER = """CASE l_linenumber WHEN 1 THEN 'stops.txt' WHEN 2 THEN 'Trips.txt' WHEN 3 THEN 'routes.txt' WHEN 4 THEN 'stop_times.txt'
  WHEN 5 THEN 'CALENDAR_DATES.TXT' WHEN 6 THEN 'agency.txt' ELSE 'old/calendar.txt' END"""


@query(
    "member_verdicts",
    f"""WITH inv AS (SELECT l_orderkey AS snapshot, {_MEMBER} member, CASE WHEN l_quantity < 8 THEN 0 ELSE 100 END length FROM lineitem),
    sized AS (SELECT snapshot, lower(member) m, MAX(length) size FROM inv WHERE member NOT LIKE '%/%' GROUP BY 1, 2),
    rules AS (SELECT * FROM (VALUES (1, 'stops.txt', true), (2, 'trips.txt', true), (3, 'routes.txt', true), (4, 'stop_times.txt', true),
      (5, 'calendar_dates.txt', true), (6, 'agency.txt', false), (7, 'calendar.txt', false)) v(pos, m, needed)),
    found AS (SELECT s.snapshot, pos, CASE WHEN size = 0 THEN 'empty ' || r.m ELSE 'missing ' || r.m END problem
      FROM (SELECT DISTINCT snapshot FROM inv) s CROSS JOIN rules r LEFT JOIN sized z ON z.snapshot = s.snapshot AND z.m = r.m
      WHERE size = 0 OR (size IS NULL AND needed))
    SELECT s.snapshot, COUNT(problem) = 0 passed, COALESCE(string_agg(problem, '; ' ORDER BY pos), '') problems, arg_min(problem, pos) first_problem
    FROM (SELECT DISTINCT snapshot FROM inv) s LEFT JOIN found USING (snapshot) GROUP BY s.snapshot""",
)
def member_verdicts(spark, sf):
    inventory = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("snapshot"),
        F.expr(_MEMBER).alias("member"),
        F.when(F.col("l_quantity") < 8, 0).otherwise(100).alias("length"),
    )
    found = members.member_verdicts(inventory)
    return found.withColumn("problems", F.concat_ws("; ", "problems"))


@query(
    "installed_records",
    """SELECT CAST(o_custkey AS VARCHAR) feed, strftime(o_orderdate, '%Y%m%d') AS version, o_orderkey archive_size_bytes,
    CASE WHEN o_orderstatus = 'O' THEN 'verified' ELSE 'failed' END status
    FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_totalprice < 400000""",
)
def installed_records(spark, sf):
    """Records beside snapshots: some cut short, some without a needed field, some of unknown status."""
    priority = F.col("o_orderpriority")
    body = F.to_json(
        F.struct(
            F.date_format("o_orderdate", "yyyyMMdd").alias("version"),
            F.lit("https://data.example/a.zip").alias("source_url"),
            F.when(priority != "2-HIGH", F.lit("2026-08-05T10:00:00Z")).otherwise(F.lit("soon")).alias("downloaded_at"),
            F.col("o_orderkey").alias("archive_size_bytes"),
            F.when(priority != "1-URGENT", F.lit("ab")).alias("archive_sha256"),
            F.lit("/data/x").alias("extract_path"),
            F.when(F.col("o_totalprice") >= 400000, F.lit("half"))
            .when(F.col("o_orderstatus") == "O", F.lit("verified"))
            .otherwise(F.lit("failed"))
            .alias("status"),
        )
    )
    cut = F.when(F.col("o_orderstatus") == "P", F.substring(body, 1, 60)).otherwise(body)
    records = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("feed"), cut.alias("body")
    )
    found = catalog.installed_snapshots(records, by=["feed"])
    return found.select("feed", "version", "archive_size_bytes", "status")
