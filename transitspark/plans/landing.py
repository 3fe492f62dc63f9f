"""Landing of unpacked archives: plan the versions, check members, convert, publish, record."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitspark.config import DEFAULT_CUTOFF
from transitspark.operators import versions
from transitspark.session import local_rows, rewritten
from transitspark.sources import files, manifest, publish
from transitspark.sources.members import convert_members, member_inventory, member_verdicts
from transitspark.sources.snapshots import Snapshot

ERROR_CHARS = 2000
# corrections come before what the same run then does with a version
BEFORE = timedelta(microseconds=1)
S, L, I, TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


VERSIONS = _schema(version=S)
CATALOG_SCHEMA = _schema(
    version=S, source_url=S, downloaded_at=TS, archive_size_bytes=L, extract_path=S, status=S
)
HISTORY_SCHEMA = _schema(
    version=S, source_url=S, state=S, attempt=I, worker_id=S, started_at=TS, completed_at=TS,
    last_error=S, recorded_at=TS,
)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if files.exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return local_rows(spark, schema, [])


def current_history(spark: SparkSession, path: str) -> DataFrame:
    """The newest record of each version; the table itself only grows."""
    rows = _read(spark, path, HISTORY_SCHEMA)
    record = F.struct(*versions.HISTORY)
    latest = rows.groupBy("version").agg(F.max_by(record, "recorded_at").alias("r"))
    return latest.select("version", "r.*")


def store_corrections(plan: DataFrame, history_path: str, now: datetime) -> None:
    """Records the plan changed without work of ours: recovered ones, and installed ones not marked so."""
    changed = F.col("recovered") | ((F.col("action") == versions.KEEP) & F.col("completed_at").eqNullSafe(F.lit(now)))
    rows = plan.where(changed & F.col("state").isNotNull()).withColumn("recorded_at", F.lit(now - BEFORE))
    if not rows.isEmpty():
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in HISTORY_SCHEMA]
        rows.select(*typed).write.mode("append").parquet(history_path)


def _converted(spark: SparkSession, unpacked: str, bronze_root: str, name: str) -> Snapshot:
    """One unpacked folder converted and published; nothing left over from before goes along."""
    folder = manifest.new_data(bronze_root, name)
    convert_members(spark, unpacked, folder)
    return publish.publish(spark, bronze_root, name, folder)


def land(
    spark: SparkSession,
    resources: DataFrame,
    unpacked_root: str,
    bronze_root: str,
    catalog_path: str,
    history_path: str,
    now: datetime,
    cutoff: str | None = DEFAULT_CUTOFF,
) -> DataFrame:
    """Lands every version the plan wants and whose unpacked folder passes the member rules.

    `resources`: parsed catalogue (`sources.catalog.parse_resources`). `unpacked_root` holds one
    folder of CSV members per `snapshot_dir`. Corrections the plan makes to older records are
    stored first. Each version is landed on its own, its members side by side: one that cannot be
    read is recorded as failed with the reason and stops no other. A version's records are
    written as soon as it is done. Returns the summary of the run.
    """
    upstream = versions.unique_upstream(resources) if "position" in resources.columns else resources
    before = _read(spark, catalog_path, CATALOG_SCHEMA)
    # kept as it is now: the catalogue grows during the run
    installed_before = rewritten(before.select("version"), "installed")
    plan = versions.plan_versions(
        upstream, installed_before, current_history(spark, history_path), F.lit(now), cutoff
    )
    plan = rewritten(plan, "plan")
    store_corrections(plan, history_path, now)
    eligible = versions.eligible_versions(plan).select("version").join(upstream, "version")
    folders = [r["snapshot_dir"] for r in eligible.select("snapshot_dir").collect()]
    verdicts = member_verdicts(member_inventory(spark, unpacked_root, folders))
    wanted = (
        versions.eligible_versions(plan)
        .select("version", "source_url", "attempt")
        .join(upstream.select("version", "snapshot_dir"), "version")
        .join(verdicts.withColumnRenamed("snapshot", "snapshot_dir"), "snapshot_dir", "left")
        .orderBy("version")
        .collect()
    )

    def one(row: Row) -> tuple[str, str | None]:
        name, error = row["snapshot_dir"], row["first_problem"]
        if row["passed"] is None:
            error = "no unpacked folder"
        if error is None:
            try:
                final = _converted(spark, f"{unpacked_root.rstrip('/')}/{name}", bronze_root, name)
            except Exception as problem:  # whatever is wrong with one version is that version's record
                error = f"{type(problem).__name__}: {problem}"[:ERROR_CHARS]
        if error is None:
            size = sum(e.length for e in files.children(spark, f"{unpacked_root.rstrip('/')}/{name}"))
            entry = (row["version"], row["source_url"], now, size, final.path, "verified")
            local_rows(spark, CATALOG_SCHEMA, [entry]).write.mode("append").parquet(catalog_path)
        state = versions.FAILED if error else versions.PUBLISHED
        record = (row["version"], row["source_url"], state, row["attempt"] + 1, None, now, now, error, now)
        local_rows(spark, HISTORY_SCHEMA, [record]).write.mode("append").parquet(history_path)
        return row["version"], error

    records = [one(row) for row in wanted]
    attempted = local_rows(spark, VERSIONS, [(r[0],) for r in records])
    failed = local_rows(
        spark, VERSIONS, [(version,) for version, error in records if error]
    )
    after = _read(spark, catalog_path, CATALOG_SCHEMA)
    return versions.run_summary(upstream, installed_before, after, attempted, failed, cutoff)
