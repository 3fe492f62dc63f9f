"""From landed snapshots to published city subsets: one snapshot, each in turn, or all at once."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from transitspark.config import ZONE_PREFIX, MissingInput, QualityRules
from transitspark.operators import rules as quality
from transitspark.operators.subset import city_subset
from transitspark.session import local_rows, rewritten, scratch_path
from transitspark.sources import files, manifest, publish
from transitspark.sources.snapshots import (
    VERSION,
    Snapshot,
    describe_history,
    latest_snapshot,
    load_history,
    load_tables,
    snapshots,
)

METRICS_SCHEMA = (
    T.StructType()
    .add(VERSION, T.StringType())
    .add("artifact", T.StringType())
    .add("value", T.LongType())
)


_INPUTS = ("stops", "stop_times", "trips", "routes", "calendar", "calendar_dates", "agency", "frequencies")

Layout = dict[str, dict[str, list[str]]]


def checked(
    spark: SparkSession, found: list[Snapshot], rules: QualityRules = QualityRules()
) -> tuple[DataFrame, list[Snapshot], Layout]:
    """The report over all given snapshots, those of which it says nothing, oldest first, and what each has.

    All versions are checked by one job; the report is written once and read from there. A version
    that lacks an input of the subset is in the report like one that breaks a rule.
    """
    ruled = {*rules.required, *rules.bounds}
    ruled.update(t for child, _, parent, _ in rules.foreign_keys for t in (child, parent))
    layout = describe_history(spark, found, {*ruled, *_INPUTS})
    checkable = {v: {n: c for n, c in have.items() if n in ruled} for v, have in layout.items()}
    rows = quality.quality_report(spark, load_history(spark, found, checkable), checkable, rules)
    needed = {v: {n: c for n, c in have.items() if n in _INPUTS} for v, have in layout.items()}
    report = rewritten(rows.unionByName(quality.missing_inputs(spark, needed, rules)), "report")
    versions = local_rows(spark, T.StructType().add(VERSION, T.StringType()), [(s.version,) for s in found])
    kept = {r[VERSION] for r in quality.passed_versions(versions, report).collect()}
    return report, [s for s in found if s.version in kept], layout


def publish_subset(
    spark: SparkSession, snapshot: Snapshot, silver_root: str, prefix: str = ZONE_PREFIX
) -> list[tuple[str, str, int]]:
    """Writes and publishes the subset of one snapshot; its rows per artifact."""
    folder = manifest.new_data(silver_root, snapshot.version)
    helpers = scratch_path(spark, "subset")

    def stage(name: str, df: DataFrame) -> DataFrame:
        return publish.write_artifact(df, helpers if name.startswith("_") else folder, name)

    artifacts = city_subset(load_tables(spark, snapshot), prefix, stage=stage)
    counts = publish.artifact_counts(artifacts).collect()
    publish.publish(spark, silver_root, snapshot.version, folder)
    files.remove_folder(spark, helpers)
    return [(snapshot.version, r["artifact"], r["value"]) for r in counts]


def _publish_passed(
    spark: SparkSession, found: list[Snapshot], silver_root: str, prefix: str, rules: QualityRules
) -> tuple[DataFrame, DataFrame]:
    """A version whose derivation fails is reported, and the next one goes on."""
    report, kept, _ = checked(spark, found, rules)
    rows, failures = [], {}
    for snapshot in kept:
        try:
            rows += publish_subset(spark, snapshot, silver_root, prefix)
        except (PySparkException, Py4JJavaError, MissingInput) as problem:
            failures[snapshot.version] = str(problem).splitlines()[0]
    if failures:
        report = report.unionByName(quality.failed_versions(spark, failures))
    return report, local_rows(spark, METRICS_SCHEMA, rows)


def publish_latest(
    spark: SparkSession,
    bronze_root: str,
    silver_root: str,
    prefix: str = ZONE_PREFIX,
    rules: QualityRules = QualityRules(),
) -> tuple[DataFrame, DataFrame]:
    """The newest snapshot's subset: its report, and rows per version and artifact."""
    newest = latest_snapshot(spark, bronze_root)
    return _publish_passed(spark, [newest], silver_root, prefix, rules)


def publish_each(
    spark: SparkSession,
    bronze_root: str,
    silver_root: str,
    prefix: str = ZONE_PREFIX,
    rules: QualityRules = QualityRules(),
) -> tuple[DataFrame, DataFrame]:
    """The same for every snapshot in turn, oldest first; versions that break a rule are left out."""
    return _publish_passed(spark, snapshots(spark, bronze_root), silver_root, prefix, rules)


def replay_history(
    spark: SparkSession,
    bronze_root: str,
    history_root: str,
    prefix: str = ZONE_PREFIX,
    rules: QualityRules = QualityRules(),
) -> tuple[DataFrame, DataFrame]:
    """Every snapshot in one pass: the version is part of each key, nothing loops over versions.

    Writes one table per artifact, partitioned by version, and publishes all of them by one manifest
    of `history_root` (`publish.read_history` reads them). Versions that
    break a rule or lack a table or column the subset needs are in the report, with the artifacts that
    depend on it, and are left out of every artifact, also if an earlier run wrote them; the others are published.
    Returns the report and the rows per version and artifact. With many versions this replaces
    `publish_each`, whose jobs are each too small to fill a cluster.
    """
    found = snapshots(spark, bronze_root)
    report, kept, layout = checked(spark, found, rules)
    passed = [s.version for s in kept]
    withdrawn = [s.version for s in found if s not in kept]
    writer = publish.HistoryWriter(spark, history_root)
    writer.withdraw(withdrawn)
    if not kept:
        writer.commit()
        return report, local_rows(spark, METRICS_SCHEMA, [])
    helpers = scratch_path(spark, "history")
    # only the files of versions that passed are read again
    tables = load_history(spark, kept, layout)

    def stage(name: str, df: DataFrame) -> DataFrame:
        own = publish.HistoryWriter(spark, helpers) if name.startswith("_") else writer
        return own.write(df, name, passed)

    artifacts = city_subset(tables, prefix, by=(VERSION,), stage=stage)
    writer.commit()
    files.remove_folder(spark, helpers)
    return report, publish.artifact_counts(artifacts, [VERSION])
