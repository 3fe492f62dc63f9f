"""Publishing of finished snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitspark.operators.explore import labelled_counts
from transitspark.sources import files, manifest
from transitspark.sources.snapshots import VERSION, Snapshot, snapshots


def write_artifact(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes one artifact and returns it as read back from what was written."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(spark: SparkSession, root: str, version: str, folder: str) -> Snapshot:
    """Publishes the data folder of a version (`manifest.new_data`), in place of an older copy.

    There is no pointer to move: `published_latest` only ever looks at what is published, so an
    older version published later does not take its place.
    """
    manifest.commit(spark, root, {version: folder})
    return Snapshot(version, folder)


def published_latest(spark: SparkSession, root: str) -> str | None:
    """Name of the newest published snapshot: the greatest name wins."""
    names = [s.version for s in snapshots(spark, root)]
    return max(names) if names else None


class HistoryWriter:
    """Artifacts of many versions, written first and published together by one manifest.

    A history table is published partition by partition, under `<artifact>/<version>`.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._spark, self._root, self._changes = spark, root, {}

    def write(self, df: DataFrame, name: str, versions: Sequence[str]) -> DataFrame:
        """Writes one artifact of the given versions and returns it as written.

        The versions are to be replaced, also where they have no rows any more; others stay. The rebalance hint
        lets AQE cut a large version into several files and put small ones together, instead
        of one task per version.
        """
        folder = manifest.new_data(self._root, name)
        df.hint("rebalance", VERSION).write.option("compression", "zstd").partitionBy(VERSION).parquet(folder)
        written = {e.name.removeprefix(f"{VERSION}="): e.path for e in files.children(self._spark, folder) if e.is_dir}
        for version in versions:
            path = f"{folder}/{VERSION}={version}" if version in written else None
            self._changes[f"{name}/{version}"] = path
        return self._spark.read.schema(df.schema).parquet(folder).select(*df.columns)

    def withdraw(self, versions: Sequence[str]) -> None:
        """Takes versions out of every table."""
        gone = set(versions)
        names = [n for n in manifest.published(self._spark, self._root) if n.rpartition("/")[2] in gone]
        self._changes |= dict.fromkeys(names)

    def commit(self) -> None:
        if self._changes:
            manifest.commit(self._spark, self._root, self._changes)


def read_history(spark: SparkSession, root: str, name: str, versions: Sequence[str] | None = None) -> DataFrame:
    """A published history table with its `snapshot_version`; only the given versions' files are read."""
    paths = {
        n.rpartition("/")[2]: path
        for n, path in manifest.published(spark, root).items()
        if n.rpartition("/")[0] == name
    }
    wanted = [path for version, path in sorted(paths.items()) if versions is None or version in versions]
    if not wanted:
        raise FileNotFoundError(f"no published {name!r} below {root}")
    version = F.regexp_extract("_metadata.file_path", rf"/{VERSION}=([^/]+)/", 1)
    return spark.read.option("mergeSchema", "true").parquet(*wanted).withColumn(VERSION, version)


def artifact_counts(artifacts: dict[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Rows per artifact (and version) of what was written; counts come from Parquet footers."""
    if not by:
        return labelled_counts(artifacts, "artifact")
    parts = [
        df.groupBy(*by).agg(F.count(F.lit(1)).alias("value")).select(
            *by, F.lit(name).alias("artifact"), "value"
        )
        for name, df in artifacts.items()
    ]
    return reduce(DataFrame.unionByName, parts)
