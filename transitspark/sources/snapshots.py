"""Snapshots: folders of Parquet tables, one per published version."""

from __future__ import annotations

import re
from collections.abc import Collection
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitspark.sources import files, manifest

VERSION = "snapshot_version"
_SUFFIX = re.compile(r"(\d{8})$")


class Snapshot(NamedTuple):
    version: str
    path: str


def release_date(name: str) -> str:
    """The 8-digit version at the end of a folder name, or the name itself."""
    found = _SUFFIX.search(name)
    return found.group(1) if found else name


def snapshots(spark: SparkSession, root: str) -> list[Snapshot]:
    """All published snapshots by name, oldest first: those of the newest manifest, and plain folders.

    Hidden folders and `latest` are reserved.
    """
    found = {
        e.name: e.path
        for e in files.children(spark, root)
        if e.is_dir and not e.name.startswith((".", "_")) and e.name != "latest"
    }
    found |= manifest.published(spark, root)
    return [Snapshot(name, path) for name, path in sorted(found.items())]


def latest_snapshot(spark: SparkSession, root: str) -> Snapshot:
    """The newest snapshot by release date: `latest` is a query over what is published."""
    found = snapshots(spark, root)
    if not found:
        raise FileNotFoundError(f"no published snapshot below {root}")
    return max(found, key=lambda s: (release_date(s.version), s.version))


def table_paths(spark: SparkSession, snapshot: Snapshot) -> dict[str, str]:
    suffix = ".parquet"
    return {
        e.name[: -len(suffix)]: e.path
        for e in files.children(spark, snapshot.path)
        if e.name.endswith(suffix)
    }


def load_tables(spark: SparkSession, snapshot: Snapshot) -> dict[str, DataFrame]:
    """Every Parquet table of a snapshot by name; whatever the feed ships is there."""
    return {n: spark.read.parquet(p) for n, p in table_paths(spark, snapshot).items()}


def describe_history(
    spark: SparkSession, found: list[Snapshot], names: Collection[str] | None = None
) -> dict[str, dict[str, list[str]]]:
    """Which tables (or which of the named ones) each snapshot has, and with which columns.

    A table read over all snapshots has every column any of them has, so what one of them lacks
    shows only here. Reads footers, several files at a time. A table that cannot be opened
    counts as not there, so one broken file costs its own version only.
    """
    wanted = [
        (s.version, name, path)
        for s in found
        for name, path in table_paths(spark, s).items()
        if names is None or name in names
    ]

    def columns_of(item: tuple[str, str, str]) -> list[str] | None:
        try:
            return list(spark.read.parquet(item[2]).columns)
        except (PySparkException, Py4JJavaError):
            return None

    with ThreadPoolExecutor(8) as pool:
        columns = list(pool.map(columns_of, wanted))
    layout: dict[str, dict[str, list[str]]] = {s.version: {} for s in found}
    for (version, name, _), have in zip(wanted, columns):
        if have is not None:
            layout[version][name] = have
    return layout


def load_history(
    spark: SparkSession, found: list[Snapshot], layout: dict[str, dict[str, list[str]]] | None = None
) -> dict[str, DataFrame]:
    """Each table of all snapshots as one DataFrame with a `snapshot_version` column.

    With a `layout`, only the tables it names.
    """
    paths: dict[str, list[str]] = {}
    for snapshot in found:
        for name, path in table_paths(spark, snapshot).items():
            if layout is None or name in layout[snapshot.version]:
                paths.setdefault(name, []).append(path)
    history = {}
    for name in sorted(paths):
        df = spark.read.option("mergeSchema", "true").parquet(*paths[name])
        # by plain searches, as this is done for every row
        folder = F.substring_index(F.substring_index("_metadata.file_path", f"/{name}.parquet", 1), "/", -1)
        history[name] = df.select("*", folder.alias(VERSION))
    return history
