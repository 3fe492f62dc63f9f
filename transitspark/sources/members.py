"""Timetable members: CSV files of an unpacked archive, their inventory and conversion."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitspark.config import OPTIONAL_MEMBERS, REQUIRED_MEMBERS
from transitspark.session import local_rows
from transitspark.sources import files, quoted


def read_member(spark: SparkSession, path: str) -> DataFrame:
    """A CSV member with every column as text; a blank is null. A row of the wrong width is an error.

    Read line by line, so a large member is split over tasks. One with line breaks inside quotes is split
    too: `sources.quoted` finds out for each byte range whether it begins inside quotes.
    """
    options = {"header": True, "inferSchema": False, "quote": '"', "escape": '"', "mode": "FAILFAST"}
    if not quoted.spans_lines(spark, path):
        return spark.read.options(**options).csv(path)
    # only the header is read here
    schema = spark.read.options(**options).option("multiLine", True).csv(path).schema
    rows = quoted.records(quoted.text_lines(spark, path)).where("NOT first")
    return quoted.parsed(rows, schema)


def convert_members(spark: SparkSession, csv_dir: str, out_dir: str) -> list[str]:
    """Every `*.txt` file (any case) as a Parquet table of the same name; returns the names."""
    def convert(entry: files.Entry) -> str:
        stem = entry.name[: -len(".txt")]
        target = f"{out_dir.rstrip('/')}/{stem}.parquet"
        table = read_member(spark, entry.path)
        table.write.mode("overwrite").option("compression", "zstd").parquet(target)
        return stem

    found = [
        e
        for e in files.children(spark, csv_dir)
        if not e.is_dir and e.name.lower().endswith(".txt")
    ]
    # small members are one task each; several at a time keep the cluster busy
    with ThreadPoolExecutor(4) as pool:
        return list(pool.map(convert, found))


_INVENTORY = (
    T.StructType()
    .add("snapshot", T.StringType())
    .add("member", T.StringType())
    .add("length", T.LongType())
)


def member_inventory(spark: SparkSession, root: str, snapshots: Sequence[str] | None = None) -> DataFrame:
    """Files below each snapshot folder of `root`, or of the named ones: `snapshot`, `member`, `length`.

    A folder listing only, no content. Spark's file readers skip empty files, which are what
    the rules are after, so the listing comes from the file system itself.
    """
    rows = []
    if snapshots is None:
        snapshots = [e.name for e in files.children(spark, root) if e.is_dir]
    for snapshot in snapshots:
        folder = f"{root.rstrip('/')}/{snapshot}"
        if files.exists(spark, folder):
            rows += [(snapshot, e.name, e.length) for e in files.below(spark, folder)]
    return local_rows(spark, _INVENTORY, rows)


def member_verdicts(
    inventory: DataFrame,
    by: Sequence[str] = ("snapshot",),
    required: Sequence[str] = REQUIRED_MEMBERS,
    optional: Sequence[str] = OPTIONAL_MEMBERS,
) -> DataFrame:
    """Per snapshot: whether its members pass, all `problems`, and the first of them.

    Names are compared without case and only at the top level. One aggregate over the inventory,
    whose state is one number per rule.
    """
    top = ~F.col("member").contains("/")
    name = F.lower("member")
    sizes = {
        m: F.max(F.when(top & (name == m), F.col("length"))).alias(f"size_{m}")
        for m in (*required, *optional)
    }
    sized = inventory.groupBy(*by).agg(*sizes.values())
    checks = []
    for m in required:
        size = F.col(f"`size_{m}`")
        checks.append(
            F.when(size.isNull(), F.lit(f"missing {m}")).when(size == 0, F.lit(f"empty {m}"))
        )
    for m in optional:
        checks.append(F.when(F.col(f"`size_{m}`") == 0, F.lit(f"empty {m}")))
    found = sized.select(*by, F.array_compact(F.array(*checks)).alias("problems"))
    return found.select(
        *by,
        (F.size("problems") == 0).alias("passed"),
        "problems",
        F.get("problems", F.lit(0)).alias("first_problem"),
    )
