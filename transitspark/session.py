"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from transitspark.sources.files import remove_folder

# What a session needs for results to be right and plans to adapt; sizes stay with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A one-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("transitspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def local_rows(spark: SparkSession, schema: T.StructType, rows: Sequence[tuple]) -> DataFrame:
    """A few driver-side rows as a DataFrame; through Arrow they need no Python worker."""
    columns = list(zip(*rows)) if rows else [()] * len(schema.fields)
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(c, type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own: on a cluster a
    machine-local folder is lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="transitspark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def rewritten(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the scratch folder and read back.

    Cuts the lineage on shared storage, so the rows survive the loss of any executor. Later joins
    see the true file size, so Spark's own broadcast threshold decides on facts instead of on the
    size of an unfiltered input.
    """
    path = scratch_path(df.sparkSession, label)
    passing = _PASSING.get()
    if passing is not None:
        passing.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders to remove when the `settled` they were written in is done.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """`make()` written and read back; what it had `rewritten` on the way goes, so steps need not all fit the disk at once."""
    inner: list[str] = []
    token = _PASSING.set(inner)
    try:
        df = make()
    finally:
        _PASSING.reset(token)
    out = rewritten(df, label)
    for path in inner:
        remove_folder(spark, path)
    return out


class Rounds:
    """Results of an iteration on shared storage: each round replaces the one before it.

    A round is read only to compute the next one, so its folder goes away once that is written;
    the folder of the last round stays for whoever reads the result.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self._spark, self._root, self._number = spark, scratch_path(spark, label), 0

    def keep(self, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
        """`df` as written, and aggregates taken by the job that wrote it."""
        seen = Observation()
        path = f"{self._root}/{self._number}"
        df.observe(seen, *[m.alias(n) for n, m in measures.items()]).write.parquet(path)
        if self._number:
            remove_folder(self._spark, f"{self._root}/{self._number - 1}")
        self._number += 1
        return self._spark.read.schema(df.schema).parquet(path), seen.get
