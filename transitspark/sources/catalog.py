"""The publisher's catalogue and the records kept beside installed snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitspark.functions import names

_LISTING = (
    "struct<success:boolean,error:string,result:struct<resources:array<struct<"
    "url:string,format:string,last_modified:string,hash:string>>>>"
)
_SIDECAR = (
    "struct<version:string,source_url:string,downloaded_at:string,archive_size_bytes:bigint,"
    "archive_sha256:string,publisher_last_modified:string,etag:string,extract_path:string,"
    "status:string>"
)


def listed_resources(bodies: DataFrame, body: str = "body", by: Sequence[str] = ()) -> DataFrame:
    """Resources of catalogue answers (JSON text) in listed order; a failed answer has none."""
    parsed = bodies.select(*by, F.from_json(body, _LISTING).alias("b")).where(F.col("b.success"))
    entries = parsed.select(*by, F.posexplode("b.result.resources").alias("position", "r"))
    return entries.select(*by, "position", "r.*")


def parse_resources(resources: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Zip resources with a readable name: prefix, version, folder name and metadata."""
    url = F.col("url")
    # both conditions look at the address itself: one pattern each, nothing is taken apart twice
    found = resources.where(names.is_zip(F.col("format"), url) & names.has_version(url)).select(
        *by,
        *[c for c in ("position",) if c in resources.columns],
        names.file_version(url).alias("version"),
        names.file_prefix(url).alias("name_prefix"),
        url.alias("download_url"),
        names.last_segment(url).alias("original_filename"),
        names.blank_to_null(F.col("last_modified")).alias("publisher_last_modified"),
        names.blank_to_null(F.col("hash")).alias("upstream_hash"),
    )
    folder = names.snapshot_dir(F.col("name_prefix"), F.col("version"))
    return found.withColumn("snapshot_dir", folder)


def installed_snapshots(sidecars: DataFrame, body: str = "body", by: Sequence[str] = ()) -> DataFrame:
    """Snapshots with a valid record (JSON text); a broken or partial one is not installed."""
    parsed = sidecars.select(*by, F.from_json(body, _SIDECAR).alias("s")).select(*by, "s.*")
    instant = F.col("downloaded_at").try_cast("timestamp")
    needed = ["version", "source_url", "archive_sha256", "extract_path"]
    valid = instant.isNotNull() & (F.col("archive_size_bytes") >= 0)
    for column in needed:
        valid = valid & F.col(column).isNotNull()
    valid = valid & F.col("status").isin("verified", "failed")
    return parsed.where(valid).withColumn("downloaded_at", instant)


def checksum_verdicts(archives: DataFrame) -> DataFrame:
    """Adds `checksum`: `ok`, `skipped` or `mismatch` of the published against our own hash."""
    verdict = names.hash_verdict(F.col("upstream_hash"), F.col("archive_sha256"))
    return archives.withColumn("checksum", verdict)
