"""Names, versions and hashes of published snapshots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_version(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[0-9]{8}\z"), F.lit(False))


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[0-9a-fA-F]{64}\z"), F.lit(False))


def last_segment(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def is_zip(fmt: Column, url: Column) -> Column:
    """Declared as zip or named like one, in any case."""
    declared = F.coalesce(F.lower(fmt) == "zip", F.lit(False))
    return declared | F.coalesce(F.lower(url).endswith(".zip"), F.lit(False))


# a version is the part after the last underscore: 8 digits once hyphens are taken out; only
# these two spellings of the suffix count as one
_DATED = r"_(-*[0-9]){8}-*(\.zip|\.ZIP)?\z"
_DATE = r"_([0-9-]+)(\.zip|\.ZIP)?\z"
_PREFIX = r"([^/]*)_[^_/]*\z"


def has_version(name: Column) -> Column:
    """Whether a file name, or a path ending in one, carries a version."""
    return F.coalesce(name.rlike(_DATED), F.lit(False))


def file_prefix(name: Column) -> Column:
    """Lower-cased part of a file name before its last underscore."""
    return F.lower(F.regexp_extract(name, _PREFIX, 1))


def file_version(name: Column) -> Column:
    """The 8-digit version of a resource file name, or null if it has none."""
    digits = F.replace(F.regexp_extract(name, _DATE, 1), F.lit("-"), F.lit(""))
    return F.when(has_version(name), digits)


def snapshot_dir(prefix: Column, version: Column) -> Column:
    return F.concat(prefix, F.lit("_"), version)


def hash_verdict(published: Column, computed: Column) -> Column:
    """`ok`, `skipped` (nothing comparable was published) or `mismatch`."""
    return (
        F.when(~is_sha256(published), F.lit("skipped"))
        .when(F.lower(published) == F.lower(computed), F.lit("ok"))
        .otherwise(F.lit("mismatch"))
    )


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
