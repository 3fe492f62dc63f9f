"""Folder operations through Hadoop's file system layer, so any supported store works."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import SparkSession


class Entry(NamedTuple):
    name: str
    path: str
    is_dir: bool
    length: int


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def children(spark: SparkSession, path: str) -> list[Entry]:
    """Entries of a folder by name; an absent folder has none."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return []
    found = [
        Entry(s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getLen())
        for s in fs.listStatus(target)
    ]
    return sorted(found)


def below(spark: SparkSession, path: str) -> list[Entry]:
    """All files at any depth below a folder, named by their path relative to it."""
    fs, target = _fs(spark, path)
    base = fs.makeQualified(target).toString().rstrip("/") + "/"
    listed, found = fs.listFiles(target, True), []
    while listed.hasNext():
        status = listed.next()
        full = status.getPath().toString()
        found.append(Entry(full.removeprefix(base), full, False, status.getLen()))
    return sorted(found)


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def read_text(spark: SparkSession, path: str) -> str:
    """The content of a small file."""
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole or not at all; an error if it is there already."""
    fs, target = _fs(spark, path)
    fs.mkdirs(target.getParent())
    _, aside = _fs(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise FileExistsError(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)
