"""Manifests: what is published under which name, and which data folder holds it.

Data folders are written once, below `_data`, and never changed or moved. Publishing is one small
file: the next manifest, which lists every published name with its folder. A reader takes the newest
manifest, so it sees all of a publish or nothing of it, also on stores where a folder cannot be
renamed; a job that fails before the manifest leaves what was published as it was. One publisher
at a time is assumed: a second one that commits meanwhile finds its number taken and fails.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession

from transitspark.sources import files

_MANIFEST = re.compile(r"^(\d{12})\.json$")


def _folder(root: str) -> str:
    return f"{root.rstrip('/')}/_manifests"


def new_data(root: str, name: str) -> str:
    """A fresh folder for data that is to be published; its last part is `name`."""
    return f"{root.rstrip('/')}/_data/{uuid.uuid4().hex}/{name}"


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return [int(m[1]) for m in (_MANIFEST.match(e.name) for e in files.children(spark, _folder(root))) if m]


def _read(spark: SparkSession, root: str, number: int) -> dict[str, str]:
    return json.loads(files.read_text(spark, f"{_folder(root)}/{number:012d}.json"))["published"]


def published(spark: SparkSession, root: str) -> dict[str, str]:
    """Full paths of the data folders of the newest manifest, by published name."""
    numbers = _numbers(spark, root)
    if not numbers:
        return {}
    return {name: f"{root.rstrip('/')}/{path}" for name, path in _read(spark, root, max(numbers)).items()}


def commit(spark: SparkSession, root: str, changes: Mapping[str, str | None]) -> int:
    """Publishes folders under names, or takes names out (None), all at once; the manifest's number."""
    base = root.rstrip("/") + "/"
    numbers = _numbers(spark, root)
    number = max(numbers, default=0)
    now = _read(spark, root, number) if numbers else {}
    now |= {name: path and path.removeprefix(base) for name, path in changes.items()}
    text = json.dumps({"published": {name: path for name, path in sorted(now.items()) if path}}, indent=1)
    files.write_new(spark, f"{_folder(root)}/{number + 1:012d}.json", text)
    return number + 1


def prune(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Removes data no longer listed by the newest `keep` manifests, and older manifests.

    Readers that began before those manifests must be done, and no publish may be under way.
    """
    numbers = sorted(_numbers(spark, root))
    paths = {path for n in numbers[-keep:] for path in _read(spark, root, n).values()}
    listed = {path.split("/")[1] for path in paths}
    for n in numbers[:-keep]:
        # a folder may hold the parts of several names, of which some are still published
        for path in set(_read(spark, root, n).values()) - paths:
            files.remove_folder(spark, f"{root.rstrip('/')}/{path}")
        files.remove_folder(spark, f"{_folder(root)}/{n:012d}.json")
    for entry in files.children(spark, f"{root.rstrip('/')}/_data"):
        if entry.name not in listed:
            files.remove_folder(spark, entry.path)
