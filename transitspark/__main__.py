"""The jobs from the command line: `python -m transitspark latest|replay|history|land --help`.

Each check that a version does not keep is one line on standard error; the exit code is 1 if there is any.
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from transitspark.config import DEFAULT_CUTOFF, ZONE_PREFIX
from transitspark.operators.rules import VERSION, report_lines
from transitspark.plans import landing, static
from transitspark.session import SETTINGS
from transitspark.sources.catalog import listed_resources, parse_resources

SUBSET_JOBS = {
    "latest": static.publish_latest,
    "replay": static.publish_each,
    "history": static.replay_history,
}


def session() -> SparkSession:
    builder = SparkSession.builder.appName("transitspark")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def print_counts(counts: DataFrame) -> None:
    for row in counts.orderBy(*counts.columns[:2]).toLocalIterator():
        print("\t".join(map(str, row)))


def subset_job(args: argparse.Namespace) -> int:
    report, counts = SUBSET_JOBS[args.job](session(), args.bronze, args.silver, args.prefix)
    print_counts(counts)
    broken = report_lines(report).orderBy(VERSION, "ordinal").collect()
    for row in broken:
        print(f"{row[VERSION]}\t{row['line']}", file=sys.stderr)
    return int(bool(broken))


def land_job(args: argparse.Namespace) -> int:
    spark = session()
    listing = spark.read.option("wholetext", True).text(args.listing).withColumnRenamed("value", "body")
    resources = parse_resources(listed_resources(listing))
    now = datetime.now(timezone.utc)
    summary = landing.land(spark, resources, args.unpacked, args.bronze, args.catalog, args.history, now, args.cutoff).first()
    for name, value in summary.asDict().items():
        print(f"{name}\t{value}")
    return int(summary["failed"] > 0)


def main(argv: list[str] | None = None) -> int:
    commands = argparse.ArgumentParser(prog="python -m transitspark")
    jobs = commands.add_subparsers(dest="job", required=True)
    for name, job in SUBSET_JOBS.items():
        one = jobs.add_parser(name, description=job.__doc__)
        for folder in ("--bronze", "--silver"):
            one.add_argument(folder, required=True)
        one.add_argument("--prefix", default=ZONE_PREFIX)
        one.set_defaults(start=subset_job)
    land = jobs.add_parser("land", description=landing.land.__doc__)
    for folder in ("--listing", "--unpacked", "--bronze", "--catalog", "--history"):
        land.add_argument(folder, required=True)
    land.add_argument("--cutoff", default=DEFAULT_CUTOFF)
    land.set_defaults(start=land_job)
    args = commands.parse_args(argv)
    return args.start(args)


if __name__ == "__main__":
    sys.exit(main())
