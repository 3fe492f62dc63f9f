"""Content rules over snapshots, evaluated as one Spark job for any number of versions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitspark.config import QualityRules
from transitspark.operators.subset import dependents, wanted_inputs
from transitspark.session import local_rows

VERSION = "snapshot_version"
_S = T.StringType()
REPORT_SCHEMA = (
    T.StructType()
    .add(VERSION, _S)
    .add("ordinal", T.IntegerType())
    .add("table", _S)
    .add("check", _S)
    .add("column", _S)
    .add("observed", T.LongType())
    .add("detail", _S)
)
_PRESENT = T.StructType().add(VERSION, _S).add("present", T.ArrayType(_S))
# room between the ordinals of two tables; keys are reported after every table
_TABLE_STEP, _KEYS_FROM, _INPUTS_FROM, _FAILED = 1_000, 1_000_000, 2_000_000, 3_000_000


def column_profile(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Row count and null count of every named column, one aggregate."""
    nulls = [F.expr(f"count_if(`{c}` IS NULL) AS `nulls_{c}`") for c in columns]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *nulls)


def orphan_keys(
    child: DataFrame, child_col: str, parent: DataFrame, parent_col: str, by: Sequence[str] = ()
) -> DataFrame:
    """Child keys without a parent and how many child rows carry each; null keys are ignored.

    The child is counted per key before anything is joined, so a key that fills a third of the
    child is one row per input split by the time it is shuffled.
    """
    keyed = (
        child.where(F.col(child_col).isNotNull())
        .groupBy(*by, child_col)
        .agg(F.count(F.lit(1)).alias("child_rows"))
    )
    parents = parent.select(*by, F.col(parent_col).alias(child_col))
    return keyed.join(parents, [*by, child_col], "left_anti")


def orphan_rows(
    child: DataFrame, child_col: str, parent: DataFrame, parent_col: str, by: Sequence[str] = ()
) -> DataFrame:
    """Number of child rows with a key the parent does not have."""
    orphans = orphan_keys(child, child_col, parent, parent_col, by)
    return orphans.groupBy(*by).agg(F.coalesce(F.sum("child_rows"), F.lit(0)).alias("orphans"))


def _finding(ordinal: int, check: str, column: str | None, observed: str, detail: str) -> str:
    """A violation as SQL text; `observed` and `detail` are SQL expressions."""
    name = "CAST(NULL AS STRING)" if column is None else f"'{column}'"
    return (
        f"named_struct('ordinal', {ordinal}, 'check', '{check}', 'column', {name}, "
        f"'observed', CAST({observed} AS BIGINT), 'detail', {detail})"
    )


def _table_findings(
    name: str, position: int, df: DataFrame, present: DataFrame, rules: QualityRules
) -> DataFrame:
    required = rules.required.get(name, ())
    known = [c for c in required if c in df.columns]
    profile = column_profile(df, known, [VERSION])
    # every version that has the table appears, also one whose table is empty
    seen = present.join(profile, VERSION, "left").fillna(0)

    base = position * _TABLE_STEP
    checks = []
    if required:
        wanted = ", ".join(f"'{c}'" for c in required)
        missing = f"array_except(array({wanted}), present)"
        listed = f"concat_ws(', ', transform({missing}, c -> concat('\\'', c, '\\'')))"
        text = f"concat('missing column(s): [', {listed}, ']')"
        finding = _finding(base, "required_columns", None, f"size({missing})", text)
        checks.append(f"CASE WHEN size({missing}) > 0 THEN {finding} END")
    for offset, column in enumerate(known, start=1):
        nulls = f"`nulls_{column}`"
        text = f"concat('{column} has ', {nulls}, ' null value(s)')"
        finding = _finding(base + offset, "not_null", column, nulls, text)
        checks.append(
            f"CASE WHEN array_contains(present, '{column}') AND {nulls} > 0 THEN {finding} END"
        )
    if name in rules.bounds:
        low, high = rules.bounds[name]
        text = f"concat(rows, ' rows outside expected [{low}, {high}]')"
        finding = _finding(base + _TABLE_STEP - 1, "row_count_range", None, "rows", text)
        checks.append(f"CASE WHEN NOT rows BETWEEN {low} AND {high} THEN {finding} END")
    found = f"inline(array_compact(array({', '.join(checks)})))"
    return seen.select(VERSION, F.expr(found)).select(
        VERSION, "ordinal", F.lit(name).alias("table"), "check", "column", "observed", "detail"
    )


def quality_report(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    layout: dict[str, dict[str, list[str]]],
    rules: QualityRules = QualityRules(),
) -> DataFrame:
    """Every rule violation of every version.

    `tables` carry a `snapshot_version` column; `layout` says which tables, with which columns,
    each version really has (`version -> table -> columns`), since a column merged in from
    another version would otherwise look like a column of nulls.
    """
    parts = []
    for position, (name, df) in enumerate(tables.items()):
        rows = [(v, list(have[name])) for v, have in layout.items() if name in have]
        if not rows or (name not in rules.required and name not in rules.bounds):
            continue
        present = local_rows(spark, _PRESENT, rows)
        parts.append(_table_findings(name, position, df, present, rules))

    for position, (child, child_col, parent, parent_col) in enumerate(rules.foreign_keys):
        versions = [
            v
            for v, have in layout.items()
            if child_col in have.get(child, ()) and parent_col in have.get(parent, ())
        ]
        if not versions:
            continue
        checked = F.col(VERSION).isin(versions)
        counted = orphan_rows(
            tables[child].where(checked), child_col, tables[parent].where(checked), parent_col,
            [VERSION],
        )
        text = f"concat(orphans, ' {child_col} value(s) not found in {parent}.{parent_col}')"
        parts.append(
            counted.where("orphans > 0").selectExpr(
                VERSION,
                f"{_KEYS_FROM + position} AS ordinal",
                f"'{child}' AS table",
                "'referential_integrity' AS check",
                f"'{child_col}' AS column",
                "orphans AS observed",
                f"{text} AS detail",
            )
        )
    if not parts:
        return local_rows(spark, REPORT_SCHEMA, [])
    return reduce(DataFrame.unionByName, parts)


def missing_inputs(
    spark: SparkSession, layout: dict[str, dict[str, list[str]]], rules: QualityRules = QualityRules()
) -> DataFrame:
    """Report rows for the tables and columns the subset needs and a version does not have.

    The detail names the artifacts that cannot be derived without it. One row per version and
    missing table or column, from the layout alone; no table is read. A column that `rules` require
    of the table is reported there.
    """
    rows = []
    for version, have in layout.items():
        ordinal = _INPUTS_FROM
        for name, columns in wanted_inputs(have).items():
            lost = f"; needed by {', '.join(dependents(name))}"
            for column in [None] if name not in have else [c for c in columns if c not in [*have[name], *rules.required.get(name, ())]]:
                what = f"table {name} is missing" if column is None else f"column {column} is missing"
                rows.append((version, ordinal, name, "missing_input", column, 1, what + lost))
                ordinal += 1
    return local_rows(spark, REPORT_SCHEMA, rows)


def failed_versions(spark: SparkSession, failures: dict[str, str]) -> DataFrame:
    """Report rows for versions whose derivation ended in an error."""
    rows = [(v, _FAILED, "*", "derivation", None, 1, text) for v, text in failures.items()]
    return local_rows(spark, REPORT_SCHEMA, rows)


def with_version(tables: dict[str, DataFrame], version: str) -> dict[str, DataFrame]:
    """The tables of one snapshot with its version as a column."""
    return {name: df.withColumn(VERSION, F.lit(version)) for name, df in tables.items()}


def validate_snapshot(
    spark: SparkSession,
    version: str,
    tables: dict[str, DataFrame],
    rules: QualityRules = QualityRules(),
) -> DataFrame:
    """The report rows of one snapshot; none if it keeps every rule."""
    layout = {version: {name: list(df.columns) for name, df in tables.items()}}
    return quality_report(spark, with_version(tables, version), layout, rules)


def passed_versions(versions: DataFrame, report: DataFrame) -> DataFrame:
    """Rows of `versions` (with a `snapshot_version` column) of which the report says nothing."""
    return versions.join(report.select(VERSION).distinct(), VERSION, "left_anti")


def report_lines(report: DataFrame) -> DataFrame:
    """`snapshot_version`, `ordinal`, `line`: each violation as one line of text."""
    line = F.concat(F.col("table"), F.lit("."), F.col("check"), F.lit(": "), F.col("detail"))
    return report.select(VERSION, "ordinal", line.alias("line"))


def report_texts(report: DataFrame) -> DataFrame:
    """`snapshot_version`, `text`: all violations of a version in the order of the rules.

    A version has at most one row per rule, so what is gathered is bounded by the rules.
    """
    found = F.array_sort(F.collect_list(F.struct("ordinal", "line")))
    bullets = F.array_join(F.transform(found, lambda r: F.concat(F.lit("\n  - "), r["line"])), "")
    head = F.concat(F.lit("snapshot "), F.col(VERSION), F.lit(" failed validation:"))
    grouped = report_lines(report).groupBy(VERSION).agg(bullets.alias("bullets"))
    return grouped.select(VERSION, F.concat(head, "bullets").alias("text"))
