"""CSV text whose quoted fields hold line breaks, read in parallel.

Whether a line begins inside a quoted field depends on all lines before it. Each line is a
function from "begins inside" to "ends inside", one of four: keep, swap, always in, always out.
Such functions compose, so byte ranges are summed up on their own, one row per range links
them, and every line then knows how it begins without any task having read the file from its start. Only
the lines of one range meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# a field in quotes may hold doubled quotes; what stands between its end and the comma is kept as it is
_CLOSED = r'"(?:[^"]|"")*+"[^,]*+'
_OPEN = r'"(?:[^"]|"")*+$'
_REST = rf'(?:(?:{_CLOSED}|[^",][^,]*+|),)*+{_OPEN}'
#: Lines that end inside quotes, if they begin outside; and if they begin inside.
ENDS_INSIDE_FROM_OUTSIDE = rf"(?s)^{_REST}"
ENDS_INSIDE_FROM_INSIDE = rf'(?s)^(?:[^"]|"")*+(?:$|"[^,]*+,{_REST})'

_FILE, _RANGE, _AT, _LINE = "__file", "__range", "__at", "__line"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files at `path` with their file, the byte range they were read from, and their order in it.

    Lines end at line feeds only, so a carriage return inside quotes stays.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    place = F.col("_metadata")
    return lines.select(
        place["file_path"].alias(_FILE),
        place["file_block_start"].alias(_RANGE),
        F.monotonically_increasing_id().alias(_AT),
        F.col("value").alias(_LINE),
    )


def spans_lines(spark: SparkSession, path: str) -> bool:
    """True if some quoted field holds a line break: then some line opens a field and does not close it."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return not lines.where(F.col("value").contains('"') & F.col("value").rlike(ENDS_INSIDE_FROM_OUTSIDE)).isEmpty()


def _effects(lines: DataFrame) -> DataFrame:
    """Adds `fixed` (the state a line always ends in, if it does) and `swaps` (1 if it swaps the states)."""
    quoted = F.col(_LINE).contains('"')
    out = F.when(quoted, F.col(_LINE).rlike(ENDS_INSIDE_FROM_OUTSIDE)).otherwise(F.lit(False))
    inside = F.when(quoted, F.col(_LINE).rlike(ENDS_INSIDE_FROM_INSIDE)).otherwise(F.lit(True))
    return (
        lines.withColumns({"__out": out.cast("int"), "__in": inside.cast("int")})
        .withColumn("fixed", F.when(F.col("__out") == F.col("__in"), F.col("__out")))
        .withColumn("swaps", (F.col("__out") > F.col("__in")).cast("int"))
        .drop("__out", "__in")
    )


def _before(within: Window, start: Column) -> Column:
    """The state before a row: the last fixed one, or `start`, swapped as often as rows since then say."""
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum("swaps").over(earlier), F.lit(0))
    # a fixed state, counted back to the start by the swaps up to its row
    base = F.last((F.col("fixed") + F.col("upto")) % 2, ignorenulls=True).over(earlier)
    return (F.coalesce(base, start) + swaps) % 2


def begins_inside(lines: DataFrame) -> DataFrame:
    """`text_lines` with `__inside`: 1 if the line begins inside a quoted field."""
    ranged = Window.partitionBy(_FILE, _RANGE).orderBy(_AT)
    known = _effects(lines).withColumn("upto", F.sum("swaps").over(ranged))
    last = F.max_by(F.struct((F.col("fixed") + F.col("upto")) % 2), F.when(F.col("fixed").isNotNull(), F.col(_AT)))
    # one row per byte range: its own function
    ranges = known.groupBy(_FILE, _RANGE).agg(last.getField("col1").alias("base"), F.sum("swaps").alias("all"))
    ranges = ranges.select(
        _FILE, _RANGE, ((F.col("base") + F.col("all")) % 2).alias("fixed"), (F.col("all") % 2).cast("int").alias("swaps")
    )
    filed = Window.partitionBy(_FILE).orderBy(_RANGE)
    # a range with a fixed state ends in it whatever it swaps on the way
    starts = ranges.withColumn("swaps", F.when(F.col("fixed").isNull(), F.col("swaps")).otherwise(0))
    starts = starts.withColumn("upto", F.sum("swaps").over(filed))
    starts = starts.select(_FILE, _RANGE, _before(filed, F.lit(0)).alias("__start"))
    return known.join(starts, [_FILE, _RANGE]).withColumn("__inside", _before(ranged, F.col("__start"))).select(
        _FILE, _RANGE, _AT, _LINE, F.col("__inside").cast("int").alias("__inside")
    )


def records(lines: DataFrame) -> DataFrame:
    """`record` (text) and `first` (true for the first of a file) of each CSV record that is not empty.

    A record begins at each line that does not begin inside quotes; its lines are joined again.
    One that reaches over several byte ranges belongs to the range it begins in.
    """
    ranged = Window.partitionBy(_FILE, _RANGE).orderBy(_AT)
    begins = F.col("__inside") == 0
    numbered = begins_inside(lines).withColumn("__n", F.sum(begins.cast("int")).over(ranged))
    ranges = numbered.groupBy(_FILE, _RANGE).agg(F.max("__n").alias("count"))
    earlier = Window.partitionBy(_FILE).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    holds = F.when(F.col("count") > 0, F.struct(F.col(_RANGE).alias("r"), F.col("count").alias("n")))
    # where the lines before the first record of a range belong
    owners = ranges.select(_FILE, _RANGE, F.last(holds, ignorenulls=True).over(earlier).alias("__owner"))
    own = F.struct(F.col(_RANGE).alias("r"), F.col("__n").alias("n"))
    owner = F.when(F.col("__n") > 0, own).otherwise(F.col("__owner"))
    placed = numbered.join(owners, [_FILE, _RANGE]).withColumn("__record", owner)
    parts = F.array_sort(F.collect_list(F.struct(_RANGE, _AT, _LINE)))
    joined = placed.groupBy(_FILE, "__record").agg(F.array_join(F.transform(parts, lambda p: p[_LINE]), "\n").alias("record"))
    record = F.regexp_replace("record", r"\r$", "")
    first = (F.col("__record.r") == 0) & (F.col("__record.n") == 1)
    return joined.select(record.alias("record"), first.alias("first")).where("record != ''")


def parsed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of records; a record of the wrong width is an error."""
    options = {"quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": "true"}
    return rows.select(F.from_csv("record", schema.toDDL(), options).alias("r")).select("r.*")
