"""Repeated runs of lines by prefix doubling over line ids, in DataFrame expressions only.

A text is a sequence of line ids. The names of the suffixes by their first 2h lines come from the names
by their first h lines at i and i + h; names are equal exactly where the prefixes are equal. Suffixes with
one name are an interval of the suffix array whose longest common prefix is at least the depth; only
intervals with more than one suffix go on, each depth is a written table, and it ends with the depth that
has none. All places of such a run but the first, by document and line, are later copies; those that weigh
enough and overlap in a text make its maximal runs, which are cut out. A run whose length is no depth is
covered by shorter ones, whose first places come first too. Names need no order between intervals.

`later_copies` counts a run from `RUN` lines on, or one line of at least `LONG` characters; its SQL says the
same. `later_runs` counts any run, single lines too, that holds `least` words in all (`WORDS`, if not said; the pipeline
asks for one, so no line with a word is left twice). Names are 64-bit hashes.

Defined results: a null text has no lines and stays null; an empty text is one empty line; a text whose
lines all are later copies becomes empty (`without_repeated_runs` drops it); rows that repeat in full are one document and fare alike; a
null id comes before all others; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from transitspark.operators.keys import per_key
from transitspark.session import rewritten

RUN, LONG = 2, 100
WORDS = 3


def doubled(names: Column, h: int) -> Column:
    """Names by 2h lines from names by h lines; the last suffixes, which are shorter, have none."""
    pairs = F.zip_with(F.slice(names, 1, F.greatest(F.size(names) - h, F.lit(0))), F.slice(names, h + 1, F.greatest(F.size(names) - h, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(names) > h, pairs).otherwise(F.array().cast("array<bigint>"))


def suffix_names(names: Column, depth: int) -> Column:
    """Names of all suffixes by their first `depth` lines, by doubling; two that overlap name what is no power of two."""
    h = 1
    while 2 * h <= depth:
        names, h = doubled(names, h), 2 * h
    if h < depth:
        names = doubled(names, depth - h)  # lines i..i+h and i+depth-h..i+depth
    return names


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.struct("*").alias("row"),
        F.xxhash64("doc_id", "text").alias("rid"),
        F.col("doc_id").cast("long").alias("id"),
    )


def lines_of(text: str) -> Column:
    return F.split(F.col(text).cast("string"), "\n", -1)


def later_copies(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """(rid, spans): the lines of each text, first and last of a span, that lie in a later copy of a run."""
    weight = lambda x: F.when(F.length(x) >= long, run).otherwise(1)
    return later_spans(docs, run, weight)


def later_runs(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """(rid, spans): the lines of each text that lie in a later copy of a run of `least` words or more.

    Lines without words count for nothing, and go with a run they stand in.
    """
    counts = lambda x: sum(x.rlike(rf"^\s*+\S++(?:\s++\S++){{{k}}}").cast("int") for k in range(least))
    return later_spans(docs, least, counts, blank=False)


def later_spans(docs: DataFrame, least: int, weight: Callable[[Column], Column], blank: bool = True) -> DataFrame:
    """(rid, spans) of the maximal spans of lines made of later copies of runs that weigh `least` or more.

    A line weighs what `weight` says of its text; without `blank`, lines of no weight are left out of the sequence.
    """
    line = lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("name"), weight(x).alias("total"))
    found = F.transform(lines_of("row.text"), line)
    texts = keyed(docs).select("rid", "id", (found if blank else F.filter(found, lambda x: x["total"] > 0)).alias("w"))
    texts = rewritten(texts.filter(F.size("w") > 0), "line_names")
    suffixes = texts.select("rid", "id", F.posexplode("w").alias("at", "s"))
    single = suffixes.select("rid", "id", "at", F.col("s.line").alias("line"), F.col("s.line").alias("last"), "s.name", "s.total")
    runs = maximal_runs([t.filter((F.col("total") >= least) & F.col("later")) for t in repeated_runs(single, least).values()])
    return runs.groupBy("rid").agg(F.collect_list(F.struct("line", "last")).alias("spans"))


def repeated_runs(single: DataFrame, least: int) -> dict[int, DataFrame]:
    """By length, the runs of lines that stand in more than one place, with whether each is a later copy.

    The names of twice the length come from those of a place and of the place behind it; only places whose name is
    shared go on, and it ends with the length no two places share. Lengths up to `least` that are no power of two are
    made of two shorter ones. `single`: rid, id, at, line, last, name, total.
    """
    # rows that repeat in full are one document
    found = {1: _shared(single).distinct()}
    found[1], left = _measured(found[1])
    h = 1
    while left:
        for more in range(1, min(h, least - h + 1)):
            found[h + more], _ = _measured(_shared(_joined(found[h], found[more], h)))
        found[2 * h], left = _measured(_shared(_joined(found[h], found[h], h)))
        h *= 2
    return found


def _measured(shared: DataFrame) -> tuple[DataFrame, int]:
    seen = Observation()
    out = rewritten(shared.observe(seen, F.count(F.lit(1)).alias("n")), "intervals")
    return out, seen.get["n"]


def _joined(a: DataFrame, b: DataFrame, h: int) -> DataFrame:
    """Runs of `a`, of length h, with the run of `b` that begins where they end."""
    behind = b.select("rid", (F.col("at") - h).alias("at"), F.col("last").alias("end"), F.col("name").alias("next"), F.col("total").alias("more"))
    total = (F.col("total") + F.col("more")).alias("total")
    return a.join(behind, ["rid", "at"]).select("rid", "id", "at", "line", F.col("end").alias("last"), F.xxhash64("name", "next").alias("name"), total)


def _shared(runs: DataFrame) -> DataFrame:
    """The runs whose name stands in more than one place: an interval of the suffix array, its first place not later."""
    place = F.struct("id", "rid", "at")
    first = per_key(runs, ["name"], F.count(F.lit(1)).alias("places"), F.min(place).alias("first")).filter("places > 1")
    return runs.join(first, "name").select(*runs.columns, (~place.eqNullSafe(F.col("first"))).alias("later"))


def maximal_runs(runs: list[DataFrame]) -> DataFrame:
    """(rid, line, last) of the runs, those that overlap as one."""
    every = reduce(DataFrame.unionByName, [r.select("rid", "line", "last") for r in runs])
    # of the runs that begin on one line the longest holds the others
    every = every.groupBy("rid", "line").agg(F.max("last").alias("last"))
    before = Window.partitionBy("rid").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("rid").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = every.withColumn("begins", F.coalesce(F.col("line") > F.max("last").over(before), F.lit(True)).cast("int"))
    return begins.withColumn("number", F.sum("begins").over(upto)).groupBy("rid", "number").agg(F.min("line").alias("line"), F.max("last").alias("last")).drop("number")


def _kept(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(row, id, lines, gone, kept): kept is the text that stays."""
    # the text is sent once and cut into lines behind the join
    joined = keyed(docs).join(spans, "rid", "left").withColumn("lines", lines_of("row.text"))
    joined = joined.withColumn("gone", F.flatten(F.transform("spans", lambda s: F.sequence(s["line"], s["last"]))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n"))
    return joined.select("row", "id", "lines", "gone", kept.alias("kept"))


def _with_kept(docs: DataFrame, out: DataFrame) -> DataFrame:
    columns = {"text": F.col("kept")} | ({"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def without_repeated_lines(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """The rows of `docs` with later copies of runs cut out of `text`; n_chars, if there, follows the text."""
    return _with_kept(docs, _kept(docs, later_copies(docs.select("doc_id", "text"), run, long)))


def without_repeated_runs(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """Like `without_repeated_lines`, by `later_runs`; a row that had words and has none left goes."""
    out = _kept(docs, later_runs(docs.select("doc_id", "text"), least))
    emptied = F.col("row.text").rlike(r"\S") & ~F.col("kept").rlike(r"\S")
    return _with_kept(docs, out.filter(~F.coalesce(emptied, F.lit(False))))


def line_digests(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of every row; a null text has no lines and an empty digest text."""
    gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    docs = docs.select("doc_id", "text")
    return _kept(docs, later_copies(docs, run, long)).select(F.col("id").alias("doc_id"), lines.cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
w AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM l),
s AS (SELECT doc_id, i, 1 AS size, line AS name FROM w WHERE length(line) >= {LONG}
      UNION ALL SELECT doc_id, i, 2, line || chr(10) || after FROM w WHERE j IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY name, size ORDER BY doc_id, i) AS n FROM s),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest([0, 1]) AS k) WHERE n > 1 AND k < size)
SELECT d.doc_id, coalesce(count(l.i), 0) AS n_lines, count(g.i) AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i
GROUP BY d.doc_id
"""
