"""Near-duplicate documents by one-permutation hashing, optimal densification and star-shaped edges.

Every distinct shingle set is one node. Its shingle hashes fall into bins, the least of each bin is
kept, and an empty bin takes the value of the first full bin of its own fixed random order (Shrivastava,
"Optimal Densification for Fast and Accurate Minwise Hashing", 2017). Bands of some bins each are the
buckets. `banding` sets them by the threshold, so that a pair at it shares no bucket with probability `MISS`
at most: at 0.85 (1 - 0.85**8)**48 = 2.3e-7, at 0.8 (1 - 0.8**6)**51 = 1.8e-7.

Inside a bucket there are no pairs but star edges from a centre to the nodes not yet joined with it. A
centre has then been compared with the whole bucket and leaves it; a bucket whose nodes are all joined is
done. After `STARS` rounds, nodes in buckets that are still open (alike, but not alike enough) meet by
an exact prefix filter, so none of their links is lost and none of their buckets is spread into pairs.
Every edge is confirmed on the full shingle sets.

Defined results: texts that are null, empty or without words have an empty set and no links; repeated
rows share a node; ids may be null or repeat (the least non-null id names a component; a row without id
is never kept by `near_duplicates`, but `one_of_each` keeps one row of every component). Columns beyond doc_id and text are left
out here and carried along by `one_of_each`.

What is done with a text's shingles is in `Steps`: through Arrow here, in expressions in `shingles`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitspark.llm.text import WHITE, Piece, lists, mix, pieces, signed, words
from transitspark.operators.graph import connected_components
from transitspark.session import rewritten

MISS, MOST_BANDS = 2.4e-7, 52
SHINGLE, PERCENT = 3, 85
STARS, RARITY_BITS = 2, 18

_SKETCH = "rid long, doc_id long, tkey long, n_shingles long, node long, bands array<long>"


def banding(percent: int) -> tuple[int, int]:
    """Bands and bins a band: as many bins a band as `MOST_BANDS` bands allow; if one is too many, one."""
    if percent >= 100:
        return 1, 8
    need = lambda rows: math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows)))
    rows = max((r for r in range(1, 65) if need(r) <= MOST_BANDS), default=1)
    return need(rows), rows


def _orders(bins: int) -> np.ndarray:
    """For every bin, the order in which it looks for a full one; the same in every task."""
    key = mix(np.arange(bins * bins, dtype=np.uint64) + np.uint64(77)).reshape(bins, bins)
    return np.argsort(key, axis=1)


def sorted_sets(p: Piece, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, and where each text's begin."""
    w = words(p, WHITE, fold=True)
    spans = w.spans()
    counts = np.diff(w.of)
    sets = []
    for i, n in enumerate(counts):
        a, b = w.of[i], w.of[i + 1]
        first = np.arange(a, max(b - shingle + 1, a + (n > 0)))
        sets.append(np.unique(spans.of(first, np.minimum(first + shingle, b))))
    at = np.zeros(p.rows + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=at[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), at


def densified(values: np.ndarray, at: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """One value for each bin of each text; texts without shingles get zeros."""
    rows, bins = len(at) - 1, len(orders)
    row = np.repeat(np.arange(rows), np.diff(at))
    cell = row * bins + ((values >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    head = np.flatnonzero(np.diff(cell, prepend=-1))
    out, full = np.zeros(rows * bins, np.uint64), np.zeros(rows * bins, bool)
    out[cell[head]], full[cell[head]] = values[head], True
    out, full = out.reshape(rows, bins), full.reshape(rows, bins)
    for i in np.flatnonzero(full.any(1) & ~full.all(1)):
        empty = np.flatnonzero(~full[i])
        order = orders[empty]
        out[i, empty] = out[i, order[np.arange(len(empty)), full[i][order].argmax(1)]]
    return out


def _sketch(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    bands, in_band = banding(percent)
    orders = _orders(bands * in_band)
    for batch in batches:
        for p in pieces(batch.column(3)):
            values, at = sorted_sets(p, shingle)
            size = np.diff(at)
            bins = densified(values, at, orders).reshape(p.rows, bands, in_band)
            band = np.tile(np.arange(bands, dtype=np.uint64), (p.rows, 1))
            for r in range(in_band):
                band = mix(band * np.uint64(31) + bins[:, :, r])
            sums = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(np.stack([mix(values), mix(~values)], 1), axis=0, dtype=np.uint64)])
            total = sums[at[1:]] - sums[at[:-1]]
            node = mix(total[:, 0] + mix(total[:, 1] + size.astype(np.uint64)))
            some = size > 0
            rows = slice(p.first, p.first + p.rows)
            yield pa.record_batch(
                [
                    *(batch.column(c)[rows] for c in range(3)),
                    pa.array(size, pa.int64()),
                    pa.array(signed(node), pa.int64(), mask=~some),
                    lists(signed(band[some].reshape(-1)), np.where(some, bands, 0), pa.int64()),
                ],
                ["rid", "doc_id", "tkey", "n_shingles", "node", "bands"],
            )


def _verified(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = []
        for p, q in zip(pieces(batch.column(2), 0), pieces(batch.column(3), 0)):  # a text at a time
            x, y = sorted_sets(p, shingle)[0], sorted_sets(q, shingle)[0]
            both = len(np.intersect1d(x, y, assume_unique=True))
            links.append(100 * both >= percent * (len(x) + len(y) - both))
        keep = pa.array(links, pa.bool_())
        yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def sketches(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(rid, doc_id, tkey, n_shingles, node, bands) of every row; rid numbers rows, tkey is the text's hash."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _sketch(b, shingle, percent), _SKETCH)


def _entries(nodes: DataFrame) -> DataFrame:
    """(bucket, node, n, score) of the buckets with more than one node; a node's score is how much company it has."""
    spread = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("nodes")).filter("nodes > 1")
    entries = spread.join(shared, "bucket")
    score = entries.groupBy("node").agg(F.sum("nodes").alias("score"))
    return entries.drop("nodes").join(score, "node")


def _confirmed(both: DataFrame, shingle: int, percent: int) -> DataFrame:
    return both.mapInArrow(lambda b: _verified(b, shingle, percent), "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, by: Steps) -> DataFrame:
    """The pairs (a, b) that are links on their full shingle sets."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return rewritten(by.confirmed(both.select("a", "b", "x", "y"), shingle, percent), "links")


def _joined(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) of the ends of links."""
    ends = links.select(F.col("a").alias("source_stop_id"), F.col("b").alias("target_stop_id"))
    nodes = ends.select(F.explode(F.array("source_stop_id", "target_stop_id")).alias("stop_id"))
    return rewritten(connected_components(nodes, ends).select(F.col("stop_id").alias("node"), "component"), "components")


def _still_open(left: DataFrame) -> DataFrame:
    """The entries of buckets in which nodes of more than one component are left."""
    open_ = left.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    return rewritten(left.join(open_, "bucket", "left_semi"), "left")


def _kinds(texts: DataFrame, shingle: int) -> DataFrame:
    """(kind, n): how often each class of shingles occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for p in pieces(batch.column(0)):
                total += np.bincount(sorted_sets(p, shingle)[0] >> np.uint64(64 - RARITY_BITS), minlength=len(total))
        yield pa.record_batch([pa.array(np.flatnonzero(total), pa.int64()), pa.array(total[total > 0], pa.int64())], ["kind", "n"])

    return texts.select("text").mapInArrow(count, "kind long, n long").groupBy("kind").agg(F.sum("n").alias("n"))


def _rarity(counts: DataFrame) -> np.ndarray:
    """About how often each of 2**RARITY_BITS classes of shingles occurs. Any order of shingles gives right results."""
    out = np.zeros(1 << RARITY_BITS, np.int64)
    for kind, n in counts.collect():
        out[kind] = n
    return out


def _prefixes(texts: DataFrame, rarity: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """(token, node, component, at, n) of the prefixes of all sets."""
    sent = texts.sparkSession.sparkContext.broadcast(rarity)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch.column(2)):
                values, at = sorted_sets(p, shingle)
                for i in range(p.rows):
                    own = values[at[i] : at[i + 1]]
                    n = len(own)
                    own = own[np.lexsort((own, sent.value[own >> np.uint64(64 - RARITY_BITS)]))][: n + (-n * percent) // 100 + 1]
                    size = len(own)
                    yield pa.record_batch(
                        [signed(own), *(np.full(size, batch.column(c)[p.first + i].as_py(), np.int64) for c in (0, 1)), np.arange(size, dtype=np.int64), np.full(size, n, np.int64)],
                        ["token", "node", "component", "at", "n"],
                    )

    return texts.select("node", "component", "text").mapInArrow(prefixes, "token long, node long, component long, at long, n long")


class Steps(NamedTuple):
    """What is done with the shingles of texts; the functions of this module say what each gives."""

    sketches: Callable[[DataFrame, int, int], DataFrame]
    confirmed: Callable[[DataFrame, int, int], DataFrame]
    kinds: Callable[[DataFrame, int], DataFrame]
    prefixes: Callable[[DataFrame, np.ndarray, int, int], DataFrame]


ARROW = Steps(sketches, _confirmed, _kinds, _prefixes)


def rest_pairs(texts: DataFrame, shingle: int, percent: int, by: Steps = ARROW) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may be links, by the prefixes of their sets.

    With the shingles of all sets in one order, rare ones first, two sets of n and m shingles with the
    similarity share one among the first n - ceil(n * percent / 100) + 1 of each; where the first shared
    one stands bounds what they can share (Xiao et al., "Efficient Similarity Joins for Near Duplicate
    Detection", 2008). No link is lost, and nodes that differ from their centre by shingles of their own
    meet only where they share those. `texts`: node, text, component.
    """
    tokens = by.prefixes(texts, _rarity(by.kinds(texts, shingle)), shingle, percent)
    tokens = rewritten(tokens, "tokens")
    # of the nodes with a token, those of its largest component are compared with the others only
    sizes = tokens.groupBy("token", "component").agg(F.count("*").alias("nodes"))
    mixed = sizes.groupBy("token").agg(F.max_by("component", "nodes").alias("main"), F.count("*").alias("components")).filter("components > 1")
    mixed = tokens.join(mixed.select("token", "main"), "token")
    a, b = mixed.filter("component != main").alias("a"), mixed.alias("b")
    may = (F.col("a.component") != F.col("b.component")) & ((100 + percent) * F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= percent * (F.col("a.n") + F.col("b.n")))
    return a.join(b, (F.col("a.token") == F.col("b.token")) & may).select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def node_components(spark: SparkSession, docs: DataFrame, sketch: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, by: Steps = ARROW) -> DataFrame:
    """(node, component) of all nodes that have a link."""
    nodes = sketch.filter("node IS NOT NULL").groupBy("node").agg(F.min("tkey").alias("tkey"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = rewritten(nodes, "nodes")
    left = rewritten(_entries(nodes).withColumn("component", F.col("node")), "entries")
    wanted = left.select("node").distinct().join(nodes.select("node", "tkey"), "node")
    texts = docs.select(F.xxhash64("text").alias("tkey"), F.col("text").cast("string").alias("text")).join(wanted, "tkey")
    texts = rewritten(texts.dropDuplicates(["tkey"]).select("node", "text"), "texts")
    links = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    for _ in range(STARS):
        left = _still_open(left)
        best = F.max(F.struct("score", F.struct("node", "component", "n").alias("c"))).alias("best")
        centres = left.groupBy("bucket").agg(best).select("bucket", F.col("best.c.node").alias("centre"), F.col("best.c.component").alias("of"), F.col("best.c.n").alias("m"))
        centres = rewritten(centres, "centres")
        apart = (F.col("component") != F.col("of")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
        pairs = left.join(centres, "bucket").filter(apart).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        links = links.unionByName(_verify(pairs, texts, shingle, percent, by))
        components = _joined(spark, links)
        # a centre was compared with its whole bucket and leaves it
        left = left.join(centres.select("bucket", F.col("centre").alias("node")), ["bucket", "node"], "left_anti").drop("component")
        left = left.join(components, "node", "left").select("bucket", "node", "n", "score", F.coalesce("component", "node").alias("component"))
    left = _still_open(left)
    rest = rewritten(texts.join(left.select("node", "component").distinct(), "node"), "rest")
    return _joined(spark, links.unionByName(_verify(rest_pairs(rest, shingle, percent, by), texts, shingle, percent, by)))


def _labelled(spark: SparkSession, docs: DataFrame, shingle: int, percent: int, by: Steps = ARROW) -> DataFrame:
    """(rid, doc_id, n_shingles, node, component, component_id)."""
    sketch = rewritten(by.sketches(docs, shingle, percent), "sketches")
    components = node_components(spark, docs, sketch, shingle, percent, by)
    rows = sketch.drop("bands").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # one row for each component, made map-side first, so a large group costs its rows and no more
    least = rows.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min("rid").alias("first"))
    return rows.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    return _labelled(spark, docs, shingle, percent).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, by: Steps = ARROW) -> DataFrame:
    """The rows of `docs`, all columns, but of each component only one: that of its least id.

    Of rows that repeat that id too, one stays by the order of the input. Rows without words all stay.
    """
    rows = _labelled(spark, docs.select("doc_id", "text"), shingle, percent, by)
    # the surviving rows are named by id and text, which a join can find again; whole texts are sent once, for it
    least = F.min_by(F.struct("doc_id", "tkey"), F.struct(F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)), "rid"))
    leader = rows.filter("component IS NOT NULL").groupBy("component").agg(least.alias("l"))
    no_words = rows.filter("component IS NULL").select(F.struct("doc_id", "tkey").alias("l")).distinct()
    stay = leader.select("l", F.lit(True).alias("once")).unionByName(no_words.withColumn("once", F.lit(False)))
    stay = rewritten(stay.select(F.xxhash64("l.doc_id", "l.tkey").alias("name"), "l", "once"), "stay")
    out = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("tkey"))
    out = out.withColumn("name", F.xxhash64("id", "tkey")).join(stay, "name")
    out = out.filter(F.col("id").eqNullSafe(F.col("l.doc_id")) & (F.col("tkey") == F.col("l.tkey")))
    # rows that share a name stay together behind the join, so one of them is taken there
    copy = F.when(F.col("once"), -1).otherwise(F.monotonically_increasing_id())
    return out.withColumn("copy", copy).dropDuplicates(["name", "id", "tkey", "copy"]).select("row.*")
