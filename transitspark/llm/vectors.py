"""Near-duplicate vectors by sorted projection passes.

Each distinct vector of a label is one node, signed by `BITS` random hyperplanes. A pass permutes the bits and sorts all
nodes by label and the permuted signature (Charikar, "Similarity estimation techniques from rounding algorithms", 2002;
Ravichandran et al., "Randomized algorithms and NLP", 2005): near vectors share a long prefix in some pass and
stand close together. Each node is compared with the `WINDOW` nodes after it; those whose signatures differ in no more bits than a pair
at the threshold may (`most_bits`) are candidates, and only a spanning forest of each stretch's candidates leaves a task. The number of passes
follows from the largest label, so that a pair at the threshold meets in no window with probability `MISS` at most.

Candidates are united across passes. Inside a group every pair is then judged on the original vectors in double precision,
so the window bounds what is looked for, not what is counted: a group of up to `TILE` nodes is one product of matrices. In a larger one,
nodes within half the angle of the threshold around the group's centre are linked with each other for certain (the triangle
inequality of angles) and only counted; each other node is a query against the group's tiles. A tight group of any size thus costs its rows.
Links only exist inside a group, so components come out of the links found there.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows without label, link with
nothing; vectors of different lengths do not link. Equal vectors are linked with each other and share a node; repeated
rows and ids count as rows of their own. The least non-null id names a component; a row without id is never kept. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitspark.llm.text import signed
from transitspark.llm.unions import roots
from transitspark.operators.keys import per_key
from transitspark.session import rewritten

THRESHOLD, MISS = 0.93, 1e-3
BITS, WINDOW, TILE = 256, 64, 512
_LONGS = BITS // 64
#: Rounding of angles; a pair nearer to the limit than this is judged by its product.
MARGIN = 1e-6

_MEMBER = "grp long, tile int, node long, copies long, vec array<double>"


def most_bits(threshold: float) -> int:
    """Bits in which two vectors at the threshold differ at most, but for 4.5 standard deviations (3e-6)."""
    p = math.acos(threshold) / math.pi
    return math.ceil(BITS * p + 4.5 * math.sqrt(BITS * p * (1 - p)))


def passes_for(nodes: int, threshold: float) -> int:
    """Passes after which a pair at the threshold has met with probability 1 - MISS.

    Among `nodes` unrelated signatures, those that share log2(nodes / WINDOW) leading bits with a node fill half its window.
    """
    same = 1 - math.acos(threshold) / math.pi
    meet = same ** max(math.log2(max(nodes, 2) / (WINDOW / 2)), 1)
    return math.ceil(math.log(MISS) / math.log1p(-meet))


def _directions(length: int) -> np.ndarray:
    return np.random.default_rng([11, length]).standard_normal((length, BITS))


def _orders(passes: int) -> np.ndarray:
    return np.argsort(np.random.default_rng(12).random((passes, BITS)), axis=1)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest part, so nothing overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of each length in a list column."""
    sizes, flat, at = np.diff(np.asarray(column.offsets)), np.asarray(column.values, np.float64), np.asarray(column.offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[at[rows][:, None] + np.arange(size)]


def nodes_of(vectors: DataFrame) -> DataFrame:
    """(node, label, copies, vec) of the distinct vectors that can have links. `vectors`: label, embedding."""
    parts = F.col("embedding")
    sound = parts.isNotNull() & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(parts, lambda x: x != 0)
    rows = vectors.filter(F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    distinct = per_key(rows, ["label", "embedding"], F.count(F.lit(1)).alias("copies"))
    return distinct.select(F.monotonically_increasing_id().alias("node"), "label", "copies", "embedding")


def _signatures(batches: Iterator[pa.RecordBatch], passes: int) -> Iterator[pa.RecordBatch]:
    """A row for each node and pass: its permuted bits, ordered like signed longs."""
    orders = _orders(passes)
    for batch in batches:
        node, label = batch.column(0).to_numpy(), batch.column(1)
        for rows, v in _matrices(batch.column(2)):
            bits = _unit(v) @ _directions(v.shape[1]) >= 0
            for p in range(passes):
                key = np.ascontiguousarray(np.packbits(bits[:, orders[p]], axis=1)).view(">u8").astype(np.uint64) ^ np.uint64(1 << 63)
                fixed = [pa.array(np.full(len(rows), x), pa.int32()) for x in (p, v.shape[1])]
                yield pa.RecordBatch.from_arrays([fixed[0], label.take(pa.array(rows)), fixed[1], *(pa.array(signed(np.ascontiguousarray(key[:, k]))) for k in range(_LONGS)), pa.array(node[rows])], ["pass", "label", "length", *(f"k{k}" for k in range(_LONGS)), "node"])


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links a[i], b[i] between 0 .. n - 1 join parts that the links before them have not joined."""
    above, chosen = list(range(n)), np.zeros(len(a), bool)

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            above[max(x, y)] = min(x, y)
            chosen[i] = True
    return chosen


def near(group: np.ndarray, keys: np.ndarray, node: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the candidates in a sorted stretch: each row and those of the next `WINDOW` of its group near enough by signature."""
    n, found = len(node), [np.zeros((2, 0), np.int64)]
    unlike = np.concatenate([[0], np.cumsum((group[1:] != group[:-1]).any(axis=1))]) if n else np.zeros(0, np.int64)
    for d in range(1, min(WINDOW, n - 1) + 1):
        away = np.bitwise_count(keys[d:] ^ keys[:-d]).sum(axis=1, dtype=np.int64)
        at = np.flatnonzero((away <= most) & (unlike[d:] == unlike[:-d]))
        found.append(np.stack([at, at + d]))
    a, b = np.concatenate(found, axis=1)
    kept = forest(a, b, n)
    return node[a[kept]], node[b[kept]]


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    label = np.asarray(batch.column(1).cast(pa.int64()))
    group = np.column_stack([np.asarray(batch.column(0), np.int64), label, np.asarray(batch.column(2), np.int64)])
    return group, np.column_stack([np.asarray(batch.column(3 + k)) for k in range(_LONGS)]), np.asarray(batch.column(3 + _LONGS))


def _windows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) of sorted rows, and rows (seam, side, ...) of the first and last WINDOW rows of the task."""
    seam = TaskContext.get().partitionId()
    held, head = None, None

    def edge(rows: tuple, of: int, side: int) -> pa.RecordBatch:
        group, keys, node = rows
        n = len(node)
        none = pa.nulls(n, pa.int64())
        wide = [pa.array(x) for x in (*group.T, *keys.T, node)]
        return pa.RecordBatch.from_arrays([none, none, pa.array(np.full(n, of), pa.int32()), pa.array(np.full(n, side), pa.int32()), pa.array(np.arange(n), pa.int32()), *wide], _EDGE_NAMES)

    for batch in batches:
        rows = _columns(batch)
        if held is not None:
            rows = tuple(np.concatenate(pair) for pair in zip(held, rows))
        if head is None or len(head[2]) < WINDOW:
            head = tuple(x[:WINDOW] for x in rows)
        a, b = near(*rows, most)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), f.type) for f in list(_EDGE)[2:])], _EDGE_NAMES)
        held = tuple(x[-WINDOW:] for x in rows)
    if held is not None:
        yield edge(head, seam, 1)
        yield edge(held, seam + 1, 0)


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("seam", pa.int32()), ("side", pa.int32()), ("at", pa.int32()), *((n, pa.int64()) for n in ("pass", "label", "length", *(f"k{k}" for k in range(_LONGS)), "node"))])
_EDGE_NAMES = _EDGE.names
_EDGE_DDL = ", ".join(f"`{f.name}` {'int' if f.type == pa.int32() else 'long'}" for f in _EDGE)


def candidates(spark: SparkSession, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a spanning forest of the pairs of nodes that may be links, per pass and stretch."""
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    passes, most = passes_for(largest, threshold), most_bits(threshold)
    keys = ["pass", "label", "length", *(f"k{k}" for k in range(_LONGS)), "node"]
    label = nodes.schema["label"].dataType.simpleString()
    shape = f"pass int, label {label}, length int, " + ", ".join(f"k{k} long" for k in range(_LONGS)) + ", node long"
    signed_ = nodes.select("node", "label", "embedding").mapInArrow(lambda b: _signatures(b, passes), shape)
    dealt = signed_.repartitionByRange(*keys).sortWithinPartitions(*keys)
    met = rewritten(dealt.mapInArrow(lambda b: _windows(b, most), _EDGE_DDL), "windows")

    def across(rows: pa.Table) -> pa.Table:
        """The last rows of one task beside the first of the next."""
        rows = rows.sort_by([("side", "ascending"), ("at", "ascending")]).combine_chunks()
        group, keys, node = (np.column_stack([np.asarray(rows[c], np.int64) for c in cs]) for cs in (("pass", "label", "length"), [f"k{k}" for k in range(_LONGS)], ("node",)))
        a, b = near(group, keys, node[:, 0], most)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    seams = met.filter("seam IS NOT NULL").drop("a", "b").groupBy("seam").applyInArrow(across, "a long, b long")
    return met.filter("a IS NOT NULL").select("a", "b").unionByName(seams)


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and of y (unit vectors) have the cosine."""
    return x @ y.T >= threshold


def _stacked(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _small(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(node, links, root) of groups of one tile, whose rows come one after another."""

    def judged(rows: pa.Table) -> pa.RecordBatch:
        node, copies, vec = (rows[c].combine_chunks() for c in ("node", "copies", "vec"))
        node, copies, vec = np.asarray(node), np.asarray(copies), _unit(_stacked(vec))
        link = _linked(vec, vec, threshold)
        np.fill_diagonal(link, True)
        a, b = np.nonzero(np.triu(link, 1))
        tree = forest(a, b, len(node))
        a, b, root = a[tree], b[tree], np.arange(len(node))
        while (root[a] != root[b]).any():
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
        return pa.record_batch([pa.array(node), pa.array(link @ copies - 1, pa.int64()), pa.array(node[root])], ["node", "links", "root"])

    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        grp = np.asarray(rows["grp"])
        starts = np.flatnonzero(np.diff(grp, prepend=grp[0] - 1 if len(grp) else 0))
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            yield judged(rows[a:b])
        held = rows[int(starts[-1]) :] if len(starts) else None
    if held is not None and len(held):
        yield judged(held)


def members(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, tile, tiles, node, copies, vec) of all nodes with candidates, their group dealt into tiles by hash."""
    sizes = per_key(groups, ["grp"], F.count(F.lit(1)).alias("size"))
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    rows = groups.join(sizes, "grp").select("node", "grp", tiles.alias("tiles"))
    vec = F.col("embedding").cast("array<double>").alias("vec")
    tile = F.when(F.col("tiles") == 1, 0).otherwise(F.pmod(F.xxhash64("node"), F.col("tiles"))).cast("int")
    return nodes.select("node", "copies", vec).join(rows, "node").select("grp", tile.alias("tile"), "tiles", "node", "copies", "vec")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, at, part): the sums of unit vectors of each group in a batch."""
    for batch in batches:
        grp, row = np.unique(np.asarray(batch.column(0)), return_inverse=True)
        for rows, v in _matrices(batch.column(1)):
            total = np.zeros((len(grp), v.shape[1]))
            np.add.at(total, row[rows], _unit(v))
            seen = np.unique(row[rows])
            yield pa.record_batch([pa.array(np.repeat(grp[seen], v.shape[1])), pa.array(np.tile(np.arange(v.shape[1]), len(seen)), pa.int32()), pa.array(total[seen].ravel())], ["grp", "at", "part"])


def _cored(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Tiles with, for each node, whether it is certainly linked with all others of which that is said."""
    half = math.acos(threshold) / 2 - MARGIN
    for batch in batches:
        core = []
        for rows, centre in zip(batch.column(2), batch.column(3)):
            c = np.asarray(centre.values, np.float64)
            c = c / max(float(np.sqrt(c @ c)), 1e-300)
            v = _unit(_stacked(rows.values.field("vec")))
            core.append(np.arccos(np.clip(v @ c, -1, 1)) <= half)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.tolist() for c in core], pa.list_(pa.bool_()))], ["grp", "tile", "rows", "core"])


def _against(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Fringe nodes of one tile against all nodes of another: (node, links) both ways, and (node, peer) of a spanning forest."""
    for batch in batches:
        for q, rows, core in zip(batch.column(0), batch.column(1), batch.column(2)):
            q, rows, core = q.values, rows.values, np.asarray(core.values)
            qn, qc, qv = np.asarray(q.field("node")), np.asarray(q.field("copies")), _unit(_stacked(q.field("vec")))
            rn, rc, rv = np.asarray(rows.field("node")), np.asarray(rows.field("copies")), _unit(_stacked(rows.field("vec")))
            link = _linked(qv, rv, threshold) & (qn[:, None] != rn[None, :])
            back = np.where(core, qc @ link, 0)  # the links of fringe nodes come with their own tiles
            a, b = np.nonzero(link)
            tree = forest(a, b + len(qn), len(qn) + len(rn))
            a, b = qn[a[tree]], rn[b[tree]]
            pad = np.zeros(len(a), np.int64)
            yield pa.record_batch([pa.array(np.concatenate([qn, rn, a])), pa.array(np.concatenate([link @ rc, back, pad])), pa.array(np.concatenate([qn, rn, b]))], ["node", "links", "peer"])


def _large(members_: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, links) and links (a, b) of groups of several tiles."""
    sums = members_.select("grp", "vec").mapInArrow(_sums, "grp long, at int, part double").groupBy("grp", "at").agg(F.sum("part").alias("part"))
    centres = sums.groupBy("grp", F.xxhash64("grp").alias("spread")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]).alias("centre")).drop("spread")
    tiles = members_.groupBy("grp", "tile").agg(F.collect_list(F.struct("node", "copies", "vec")).alias("rows"))
    tiles = tiles.join(centres, "grp").select("grp", "tile", "rows", "centre")
    row = "rows array<struct<node: long, copies: long, vec: array<double>>>"
    tiles = rewritten(tiles.mapInArrow(lambda b: _cored(b, threshold), f"grp long, tile int, {row}, core array<boolean>"), "tiles")
    marked = tiles.select("grp", F.explode(F.arrays_zip("rows", "core")).alias("m")).select("grp", "m.rows.node", "m.rows.copies", "m.core")
    cores = per_key(marked.filter("core"), ["grp"], F.sum("copies").alias("total"), F.min("node").alias("first"))
    certain = marked.filter("core").join(cores, "grp")
    fringe = F.filter("rows", lambda r, i: ~F.get("core", i)).alias("q")
    asked = tiles.select("grp", fringe).filter(F.size("q") > 0).join(tiles.select("grp", "rows", "core"), "grp")
    shape = "node long, links long, peer long"
    judged = rewritten(asked.select("q", "rows", "core").mapInArrow(lambda b: _against(b, threshold), shape), "fringe")
    counted = certain.select("node", (F.col("total") - F.col("copies")).alias("links")).unionByName(judged.select("node", "links"))
    own = marked.select("node", (F.col("copies") - 1).alias("links"))  # equal vectors
    linked = counted.unionByName(own).groupBy("node").agg(F.sum("links").alias("links"))
    edges = certain.select(F.col("node").alias("a"), F.col("first").alias("b")).unionByName(judged.select(F.col("node").alias("a"), F.col("peer").alias("b"))).filter("a != b")
    return linked, edges


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row. `vectors`: vec_id, embedding, label."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    nodes = rewritten(nodes_of(rows), "nodes")
    groups = roots(candidates(spark, nodes, threshold)).select("node", F.col("root").alias("grp"))
    grouped = rewritten(members(nodes, groups), "members")
    small = grouped.filter("tiles = 1").repartition("grp").sortWithinPartitions("grp")
    small = rewritten(small.select("grp", "node", "copies", "vec").mapInArrow(lambda b: _small(b, threshold), "node long, links long, root long"), "small")
    linked, edges = _large(grouped.filter("tiles > 1"), threshold)
    large = linked.join(roots(edges), "node", "left").select("node", "links", F.coalesce("root", "node").alias("root"))
    judged = nodes.join(small.unionByName(large), "node", "left")
    judged = judged.select("label", "embedding", F.coalesce("links", F.col("copies") - 1).alias("links"), F.coalesce("root", "node").alias("root"))
    placed = rows.join(judged, ["label", "embedding"], "left")
    least = per_key(placed.filter("root IS NOT NULL"), ["root"], F.min("vec_id").alias("least"))
    named = placed.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least")))
    return named.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
