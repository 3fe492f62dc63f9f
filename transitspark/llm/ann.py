"""Nearest neighbours by cosine in robust-pruned directed graphs.

Equal vectors are one node. Nodes are dealt into shards by a hash; each shard's graph is
built from a random one in two passes (Subramanya et al., "DiskANN", 2019): a greedy search proposes
neighbours for a node, the relaxed pruning rule keeps those not much closer to a kept neighbour than to
the node, and kept edges are tried in reverse. A beam search then asks each shard, and the shards' answers
are merged. Scores of what is found are computed in double precision on the original vectors.

Queries meet shards in blocks, so a task holds one shard and one block. Each query is sent to every shard and
each shard to every block of queries, so shards and blocks grow with the square root of their tables, between
the bounds of `SHARD` and `QUERY_BLOCK`: what is sent grows with the power 1.5 of the input until they are at their
largest, and with the square beyond. The beam of a query grows with the root of its shard, since recall falls in larger
ones. A node carries its ids only up to one more than are asked for; the least ids win ties, so no more can count.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part,
nor do null ids; rows that repeat in full count once; an id with two vectors is two rows, and neither is
a candidate of the other; vectors of other lengths are no candidates; other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitspark.session import rewritten

SHARD, QUERY_BLOCK = (4096, 16_384), (2048, 65_536)
GROWTH, CELLS = 16, 20_000
DEGREE, BEAM, ASK_BEAM, RELAX = 24, 64, 128, 1.2
K, EVERY = 5, 50


class Graph:
    """Vectors of length one and the out-edges of each, -1 where there are fewer than DEGREE."""

    def __init__(self, unit: np.ndarray, edges: np.ndarray) -> None:
        self.unit, self.edges = unit, edges
        n = len(unit)
        centre = int(np.argmax(unit @ unit.mean(0)))
        self.entries = np.unique(np.append(np.linspace(0, n - 1, min(n, 16)).astype(np.int64), centre))

    def search(self, queries: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest nodes that a greedy search meets, nearest first, with their distances."""
        n, b = len(self.unit), len(queries)
        start = np.arange(n) if n <= beam else self.entries
        ids = np.full((b, beam), -1)
        far = np.full((b, beam), np.inf, np.float32)
        first = 1 - queries @ self.unit[start].T
        order = np.argsort(first, 1, kind="stable")[:, :beam]
        ids[:, : order.shape[1]], far[:, : order.shape[1]] = start[order], np.take_along_axis(first, order, 1)
        seen = np.zeros((b, n + 1), bool)
        seen[:, start], seen[:, n] = True, True  # the last column stands for a missing edge
        done = ~np.isfinite(far)
        if n <= beam:
            return ids, far
        live = np.arange(b)
        while len(live):
            open_ = ~done[live]
            pick = np.argsort(~open_, 1, kind="stable")[:, :wide]
            real = np.take_along_axis(open_, pick, 1)
            np.put_along_axis(sub := done[live], pick, True, 1)
            done[live] = sub
            near = self.edges[np.take_along_axis(ids[live], pick, 1)]
            near = np.where(real[:, :, None] & (near >= 0), near, n).reshape(len(live), -1)
            near = np.sort(near, 1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            new = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            gap = np.full(near.shape, np.inf, np.float32)
            r, c = np.nonzero(new)
            gap[r, c] = 1 - np.einsum("ij,ij->i", queries[live[r]], self.unit[near[r, c]])
            all_far = np.concatenate([far[live], gap], 1)
            keep = np.argpartition(all_far, beam - 1, 1)[:, :beam]
            keep = np.take_along_axis(keep, np.argsort(np.take_along_axis(all_far, keep, 1), 1, kind="stable"), 1)
            far[live] = np.take_along_axis(all_far, keep, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), keep, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~new], 1), keep, 1) | ~np.isfinite(far[live])
            live = live[~done[live].all(1)]
        return ids, far

    def prune(self, nodes: np.ndarray, around: np.ndarray, relax: float) -> np.ndarray:
        """Robust pruning of the candidates `around` each node (-1: none)."""
        n = len(self.unit)
        around = np.sort(np.where((around < 0) | (around == nodes[:, None]), n, around), 1)
        around[:, 1:][around[:, 1:] == around[:, :-1]] = n
        safe = np.minimum(around, n - 1)
        vectors = self.unit[safe]
        gap = np.maximum(0, 1 - np.einsum("ijk,ik->ij", vectors, self.unit[nodes]))
        gap[around == n] = np.inf
        order = np.argsort(gap, 1, kind="stable")
        around, gap = np.take_along_axis(around, order, 1), np.take_along_axis(gap, order, 1)
        vectors = np.take_along_axis(vectors, order[:, :, None], 1)
        between = np.maximum(0, 1 - vectors @ vectors.transpose(0, 2, 1))
        alive, row = np.isfinite(gap), np.arange(len(nodes))
        out = np.full((len(nodes), DEGREE), -1)
        for d in range(DEGREE):
            some = alive.any(1)
            if not some.any():
                break
            best = alive.argmax(1)
            out[some, d] = around[row, best][some]
            # distances here are half the squared ones, so the factor is squared
            alive &= relax * relax * between[row, best] > gap
            alive[row, best] = False
        return out


def ask_beam(nodes: int) -> int:
    return max(ASK_BEAM, 2 * math.isqrt(nodes))


def built(unit: np.ndarray, seed: int) -> Graph:
    n, random = len(unit), np.random.default_rng(seed)
    edges = random.integers(0, n, (n, DEGREE))
    edges[edges == np.arange(n)[:, None]] = -1
    graph = Graph(unit, edges)
    if n <= BEAM:
        return graph
    for relax in (1.0, RELAX):
        order = random.permutation(n)
        for a in range(0, n, 256):
            nodes = order[a : a + 256]
            met, _ = graph.search(unit[nodes], BEAM)
            graph.edges[nodes] = graph.prune(nodes, np.concatenate([met, graph.edges[nodes]], 1), relax)
            back, to = np.repeat(nodes, DEGREE), graph.edges[nodes].reshape(-1)
            back, to = back[to >= 0], to[to >= 0]
            order_to = np.argsort(to, kind="stable")
            back, to = back[order_to], to[order_to]
            ends, at, count = np.unique(to, return_index=True, return_counts=True)
            more = np.full((len(ends), count.max()), -1)
            more[np.repeat(np.arange(len(ends)), count), np.arange(len(to)) - np.repeat(at, count)] = back
            full = np.concatenate([graph.edges[ends], more], 1)
            room = (full >= 0).sum(1) <= DEGREE
            graph.edges[ends[room]] = np.sort(full[room], 1)[:, ::-1][:, :DEGREE]
            tight = np.flatnonzero(~room)
            for t in range(0, len(tight), 256):
                some = tight[t : t + 256]
                graph.edges[ends[some]] = graph.prune(ends[some], full[some], relax)
    return graph


def _matrix(column: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    flat = np.asarray(column.combine_chunks().flatten(), dtype=kind)
    return flat.reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("node")  # the same graph whatever order the rows came in
    graph = built(_unit(_matrix(table["vector"])), 7)
    edges = pa.array(list(graph.edges.astype(np.int32)), pa.list_(pa.int32()))
    return table.append_column("edges", edges).select(["length", "shard", "node", "vector", "ids", "edges"])


def _ask(shard: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    kind = pa.schema([("query_id", pa.int64()), ("query_node", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not len(shard) or not len(queries):
        return kind.empty_table()
    shard = shard.sort_by("node")
    vectors, asked = _matrix(shard["vector"]), _matrix(queries["vector"])
    graph = Graph(_unit(vectors), _matrix(shard["edges"], np.int64))
    ids, own, own_node = shard["ids"].to_pylist(), queries["query_id"].to_pylist(), queries["node"].to_pylist()
    length = np.sqrt((vectors * vectors).sum(1))
    rows: list[tuple] = []
    for a in range(0, len(asked), 256):
        met, _ = graph.search(_unit(asked[a : a + 256]), ask_beam(len(shard)))
        for i, found in enumerate(met, a):
            found = found[found >= 0]
            score = (vectors[found] * asked[i]).sum(1) / (length[found] * np.sqrt((asked[i] * asked[i]).sum()))
            near = sorted((-s, v) for s, f in zip(score.tolist(), found) for v in ids[f] if v != own[i])
            rows += [(own[i], own_node[i], v, -s) for s, v in near[:k]]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kind)] if rows else [pa.array([], f.type) for f in kind], schema=kind)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector, node, length) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(finite & F.exists("vector", lambda x: x != 0))
    return rows.withColumn("node", F.xxhash64("vector")).withColumn("length", F.size("vector"))


def parts(rows: int, size: tuple[int, int]) -> int:
    """How many parts `rows` are dealt into: of the least size, then of GROWTH times the root, up to the largest."""
    return max(1, -(-rows // min(max(size[0], GROWTH * math.isqrt(rows)), size[1])))


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, shard: tuple[int, int] = SHARD, block: tuple[int, int] = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose id is divisible by `every`."""
    rows = usable(vectors)
    # the least ids of each distinct vector; the limit is taken map-side before the exchange
    by_id = Window.partitionBy("node", "length").orderBy("vec_id")
    ids = rows.select("node", "length", "vec_id").distinct().withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
    ids = ids.groupBy("node", "length").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = rows.groupBy("node", "length").agg(F.first("vector").alias("vector")).join(ids, ["node", "length"])
    nodes = rewritten(nodes, "nodes")
    queries = rewritten(rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "node", "length", "vector").dropDuplicates(["query_id", "node"]), "queries")
    shards, blocks = parts(nodes.count(), shard), parts(queries.count(), block)
    # the work of a shard or cell is far larger than its bytes, so their partitions are named and not merged by size
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(shards)).cast("int")).repartition(2 * shards, "length", "shard")
    graphs = dealt.groupBy("length", "shard").applyInArrow(_build, "length int, shard int, node long, vector array<double>, ids array<long>, edges array<int>")
    graphs = rewritten(graphs, "graphs").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    key, cells = ["length", "shard", "block"], min(2 * shards * blocks, CELLS)
    graphs, asked = (df.repartition(cells, *key) for df in (graphs, asked))
    found = graphs.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(lambda a, b: _ask(a, b, k), "query_id long, query_node long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query_node").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
