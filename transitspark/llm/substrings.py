"""Repeated word windows by de Bruijn compaction.

The edges of the graph are all windows of `size` consecutive words. Edges that follow each other in one
text and share their smallest inner k-mer form a path: it cannot branch inside that text, so it is
carried as one row (rid, bucket = k-mer, content, first window, number of windows) instead of one row
per edge. Equal windows have equal smallest k-mers, so every repeat meets within its bucket:

1. a bucket with one path holds no repeat and is left out;
2. paths with equal content are repeated as a whole, by a join on (bucket, content);
3. where a bucket also holds a path that no other equals, its paths are cut open into single edges (one
   path for each content), and edges are counted again;
4. the source coordinates of repeated paths and edges go back to their texts, where neighbouring ones
   compact to long spans, and the words they cover are removed.

Bucket and content hashes are independent, 128 bits together. A text is keyed by a hash of its id and
text, so rows that repeat in full share a key; both count as places, and both get the same result.

Defined results: null and empty texts have no words; a text shorter than a window loses nothing; a null
id stays null; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitspark.llm.text import WHITE, Piece, Words, mix, pieces, signed, window_starts, words
from transitspark.session import rewritten

WINDOW = 35
KMER = 10

_PATHS = "rid long, bucket long, content long, first int, n int"
_EDGES = "bucket long, edge long, rid long, first int, weight long"


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the first of the smallest of every `width` consecutive values stands, by doubling."""
    best, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        less = best[step:] < best[: len(best) - step]
        best, at = np.where(less, best[step:], best[: len(best) - step]), np.where(less, at[step:], at[: len(at) - step])
        have += step
    return at


def windows_of(w: Words, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: its first word, its row, its bucket, and whether it begins a path.

    A path holds windows with the same k-mer as their first smallest one, so at most size - k + 1 of them,
    no two of them equal; equal windows have that k-mer at the same place.
    """
    first, row = window_starts(w.of, size)
    if not len(first):
        return first, row, np.zeros(0, np.uint64), np.zeros(0, bool)
    at = np.arange(len(w.hash) - k + 1)
    kmers = mix(w.spans().of(at, at + k) ^ np.uint64(k))
    least = first_least(kmers, size - k + 1)[first]
    begins = np.ones(len(first), bool)
    begins[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
    return first, row, kmers[least], begins


def _paths(batches: Iterator[pa.RecordBatch], size: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid = np.asarray(batch.column(0))
        for p in pieces(batch.column(1)):
            w = words(p, WHITE, fold=False)
            first, row, bucket, begins = windows_of(w, size, k)
            head = np.flatnonzero(begins)
            n = np.diff(np.append(head, len(first)))
            start = first[head]
            content = w.spans().of(start, start + n + size - 1) + n.astype(np.uint64)
            yield pa.record_batch(
                [rid[p.first + row[head]], signed(bucket[head]), signed(mix(content)), (start - w.of[row[head]]).astype(np.int32), n.astype(np.int32)],
                ["rid", "bucket", "content", "first", "n"],
            )


def _edges(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The windows of the paths in column 2 of each text, one row each."""
    for batch in batches:
        rid, opened = np.asarray(batch.column(0)), batch.column(2).to_pylist()
        for p in pieces(batch.column(1)):
            w = words(p, WHITE, fold=False)
            spans = w.spans()
            for i in range(p.rows):
                paths = opened[p.first + i]
                n = np.array([x["n"] for x in paths])
                at = np.repeat([x["first"] for x in paths], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                edge = spans.of(w.of[i] + at, w.of[i] + at + size)
                yield pa.record_batch(
                    [np.repeat(np.array([x["bucket"] for x in paths], np.int64), n), signed(edge), np.full(len(at), rid[p.first + i]), at.astype(np.int32), np.repeat(np.array([x["weight"] for x in paths], np.int64), n)],
                    ["bucket", "edge", "rid", "first", "weight"],
                )


def removed_words(count: int, spans: list[dict] | None, size: int) -> np.ndarray:
    """Which of `count` words lie in one of the repeated windows."""
    step = np.zeros(count + 1, np.int32)
    if spans:
        first = np.array([s["first"] for s in spans])
        np.add.at(step, first, 1)
        np.add.at(step, first + np.array([s["n"] for s in spans]) + size - 1, -1)
    return np.cumsum(step[:-1]) > 0


def kept_text(p: Piece, i: int, gone: np.ndarray) -> bytes:
    return b" ".join(compress(p.text(i).split(), ~gone))


def _digests(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(3).to_pylist()
        n_words, n_removed, digest = [], [], []
        for p in pieces(batch.column(2)):
            w = words(p, WHITE, fold=False)
            for i in range(p.rows):
                gone = removed_words(int(w.of[i + 1] - w.of[i]), spans[p.first + i], size)
                kept = kept_text(p, i, gone)
                n_words.append(len(gone))
                n_removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(kept).hexdigest())
        yield pa.record_batch([batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def repeated_paths(docs: DataFrame, size: int = WINDOW, k: int = KMER) -> DataFrame:
    """(rid, bucket, content, first, n) of all paths in buckets that hold more than one."""
    paths = keyed(docs).select("rid", "text").mapInArrow(lambda b: _paths(b, size, k), _PATHS)
    often = paths.groupBy("bucket").agg(F.count("*").alias("paths")).filter("paths > 1").select("bucket")
    return paths.join(often, "bucket", "left_semi").select("rid", "bucket", "content", "first", "n")


def repeated_windows(spark: SparkSession, docs: DataFrame, size: int = WINDOW, k: int = KMER) -> tuple[DataFrame, DataFrame]:
    """(texts by key, (rid, spans) of their repeated windows; a span is its first window and their number)."""
    texts = keyed(docs)
    paths = rewritten(repeated_paths(docs, size, k), "paths")
    whole = paths.groupBy("bucket", "content").agg(F.count("*").alias("weight"), F.min(F.struct("rid", "first", "n")).alias("one"))
    whole = rewritten(whole, "contents")
    mixed = whole.groupBy("bucket").agg(F.min("weight").alias("least"), F.count("*").alias("contents")).filter("least = 1 AND contents > 1").select("bucket")
    opened = whole.join(mixed, "bucket", "left_semi").select("one.rid", F.struct("one.first", "one.n", "bucket", "weight").alias("path"))
    opened = opened.groupBy("rid").agg(F.collect_list("path").alias("paths"))
    edges = texts.join(opened, "rid").dropDuplicates(["rid"]).select("rid", "text", "paths", "doc_id").mapInArrow(lambda b: _edges(b, size), _EDGES)
    edges = rewritten(edges, "edges")
    again = edges.groupBy("bucket", "edge").agg(F.sum("weight").alias("places")).filter("places > 1").select("bucket", "edge")
    single = edges.filter("weight = 1").join(again, ["bucket", "edge"], "left_semi").select("rid", "first", F.lit(1).alias("n"))
    as_wholes = paths.join(whole.filter("weight > 1").select("bucket", "content"), ["bucket", "content"], "left_semi").select("rid", "first", "n")
    spans = as_wholes.unionByName(single).distinct().groupBy("rid").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    return texts, spans


def without_repeats(spark: SparkSession, docs: DataFrame, size: int = WINDOW, k: int = KMER) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    texts, spans = repeated_windows(spark, docs, size, k)
    joined = texts.join(spans, "rid", "left").select("rid", "doc_id", "text", "spans")
    return joined.mapInArrow(lambda b: _digests(b, size), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def kept_texts(spark: SparkSession, docs: DataFrame, size: int = WINDOW, k: int = KMER) -> DataFrame:
    """(doc_id, kept) with the words that stay, joined by a space."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = batch.column(3).to_pylist(), []
            for p in pieces(batch.column(2)):
                w = words(p, WHITE, fold=False)
                for i in range(p.rows):
                    gone = removed_words(int(w.of[i + 1] - w.of[i]), spans[p.first + i], size)
                    kept.append(kept_text(p, i, gone).decode())
            yield pa.record_batch([batch.column(1), pa.array(kept, pa.string())], ["doc_id", "kept"])

    texts, spans = repeated_windows(spark, docs, size, k)
    return texts.join(spans, "rid", "left").select("rid", "doc_id", "text", "spans").mapInArrow(keep, "doc_id long, kept string")
