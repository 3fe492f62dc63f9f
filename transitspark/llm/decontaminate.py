"""Benchmark passages in documents, up to a bounded edit distance over words.

A window of item size can be within the bound of an item only if it shares enough of the item's word
grams with it (each edit spoils at most three), so one pass over the texts keeps just those windows: a
filter without loss. Each kept window and each item is embedded by random walks that turn edit distance
into Hamming distance (Chakraborty, Goldenberg and Koucky, "Streaming algorithms for embedding and
computing edit distance", 2016). Samples of embedded places are the hash values; a window that agrees
with an item in any of `WALKS * SAMPLES` samples is verified by its exact edit distance. The target recall is
0.99 for items edited up to the largest bound; a test measures it on random words, for items of 10 to 80 words.

The benchmark is read in blocks of about `BLOCK_BYTES`, each a pass over the documents that is written before the
next one begins, so what a task holds does not grow with it. Windows are embedded and compared in chunks of
`CHUNK_BYTES`, and distances along the diagonals the bound allows, so it hardly grows with an item's length.

An item of n words is found where the distance is at most n // 5 words (items under 10 words: 0). Words are
as white space parts them, with A-Z lower-cased.

Defined results: null or empty texts hold nothing; null, empty and wordless items are found nowhere; items of
equal words are each reported; a repeated row is reported as often as it is there; ids may be null; an
empty benchmark finds nothing; other columns are carried along by `decontaminated`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitspark.llm.text import WHITE, mix, pieces, words
from transitspark.session import rewritten

GRAM, WALKS, SAMPLES, PLACES = 3, 8, 12, 3
BLOCK_BYTES = 4 << 20
#: Bytes of words of the windows that are embedded and compared at once.
CHUNK_BYTES = 16 << 20

_FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("distance", T.LongType())]))


def bound(n: int) -> int:
    return n // 5 if n >= 10 else 0


def embedded(windows: np.ndarray, walk_seed: int = 0) -> np.ndarray:
    """Samples of the random-walk embeddings of each row of words: rows x (WALKS * SAMPLES) hash values.

    A sample of padding alone, beyond the end of the walk, tells nothing of the words and is 0.
    """
    rows, n = windows.shape
    steps = 3 * n
    padded = np.concatenate([windows, np.zeros((rows, 1), np.uint64)], 1)
    random = np.random.default_rng(walk_seed + n)
    places = random.integers(0, steps, (WALKS, SAMPLES, PLACES))
    salt = random.integers(1, 1 << 63, (steps, WALKS), dtype=np.uint64)
    at = np.zeros((rows, WALKS), np.int64)
    # only the letters at sampled steps are kept, so memory does not grow with the length of the walk
    met = np.zeros((rows, WALKS, SAMPLES, PLACES), np.uint64)
    order = np.argsort(places, axis=None, kind="stable")
    cut = np.searchsorted(places.ravel()[order], np.arange(steps + 1))
    index = np.arange(rows)[:, None]
    for j in range(steps):
        letter = padded[index, at]
        if cut[j] < cut[j + 1]:
            w, k, p = np.unravel_index(order[cut[j] : cut[j + 1]], places.shape)
            met[:, w, k, p] = letter[:, w]
        coin = ((letter ^ salt[j]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
        at = np.minimum(at + coin.astype(np.int64), n)
    out = np.zeros((rows, WALKS, SAMPLES), np.uint64)
    for p in range(PLACES):
        out = mix(out * np.uint64(31) + met[..., p])
    return np.where((met != 0).any(3), out, np.uint64(0)).reshape(rows, -1)


def agreed(samples: np.ndarray, of_item: np.ndarray) -> np.ndarray:
    """How many samples each row shares with the item; samples of padding alone do not count."""
    return ((samples == of_item) & (of_item != 0)).sum(1)


def agreeing(samples: np.ndarray, of_item: np.ndarray) -> np.ndarray:
    """Which rows share a sample with the item; samples of padding alone do not count."""
    return agreed(samples, of_item) > 0


def least_distance(item: np.ndarray, after: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edit distance between `item` and the best beginning of each row of `after`, and that beginning's length.

    With `most`, exact up to that distance; a row beyond it gets some greater number. Only the 2 * most + 1
    diagonals that such a distance can reach are kept, and rows that have left them all are given up.
    """
    n, (rows, width) = len(item), after.shape
    most = max(n, width) if most is None else most
    band, beyond = 2 * most + 1, n + width + 1
    # column c of the line for i words of the item stands for a beginning of i + c - most words
    letters = np.zeros((rows, most + max(width, n + most)), np.uint64)
    letters[:, most : most + width] = after
    # a beginning ends inside the row
    ends = np.arange(band) - most
    line = np.broadcast_to(np.where((ends >= 0) & (ends <= width), ends, beyond).astype(np.int32), (rows, band))
    distance, length = np.full(rows, most + 1), np.zeros(rows, np.int64)
    live, climb = np.arange(rows), np.arange(band, dtype=np.int32)
    for i, letter in enumerate(item, 1):
        fresh = line + (letters[:, i - 1 : i - 1 + band] != letter)
        np.minimum(fresh[:, :-1], line[:, 1:] + 1, out=fresh[:, :-1])
        fresh = np.minimum.accumulate(fresh - climb, 1) + climb
        fresh[:, (ends + i < 0) | (ends + i > width)] = beyond
        line = fresh
        if i % 16 == 0:
            some = line.min(1) <= most
            if not some.all():
                line, letters, live = line[some], letters[some], live[some]
                if not len(live):
                    return distance, length
    best = line.argmin(1)
    distance[live] = np.maximum(line[np.arange(len(live)), best], 0)
    length[live] = best - most + n
    return distance, length


class Items:
    """One block of benchmark items, ready to be looked for."""

    def __init__(self, ids: list[int | None], texts: list[str]) -> None:
        p = next(pieces(pa.array(texts, pa.string()), 1 << 40))
        w = words(p, WHITE, fold=True)
        self.ids = ids
        self.words = [w.hash[a:b] for a, b in zip(w.of[:-1], w.of[1:])]
        spans, self.grams = w.spans(), {}
        for size in sorted({min(GRAM, len(x)) for x in self.words if len(x)}):
            of = defaultdict(list)
            for item, (a, b) in enumerate(zip(w.of[:-1], w.of[1:])):
                if min(GRAM, b - a) == size:
                    first = np.arange(a, b - size + 1)
                    for g in np.unique(spans.of(first, first + size)).tolist():
                        of[g].append(item)
            keys = np.array(sorted(of), np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[keys >> np.uint64(44)] = True
            self.grams[size] = (keys, seen, [np.array(of[k]) for k in keys.tolist()])
        self.samples: dict[int, np.ndarray] = {}

    def sample(self, item: int) -> np.ndarray:
        if item not in self.samples:
            self.samples[item] = embedded(self.words[item][None, :])[0]
        return self.samples[item]

    def found(self, w) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, words, distance): the best place of each item in each text of a piece."""
        spans, votes = w.spans(), []
        for size, (keys, seen, of) in self.grams.items():
            first = np.arange(max(0, len(w.hash) - size + 1))
            gram = spans.of(first, first + size)
            first = first[seen[gram >> np.uint64(44)]]
            k = np.searchsorted(keys, gram[first])
            hit = keys[np.minimum(k, len(keys) - 1)] == gram[first]
            first, k = first[hit], k[hit]
            row = w.text_of(first)
            inside = first + size <= w.of[row + 1]
            first, k, row = first[inside], k[inside], row[inside]
            n = np.array([len(of[x]) for x in k], np.int64)
            items = np.concatenate([of[x] for x in k]) if len(k) else np.zeros(0, np.int64)
            votes.append(np.stack([items, np.repeat(row, n), np.repeat(first, n)], 1))
        if not votes:
            return []
        votes = np.concatenate(votes).astype(np.int64)
        out = []
        for part in np.split(*(lambda v: (v, np.flatnonzero(np.diff(v[:, 0])) + 1))(votes[np.lexsort((votes[:, 2], votes[:, 1], votes[:, 0]))])):
            if len(part):
                out += self._places(int(part[0, 0]), part[:, 1], part[:, 2], w)
        return out

    def _places(self, item: int, row: np.ndarray, at: np.ndarray, w) -> list[tuple[int, int, int, int, int]]:
        word = self.words[item]
        n = len(word)
        e, size = bound(n), min(GRAM, n)
        # distinct grams of the item that an unharmed window shares are fewer if the item repeats some; hits
        # count every place, so the least number of places is what the grams of the item itself number
        need = max(1, n - size + 1 - size * e)
        # windows [s, s + n + e) that hold enough hits: each starts no later than the first hit it needs
        last = np.arange(len(at)) + need - 1
        ok = last < len(at)
        ok[ok] &= (row[last[ok]] == row[ok]) & (at[last[ok]] - at[ok] < n + e)
        heads = np.flatnonzero(ok)
        if not len(heads):
            return []
        lo = np.maximum(w.of[row[heads]], at[last[heads]] + size - n - e)
        starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, at[heads])]))
        rows = w.text_of(starts)
        end = w.of[rows + 1]
        out: dict[int, tuple] = {}
        chunk = max(1, CHUNK_BYTES // (8 * (n + e)))
        for a in range(0, len(starts), chunk):
            s, r = starts[a : a + chunk], rows[a : a + chunk]
            reach = s[:, None] + np.arange(n + e)
            after = np.where(reach < end[a : a + chunk, None], w.hash[np.minimum(reach, len(w.hash) - 1)], np.uint64(0))
            agree = agreed(embedded(after[:, :n]), self.sample(item))
            s, r, after, agree = s[agree > 0], r[agree > 0], after[agree > 0], agree[agree > 0]
            # the likeliest place of each text first: its distance bounds what the others need be told apart to
            likely = np.zeros(len(s), bool)
            order = np.lexsort((s, -agree, r))
            likely[order[np.flatnonzero(np.diff(r[order], prepend=-1))]] = True
            for some in (likely, ~likely):
                known = np.array([out[y][0] if y in out else e for y in r[some].tolist()], np.int64)
                for most in np.unique(known).tolist():
                    at_once = np.flatnonzero(some)[known == most]
                    distance, length = least_distance(word, after[at_once], most)
                    for d, x, y, z in zip(distance.tolist(), s[at_once].tolist(), r[at_once].tolist(), length.tolist()):
                        if d <= most and (y not in out or (d, x) < out[y][:2]):
                            out[y] = (d, x, z)
        return [(y, item, x - int(w.of[y]), z, d) for y, (d, x, z) in out.items()]


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list, list]]:
    """The items in blocks of about `block_bytes` of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for b in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield [x[0] for x in some], [x[1] for x in some]


def with_items(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row: all columns of `docs`, found: array of item_id, first_word, n_words, distance)."""
    out = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"), F.array().cast(_FOUND).alias("found"))
    for number, (ids, texts) in enumerate(blocks_of(benchmark, block_bytes)):
        if number:
            out = rewritten(out, "searched")  # one block, and one Python worker, at a time
        items = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def look(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            block = Items(*items.value)
            for batch in batches:
                found: list[list] = [list(x) for x in batch.column(2).to_pylist()]
                for p in pieces(batch.column(1)):
                    for r, item, first, n, d in block.found(words(p, WHITE, fold=True)):
                        found[p.first + r].append({"item_id": block.ids[item], "first_word": first, "n_words": n, "distance": d})
                for x in found:
                    x.sort(key=lambda f: (f["item_id"] is not None, f["item_id"], f["first_word"]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, batch.schema.field(2).type)], schema=batch.schema)

        out = out.mapInArrow(look, out.schema)
    return out.select("row", "found")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance): every benchmark item found in a document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_items(slim, benchmark).select(F.col("row.doc_id").alias("doc_id"), F.explode("found").alias("f"))
    return found.select("doc_id", "f.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no benchmark item."""
    return with_items(docs, benchmark).filter(F.size("found") == 0).select("row.*")
