"""Periodic runs of words: maximal stretches that repeat with some period at least `LEAST_EXPONENT` times.

The words of many texts form one sequence of numbers with a separator of its own after each text. How far two places
of it agree (LCE) is answered by a difference cover: only suffixes that begin at places whose remainder
modulo 7 lies in {0, 1, 3} are sorted, by blocks of 7 words and then by doubling. For any two places some shift
below 7 brings both into the sample, so a question compares at most 6 words and ends in one range minimum
over the sample's common prefixes (a sparse table).

Runs are enumerated on a harmonic grid: a run of period q and at least 4q words covers a multiple of 3q together
with the q words after it, so each q is tried at every 3q-th word only, n log n places in all. Places
whose word and a neighbour do not recur q words later are out at once; texts with no other places are not
sorted. The first grid place of a run asks how far it goes on, and a bisection over LCEs finds where it begins.
A stretch with several periods goes to the smallest.

Words are told apart by their bytes, never by hashes. Defined results: null and empty texts have no words and no
runs, and collapse to the empty text; repeated rows give equal rows; a row without id is not altered by `looped`.
`collapsed` carries all columns of its input along, except those it makes (OUT). A task holds one batch and the words
of about a megabyte of text, or of one longer text, whose memory is linear in its words but for the logarithm of the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitspark.llm.text import PIECE_BYTES

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
STEP = LEAST_EXPONENT - 1
OUT = ("n", "runs", "text")
#: Places tried at a time.
CHUNK = 1 << 20

# Every difference modulo 7 is one of two members of the cover.
MODULUS, COVER = 7, (0, 1, 3)

Alter = Callable[[list[bytes], int | None], list[bytes]]


def _shifts() -> np.ndarray:
    """For two remainders, the least shift that brings both into the cover."""
    inside = lambda x: x % MODULUS in COVER
    return np.array([[next(d for d in range(MODULUS) if inside(a + d) and inside(b + d)) for b in range(MODULUS)] for a in range(MODULUS)])


SHIFTS = _shifts()


def _ranks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks from 1 on of rows compared by `keys`, most significant first, and the rows' order."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    rank = np.empty(len(order), np.int32)
    rank[order] = 1 + np.cumsum(new)
    return rank, order


class Extensions:
    """LCE questions on a sequence of numbers that ends in one which occurs nowhere else."""

    def __init__(self, sequence: np.ndarray) -> None:
        n = len(sequence)
        self.sequence = np.concatenate([sequence, np.full(MODULUS, sequence.max(initial=0) + 1)])
        sample = np.flatnonzero(np.isin(np.arange(n) % MODULUS, COVER))
        bits = max(int(self.sequence.max()).bit_length(), 1)
        per_key = max(63 // bits, 1)
        keys = []
        for first in range(0, MODULUS, per_key):
            key = np.zeros(len(sample), np.int64)
            for k in range(first, min(first + per_key, MODULUS)):
                key = key << bits | self.sequence[sample + k]
            keys.append(key)
        rank, order = _ranks(*keys)
        self.place = np.full(n + MODULUS, -1, np.int32)  # where each sampled suffix stands among the samples
        self.place[sample] = np.arange(len(sample))
        levels, size = [rank], MODULUS
        while rank.max(initial=0) < len(sample):
            onward = sample + size
            follow = np.where(onward < n, rank[self.place[np.minimum(onward, n - 1)]], 0)
            rank, order = _ranks(rank.astype(np.int64) << 32 | follow)
            levels.append(rank)
            size *= 2
        self.rank = rank  # 1 .. samples, all different
        self._table(sample, order, levels, n)

    def _table(self, sample: np.ndarray, order: np.ndarray, levels: list[np.ndarray], n: int) -> None:
        """The sparse table over the common prefixes of neighbours in the order of the samples."""
        a, b = sample[order[:-1]], sample[order[1:]]
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            x, y = a + common, b + common
            inside = np.maximum(x, y) < n
            same = inside & (levels[k][self.place[np.minimum(x, n - 1)]] == levels[k][self.place[np.minimum(y, n - 1)]])
            common += same * (MODULUS << k)
        for _ in range(MODULUS - 1):
            common += self.sequence[np.minimum(a + common, n)] == self.sequence[np.minimum(b + common, n)]
        rows = [common.astype(np.int32)]
        while len(rows[-1]) > 1 << (len(rows) - 1):
            half, last = 1 << (len(rows) - 1), rows[-1]
            rows.append(np.minimum(last[:-half], last[half:]))
        self.rows = rows

    def _least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least common prefix of neighbours low .. high - 1."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.rows[k][low[at]], self.rows[k][high[at] - (1 << k)])
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items agree from a on and from b on; a differs from b everywhere."""
        shift = SHIFTS[a % MODULUS, b % MODULUS]
        common, going = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for k in range(MODULUS - 1):
            going &= (k >= shift) | (self.sequence[a + np.minimum(k, shift)] == self.sequence[b + np.minimum(k, shift)])
            common += going & (k < shift)
        at = np.flatnonzero(going)
        if len(at):
            x, y = (self.rank[self.place[v[at] + shift[at]]].astype(np.int64) - 1 for v in (a, b))
            common[at] += self._least(np.minimum(x, y), np.maximum(x, y))
        return common


def _grid(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place) of all grid places of texts with so many words, some at a time."""
    most = np.where(counts >= LEAST_LENGTH, counts // LEAST_EXPONENT, 0)
    text = np.repeat(np.arange(len(counts)), most)
    period = 1 + np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most)
    places = (counts[text] - period - 1) // (STEP * period) + 1
    done = np.concatenate([[0], np.cumsum(places)])
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(done, done[i] + CHUNK, "right")) - 1)
        m = places[i:j]
        t, q = np.repeat(text[i:j], m), np.repeat(period[i:j], m)
        yield t, q, (np.arange(len(t)) - np.repeat(done[i:j] - done[i], m)) * STEP * q
        i = j


def _sequence(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all texts with separators around each, and where each text begins."""
    first = 1 + max((int(x.max(initial=-1)) for x in numbers), default=0)
    size = np.array([len(x) for x in numbers], np.int64)
    at = 1 + np.cumsum(size + 1) - size - 1
    out = np.empty(int(size.sum()) + len(size) + 1, np.int64)
    out[0] = first
    for k, (x, a) in enumerate(zip(numbers, at.tolist())):
        out[a : a + len(x)] = x
        out[a + len(x)] = first + 1 + k
    return out, at


def runs_of(numbers: list[np.ndarray]) -> np.ndarray:
    """(text, start, length, period) of every run, by text, start and period. `numbers`: the words of each text as integers."""
    counts = np.array([len(x) for x in numbers], np.int64)
    s, at = _sequence(numbers)
    kept = [np.zeros((3, 0), np.int64)]
    for text, q, i in _grid(counts):
        x = at[text] + i
        hit = np.flatnonzero(s[x] == s[x + q])
        x, y = x[hit], x[hit] + q[hit]
        # a run's words agree over at least 3q places, three or more
        hit = hit[(s[x + 1] == s[y + 1]) | (s[x - 1] == s[y - 1])]
        kept.append(np.stack([text[hit], q[hit], i[hit]]))
    text, q, i = np.concatenate(kept, axis=1)
    if not len(text):
        return np.zeros((0, 4), np.int64)
    some, text = np.unique(text, return_inverse=True)
    s, at = _sequence([numbers[k] for k in some])
    agree = Extensions(s)
    x = at[text] + i
    # the grid place before this one may lie in the same run
    earlier = i >= STEP * q
    back = np.where(earlier, x - STEP * q, x)
    first = ~earlier | (agree(back, back + q) < STEP * q)
    text, q, i, x = text[first], q[first], i[first], x[first]
    end = i + q + agree(x, x + q)
    low, high = np.maximum(i - STEP * q + 1, 0), i.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        y = at[text[open_]] + mid
        reaches = agree(y, y + q[open_]) >= i[open_] - mid
        high[open_[reaches]] = mid[reaches]
        low[open_[~reaches]] = mid[~reaches] + 1
    length = end - low
    long = length >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * q)
    found = np.stack([text, low, length, q], axis=1)[long]
    found = found[np.lexsort(found.T[[3, 2, 1, 0]])]
    new = np.ones(len(found), bool)  # of one stretch the smallest period
    new[1:] = (found[1:, :3] != found[:-1, :3]).any(axis=1)
    found = found[new]
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    found[:, 0] = some[found[:, 0]]
    return found


class _Numbers(dict):
    """Numbers words by first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """One document in ten with its tail replaced by repetitions, as its id's checksum says."""
    h, n = 1 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    once = words[a : a + p]
    return words[:a] + (once * ((n - a) // len(once) + 1))[: n - a]


def _groups(texts: pa.Array, ids: pa.Array, alter: Alter | None) -> Iterator[list[list[bytes]]]:
    """The words of neighbouring texts, about a piece at a time."""
    group, size = [], 0
    for text, doc_id in zip(texts, ids):
        data = text.as_buffer() or b""
        words = bytes(data).split()  # at ASCII white space
        group.append(alter(words, doc_id.as_py()) if alter else words)
        size += len(data)
        if size >= PIECE_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 1] + runs[:, 3], 1)
    np.add.at(edge, runs[:, 1] + runs[:, 2], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def collapsed(docs: DataFrame, alter: Alter | None = None) -> DataFrame:
    """The columns of `docs`, and n (words), runs (start, length, period) and text: each run cut down to its first period.

    `alter` may change the words of a document (words, doc_id) before they are looked at.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for group in _groups(batch.column(2), batch.column(1), alter):
                number = _Numbers().__getitem__
                runs = runs_of([np.fromiter(map(number, words), np.int64, len(words)) for words in group])
                at = np.searchsorted(runs[:, 0], np.arange(len(group) + 1))
                texts = [_collapse(words, runs[a:b]) for words, a, b in zip(group, at[:-1], at[1:])]
                fields = pa.StructArray.from_arrays([pa.array(runs[:, c], pa.int64()) for c in (1, 2, 3)], ["start", "length", "period"])
                n = pa.array([len(words) for words in group], pa.int64())
                # what is left are whole words of the text, so it is UTF-8
                out = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + len(group)], n, pa.ListArray.from_arrays(pa.array(at, pa.int32()), fields), out], ["row", *OUT])
                first += len(group)

    rows = docs.select(F.struct(*[c for c in docs.columns if c not in OUT]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    made = T.StructType.fromDDL("n long, runs array<struct<start: long, length: long, period: long>>, text string")
    return rows.mapInArrow(work, T.StructType([rows.schema["row"], *made.fields])).select("row.*", *OUT)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every row, tails `looped` first."""
    out = collapsed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), looped)
    # exact comparison of length / period; runs come by start and period, so the first of equals stays
    better = lambda best, run: F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    best = F.col("best")
    return out.withColumn("best", F.aggregate("runs", none, better)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(F.expr("(1000 * best.length) div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("text"), 256).alias("collapsed_sha256"),
    )
