"""Periodic runs against a scan of every period of small texts."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from transitspark.llm import periods

SCHEMA = "doc_id long, text string, n string, runs int, id double, row int"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def scan(words):
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, length, q) for (s, length), q in best.items()), key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    w = [x for x in (text or "").replace("\x85", "\x85").encode().split()]
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = scan(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return doc_id, len(runs), *best, milli, sha(lines), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()


def looped_texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 3, "x " + "a b c " * 4 + "a b y", "é\x85é " * 9, "a a " * 7, ("a " * 8 + "b ") * 5]
    for _ in range(150):
        w = [str(rng.randrange(rng.choice([2, 3, 60]))) for _ in range(rng.randrange(70))]
        for _ in range(rng.randrange(3)):
            p = [str(rng.randrange(3)) for _ in range(rng.randrange(1, 9))]
            w += (p * rng.randrange(2, 8))[: rng.randrange(1, 60)]
        out.append(" ".join(w))
    return out


def test_digests(spark):
    texts = [*enumerate(looped_texts()), (None, "q " * 30), (3, "r " * 9), (3, "r " * 9)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts) > 5
    docs = spark.createDataFrame([(i, t, "n", 1, 2.0, 3) for i, t in texts], SCHEMA)
    got = sorted(str(tuple(r)) for r in periods.digests(docs).collect())
    assert got == sorted(str(digest(i, t)) for i, t in texts)
    assert periods.digests(docs.limit(0)).count() == 0


def test_collapsed_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "go " * 20 + "stop", "n", 1, 2.0, 3)], SCHEMA)
    row = periods.collapsed(docs).collect()[0]
    assert (row.doc_id, row.id, row.row, row.n, row.text) == (1, 2.0, 3, 21, "go stop") and [tuple(r) for r in row.runs] == [(0, 20, 1)]


def test_long_texts():
    """Long periodic texts, among others, in little time and memory."""
    rng = np.random.default_rng(2)
    noise = rng.integers(0, 1000, 50_000)
    cases = [np.zeros(300_000, np.int64), np.arange(400_000) % 1000, noise, np.tile(noise, 5), np.arange(100_000)]
    want = [[0, 0, 300_000, 1], [1, 0, 400_000, 1000], [3, 0, 250_000, 50_000]]
    assert periods.runs_of(cases).tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=5))
def test_runs_of_any_sequences(texts):
    got = periods.runs_of([np.array(t, np.int64) for t in texts])
    assert got.tolist() == [[k, *r] for k, t in enumerate(texts) for r in scan(t)]


def test_extensions():
    rng = np.random.default_rng(6)
    s, _ = periods._sequence([np.concatenate([rng.integers(0, 2, 300), np.tile([0, 1, 1], 40)])])
    agree = periods.Extensions(s)
    a, b = rng.integers(1, len(s), (2, 4000))
    a, b = a[a != b], b[a != b]
    want = [next((k for k in range(len(s)) if max(i, j) + k >= len(s) or s[i + k] != s[j + k])) for i, j in zip(a.tolist(), b.tolist())]
    assert agree(a, b).tolist() == want
