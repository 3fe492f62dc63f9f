"""Operators on one very long text or item: the same results as brute force, in bounded steps."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from transitspark.llm import pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def test_many_matches_in_one_text(spark):
    random.seed(4)
    text = "".join(f"u{i}@ex{i % 7}.com é token=AbcdefGhij{i:012d}xyZ" + " " * random.randint(1, 5) for i in range(15_000))
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no match")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_spans(docs).collect()}
    assert [(s["start"], s["stop"]) for s in found[1]["base"] if s["kind"] == 0] == [m.span() for m in re.finditer(EMAIL, text)]
    secrets = [m.span(1) for m in re.finditer(r"token=(\w+)", text)]
    base = [(s["start"], s["stop"]) for s in found[1]["base"] if s["kind"] != 0]
    taken = {j for a, b in base for j in range(a, b)}
    assert {(s["start"], s["stop"]) for s in found[1]["added"]} <= {(a, b) for a, b in secrets if taken.isdisjoint(range(a, b))}
    assert all(found[i]["base"] == found[i]["added"] == [] for i in (2, 3, 4))


def test_running_sums_of_every_length(spark):
    rows = [(n, [(7 * i) % 11 for i in range(n)]) for n in (0, 1, 2, 3, 4, 5, 9, 10, 16, 17, 100, 1000)]
    df = pii.running(spark.createDataFrame(rows, "n int, v array<int>"), {"s": "v"}, lambda a, b: a + b)
    for r in df.select("n", "v", "s").collect():
        assert r["s"] == [sum(r["v"][:i]) for i in range(r["n"])]


def test_spans_apart_equal_brute_force(spark):
    random.seed(5)
    kind = pii._CANDIDATE
    fill = lambda a, n: (4, a, a + n, False, [0], [0])
    rows = [(i, [fill(random.randint(0, 60), random.randint(1, 9)) for _ in range(random.randint(0, 12))], [fill(random.randint(0, 60), random.randint(1, 9)) for _ in range(random.randint(0, 5))]) for i in range(60)]
    df = pii.apart(spark.createDataFrame(rows, f"i int, more {kind}, base {kind}"), "more", "base")
    got = {r["i"]: sorted((s["start"], s["stop"]) for s in r["more"]) for r in df.select("i", "more").collect()}
    assert got == {i: sorted((m[1], m[2]) for m in more if all(b[2] <= m[1] or b[1] >= m[2] for b in base)) for i, more, base in rows}


def test_a_secret_longer_than_any_token_is_found(spark):
    key = "".join(random.Random(1).choices("abcdefghijABCDEFGHIJ0123456789", k=900))
    docs = spark.createDataFrame([(i, f"the api_key={key} and token=ghp_{i:030d}Ab") for i in range(30)], "doc_id long, text string")
    for r in pii.find_spans(docs).where(F.col("doc_id") == 0).collect():
        assert (12, 912) in [(s["start"], s["stop"]) for s in r["added"]]
