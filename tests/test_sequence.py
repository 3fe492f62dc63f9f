"""Blocks against brute force, with a key that holds most of the rows."""

import random

import pytest
from conftest import frame
from pyspark.sql import functions as F

from transitspark.operators.sequence import block_of, nearest_rank, with_carried, with_neighbour


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    found = []
    for key in range(40):
        size = 400 if key == 0 else rng.randint(1, 9)
        order = rng.sample(range(2000), size)
        found += [(key, o, rng.randint(0, 5), rng.choice([None, None, "reset", "5", "7"])) for o in order]
    rng.shuffle(found)
    return found


def by_key(rows):
    keys = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        keys.setdefault(r[0], []).append(r)
    return keys.values()


@pytest.mark.parametrize("following", [True, False])
@pytest.mark.parametrize("size", [1, 16, 10_000])
def test_neighbour(spark, rows, following, size):
    df = frame(spark, "k int, o int, v int, m string", rows)
    out = with_neighbour(df, ["k"], ["o"], block_of(F.col("o"), size), ["o", "v"], "n", following)
    got = {(r["k"], r["o"]): (r["n"]["o"], r["n"]["v"]) if r["n"] else None for r in out.collect()}
    want = {}
    for group in by_key(rows):
        for i, r in enumerate(group):
            j = i + 1 if following else i - 1
            want[r[0], r[1]] = group[j][1:3] if 0 <= j < len(group) else None
    assert got == want


@pytest.mark.parametrize("size", [1, 16, 10_000])
def test_carried_value_with_reset(spark, rows, size):
    df = frame(spark, "k int, o int, v int, m string", rows)
    known = F.when(F.col("m") != "reset", F.col("m"))
    marker = F.when(F.col("m").isNotNull(), F.struct(known.alias("x")))
    out = with_carried(df, ["k"], ["o"], block_of(F.col("o"), size), marker, "c")
    got = {(r["k"], r["o"]): (r["c"]["x"],) if r["c"] else None for r in out.collect()}
    want = {}
    for group in by_key(rows):
        last = None
        for r in group:
            if r[3] is not None:
                last = (None if r[3] == "reset" else r[3],)
            want[r[0], r[1]] = last
    assert got == want


def test_nearest_rank(spark):
    df = frame(spark, "k string, x int", [("a", x) for x in (5, 1, 1, 9)] + [("b", 3), ("b", None)])
    got = {r["k"]: (r["row_count"], r["p"], r["q"]) for r in nearest_rank(df, ["k"], "x", {"p": 0.5, "q": 0.95}).collect()}
    assert got == {"a": (4, 1, 9), "b": (1, 3, 3)}
