"""Near-duplicate vectors against all pairs of small tables, and the planned recall of the passes."""

from __future__ import annotations

import math

import numpy as np
import pytest

from transitspark.llm import vectors
from transitspark.llm.unions import roots

SCHEMA = "vec_id long, embedding array<float>, label int, node string, links int, root long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], g, "x", 1, 2) for i, v, g in rows], SCHEMA)


def sound(v, label):
    return label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def all_pairs(rows, threshold=vectors.THRESHOLD):
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))
    v = [np.array(r[1], np.float32).astype(float) if sound(r[1], r[2]) else None for r in rows]
    for i in range(n):
        for j in range(i):
            if v[i] is not None and v[j] is not None and rows[i][2] == rows[j][2] and len(v[i]) == len(v[j]):
                x, y = v[i] / np.abs(v[i]).max(), v[j] / np.abs(v[j]).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root = [root[j] if r == root[i] else r for r in root]
    ids = [[rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None] for i in range(n)]
    least = [min(x) if x else None for x in ids]
    return sorted(((r[0], links[i], least[i], least[i] is not None and least[i] == r[0]) for i, r in enumerate(rows)), key=str)


def found(spark, rows):
    return sorted((tuple(r) for r in vectors.near_vectors(spark, frame(spark, rows)).collect()), key=str)


def test_odd_rows(spark):
    one, inf, nan = [1.0, 2.0, 0.0], float("inf"), float("nan")
    rows = [
        (1, one, 1), (2, one, 1), (3, [2.0, 4.0, 0.0], 1), (4, one, 2), (5, one, None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1), (9, [1.0, None, 2.0], 1),
        (10, [1.0, inf, 2.0], 1), (11, [1.0, nan, 2.0], 1), (12, [1.0, 2.0], 1), (13, [1.0, 2.0, 0.1], 1), (13, one, 1), (None, one, 1), (None, [0.0, 0.0, -1.0], 1),
        (14, [3e38, 6e38, 0.0], 1), (15, [1e-38, 2e-38, 0.0], 1), (16, [-1.0, -2.0, 0.0], 1),
    ]
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v], g) for i, v, g in rows]
    assert found(spark, rows) == all_pairs(rows)
    assert found(spark, []) == []


def test_groups_of_one_tile_and_of_several(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(32), i % 3) for i in range(300)]
    for spread, size in ((0.02, 90), (0.07, 60), (0.055, 40)):  # tight; about the threshold, partly linked; between
        centre = rng.standard_normal(32)
        centre /= np.linalg.norm(centre)
        rows += [(len(rows) + k, centre + spread * rng.standard_normal(32), 1) for k in range(size)]
    rows += [(len(rows) + k, rows[310][1], 1) for k in range(25)]  # one frequent vector
    assert found(spark, rows) == all_pairs(rows)


@pytest.mark.parametrize("nodes", [500, 20_000])
def test_pairs_at_the_threshold_meet(nodes):
    """A planted pair at the very threshold among unrelated vectors, over many pairs: as many meet as planned."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((nodes, 48))
    base /= np.linalg.norm(base, axis=1)[:, None]
    pairs = 200
    other = rng.standard_normal((pairs, 48))
    other -= (other * base[:pairs]).sum(1)[:, None] * base[:pairs]
    other /= np.linalg.norm(other, axis=1)[:, None]
    twins = vectors.THRESHOLD * base[:pairs] + math.sqrt(1 - vectors.THRESHOLD**2) * other
    bits = np.concatenate([base, twins]) @ vectors._directions(48) >= 0
    met = np.zeros(pairs, bool)
    for order in vectors._orders(vectors.passes_for(len(bits), vectors.THRESHOLD)):
        key = np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view("S32")[:, 0]
        place = np.empty(len(key), np.int64)
        place[np.argsort(key, kind="stable")] = np.arange(len(key))
        met |= np.abs(place[:pairs] - place[nodes:]) <= vectors.WINDOW
    near = (bits[:pairs] != bits[nodes:]).sum(1) <= vectors.most_bits(vectors.THRESHOLD)
    assert near.all() and met.mean() >= 0.985


def test_roots(spark):
    links = [(1, 2), (2, 1), (3, 3), (None, 4), (4, 5), (6, 5), (9, 8), (8, 7), (7, 10), *((100 + i, 101 + i) for i in range(40))]
    got = dict(roots(spark.createDataFrame(links, "a long, b long")).collect())
    want = {1: 1, 2: 1, 4: 4, 5: 4, 6: 4, **{k: 7 for k in (7, 8, 9, 10)}, **{100 + i: 100 for i in range(41)}}
    assert got == {k: v for k, v in want.items()}
    assert roots(spark.createDataFrame([], "a long, b long")).count() == 0
