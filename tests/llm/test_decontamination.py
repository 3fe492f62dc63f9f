"""Decontamination against brute force: distances, long items, several blocks."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from transitspark.llm import decontaminate
from transitspark.llm.text import WHITE, pieces, words


def plain(item, row):
    """All prefix distances by the textbook table."""
    line = list(range(len(row) + 1))
    for i, a in enumerate(item, 1):
        fresh = [i]
        for j, b in enumerate(row, 1):
            fresh.append(min(line[j] + 1, fresh[-1] + 1, line[j - 1] + (a != b)))
        line = fresh
    d = min(line)
    return d, line.index(d)


@pytest.mark.parametrize("most", [None, 0, 1, 3, 8])
def test_distances_equal_the_whole_table(most):
    rng = random.Random(3)
    for n in (1, 2, 5, 17, 40):
        item = [rng.randint(1, 6) for _ in range(n)]
        rows = []
        for _ in range(30):
            row = list(item)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(row) + 1)
                row[at : at + rng.randint(0, 1)] = [rng.randint(1, 6)] * rng.randint(0, 2)
            rows.append((row + [rng.randint(1, 6) for _ in range(10)])[: n + 8] + [0] * max(0, n + 8 - len(row) - 10))
        distance, length = decontaminate.least_distance(np.array(item, np.uint64), np.array(rows, np.uint64), most)
        for d, z, row in zip(distance.tolist(), length.tolist(), rows):
            want = plain(item, row)
            if most is None or want[0] <= most:
                assert (d, z) == want
            else:
                assert d > most


def test_a_long_item_takes_little_memory():
    rng = random.Random(8)
    item = [f"w{rng.randrange(10**9)}" for _ in range(2000)]
    near = list(item)
    for at in rng.sample(range(2000), 100):
        near[at] = "changed"
    block = decontaminate.Items([1], [" ".join(item)])
    text = " ".join(["before"] * 50 + near + ["after"] * 50)
    piece = next(pieces(pa.array([text, "nothing here"]), 1 << 30))
    w = words(piece, WHITE, fold=True)
    tracemalloc.start()
    found = block.found(w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(f[0], f[2], f[3], f[4]) for f in found] == [(0, 50, 2000, 100)]
    assert peak < 300 << 20


def test_blocks_of_items_give_what_one_block_gives(spark):
    rng = random.Random(9)
    items = [" ".join(f"v{rng.randrange(500)}" for _ in range(20)) for _ in range(40)]
    docs = [(i, f"start {items[i % 40]} {items[(i + 1) % 40]} end" if i % 3 else None, "x") for i in range(50)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, found string")
    benchmark = spark.createDataFrame([*enumerate(items), (99, None), (98, "")], "item_id long, text string")
    one = decontaminate.with_items(docs, benchmark).collect()
    many = decontaminate.with_items(docs, benchmark, block_bytes=400).collect()
    plain_rows = lambda found: sorted((r["row"]["doc_id"], sorted((f["item_id"], f["first_word"], f["n_words"], f["distance"]) for f in r["found"])) for r in found)
    assert plain_rows(one) == plain_rows(many)
    assert sum(len(r["found"]) for r in one) == sum(2 for i in range(50) if i % 3)
