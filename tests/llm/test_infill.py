"""Fill-in-the-middle against plain Python on characters."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from transitspark.llm import infill
from transitspark.llm.text import pieces

SCHEMA = "doc_id long, text string, n string, output int, form double, h0 long, extra string"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def plain(doc_id, text, layout):
    h = hashlib.sha256(f"{layout.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t) if layout.unit == infill.LINE else list(t)
    n = len(units)
    c, d = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, c), (c, d), (d, n)))
    marks = layout.prefix, layout.suffix, layout.middle
    if not t or any(x in t for x in marks) or h[2] % 100 >= layout.rate:
        return n, "plain", None, None, t
    spm = h[3] % 100 < layout.spm_rate
    return n, "spm" if spm else "psm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m if spm else marks[0] + p + marks[1] + s + marks[2] + m


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    odd = [None, "", "\n", "\n\n", "a", "a\n", "\na", "é", "日本\n語", "💥\n", "a\r\nb", "x <P> y", "<S>", "<M", "<P", ">\n<", "S>\nP>", " x\x85\n\x0b", "a\x00b\n"]
    mixed = ["".join(rng.choice("ab \n\né日💥<>PSM") for _ in range(rng.randrange(60))) for _ in range(200)]
    return [*enumerate([*odd, *mixed]), (None, "no\nid"), (3, "again\nthe same id"), (3, "again\nthe same id"), (-5, "below\nzero"), (7000, "é\n" * 700_000)]


@pytest.mark.parametrize("layout", [infill.Layout(), infill.Layout(unit=infill.CHARACTER, rate=70, spm_rate=30, seed=9, prefix="[pre]", suffix="[suf]", middle="[mid]")])
def test_against_characters(spark, texts, layout):
    docs = spark.createDataFrame([(i, t, "n", 1, 2.0, 3, "kept") for i, t in texts], SCHEMA)
    out = infill.transformed(docs, layout)
    assert out.columns == ["doc_id", "text", "h0", "extra", *infill.OUT]
    out = out.withColumn("back", infill.restored(F.col("output"), F.col("form"), layout)).collect()
    assert sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, sha(r.output)) for r in out) == sorted((str(i), *plain(i, t, layout)[:4], sha(plain(i, t, layout)[4])) for i, t in texts)
    assert all(r.back == (r.text or "") and r.extra == "kept" and r.h0 == 3 for r in out)
    assert infill.transformed(docs.limit(0), layout).count() == 0


def test_digests(spark, texts):
    docs = spark.createDataFrame([(i, t, "n", 1, 2.0, 3, "kept") for i, t in texts], SCHEMA)
    got = sorted(str(tuple(r)) for r in infill.digests(docs).collect())
    want = [(i, *plain(i, t, infill.Layout())) for i, t in texts]
    assert got == sorted(str((*w[:5], sha(w[5]), sha(t or ""))) for w, (_, t) in zip(want, texts))


def test_index_converts_both_ways():
    text = "aé日💥b" * 50 + "plain ascii " * 20 + "ü"
    p = next(pieces(pa.array([text])))
    index = infill.Exceptions(p.data)
    starts = np.cumsum([0, *(len(c.encode()) for c in text)])
    assert index.bytes(np.arange(len(text) + 1)).tolist() == starts.tolist()
    assert index.characters(starts).tolist() == list(range(len(text) + 1))


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "ba", "c"), ("a", "ab", "c"), ("xx", "y", "z")])
def test_ambiguous_sentinels_are_refused(marks):
    with pytest.raises(ValueError):
        infill.Layout(*marks)
