"""Words that simple polynomial hashes cannot tell apart, through the operators that compare words by hash; Viterbi by brute force."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pytest

from transitspark.llm import decontaminate, language, minhash, substrings, text


def thue_morse(bits: int) -> tuple[str, str]:
    s = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module", params=[3, 4, 11, 12])
def twins(request):
    return thue_morse(request.param)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_substrings(spark, twins):
    tail = " ".join(f"w{i}" for i in range(34))
    got = {r["doc_id"]: r for r in substrings.without_repeats(spark, frame(spark, [f"{t} {tail}" for t in twins])).collect()}
    for i, t in enumerate(twins):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (35, 0, hashlib.sha256(f"{t} {tail}".encode()).hexdigest())


def test_minhash(spark, twins):
    got = minhash.near_duplicates(spark, frame(spark, [f"{t} x y" for t in twins])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(0, 0), (1, 1)]


def test_decontamination(spark, twins):
    a, b = twins
    rest = [f"w{i}" for i in range(9)]
    item = " ".join([a, *rest])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [item, " ".join([b, *rest])]
    got = {r["doc_id"]: r["distance"] for r in decontaminate.leaks(frame(spark, texts), bench).collect()}
    assert got == {0: 0, 1: 1}  # one word of ten differs


def test_word_hashes_depend_on_every_byte_and_the_length():
    words = ["", "a", "A", "aa", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "a" * 64, "a" * 65, "a" * 63 + "b", "b" + "a" * 64, *("x" * k + "y" + "x" * (20 - k) for k in range(20))]
    p = next(text.pieces(pa.array([" ".join(words)])))
    plain, folded = (text.words(p, text.WHITE, fold=f).hash for f in (False, True))
    assert len(set(plain.tolist())) == len(words) - 1  # the empty string is no word
    assert len(set(folded.tolist())) == len(words) - 2 and folded[0] == folded[1]
    moved = next(text.pieces(pa.array(["é " + words[9]])))
    assert text.words(moved, text.WHITE, fold=False).hash[1] == plain[words.index(words[9]) - 1]


def score_of(path, scores):
    return sum(scores[k, j] for j, k in enumerate(path)) - language.SWITCH * sum(a != b for a, b in zip(path, path[1:]))


def test_viterbi_against_every_labelling():
    rng = np.random.default_rng(1)
    model = language.Model(["a", "b", "c"], np.ones((3, 1 << language.BUCKET_BITS)), np.ones((language.N_SCRIPTS, 3)))
    sizes = [0, 1, 2, 5, 7, 7, 3, 0]
    for scale in (2, 10, 40):
        scores = rng.standard_normal((3, sum(sizes))) * scale
        of = np.concatenate([[0], np.cumsum(sizes)])
        label = model.paths(scores, of)
        for a, b in zip(of[:-1], of[1:]):
            best = max((score_of(p, scores[:, a:b]) for p in itertools.product(range(3), repeat=int(b - a))), default=0)
            assert score_of(label[a:b].tolist(), scores[:, a:b]) == pytest.approx(best)


def test_texts_walked_side_by_side_stay_bounded(monkeypatch):
    """64 texts beside one long one: no padding to the longest, and the same labels."""
    rng = np.random.default_rng(2)
    model = language.Model(["a", "b"], np.ones((2, 1 << language.BUCKET_BITS)), np.ones((language.N_SCRIPTS, 2)))
    sizes = [4000, *([40] * 64)]
    scores = rng.standard_normal((2, sum(sizes))) * 30
    of = np.concatenate([[0], np.cumsum(sizes)])
    want = model.paths(scores, of)
    seen, walk = [], language.Model._walk
    monkeypatch.setattr(language, "WALK_CELLS", 8000)
    monkeypatch.setattr(language.Model, "_walk", staticmethod(lambda texts: seen.append(max(t.size for t in texts) * len(texts)) or walk(texts)))
    assert (model.paths(scores, of) == want).all() and len(seen) >= 2 and max(seen) <= 8000
