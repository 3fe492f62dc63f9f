"""The ten operators against brute force on small rows: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitspark.llm import ann, bpe, decontaminate, language, licenses, lines, minhash, pii, sharding, substrings
from transitspark.llm.queries import vocabulary
from transitspark.session import rewritten, settled

SCHEMA = "doc_id long, text string, lang string, rid string, row int, n_words int, node string"
sha = lambda t: hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


def words(rng, n, of=400):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = words(rng, 150)
    near = base[:70] + ["other"] + base[71:]
    shared = words(rng, 60)
    long = words(rng, 20_000, 50_000)
    return [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two"), (6, " ".join(base)), (7, " ".join(base)), (8, " ".join(near)),
        (9, " ".join(words(rng, 30) + shared + words(rng, 30))), (10, "\n".join([" ".join(shared), "x", "x", "x"])), (11, "a " * 200), (12, " ".join(long)),
        (13, "A" * 50_000), (None, "no id here"), (14, "a\nb\nc"), (15, "z\na\nb\nc"), (14, "a\nb\nc"), (16, "É\x85ü  <|endoftext|> 日本語 💥 it's 'S x"),
        (17, "mail a@b.co, 10.0.0.1 and 256.1.1.1, 4111 1111 1111 1111, +49 (30) 123-4567, a@b.c_d@e.f"), (18, "4111-1111-1111-1112 1.2.3.4.5.6.7.8 +1 2"),
        (19, "Licensed under the MIT License. UNDER THE MIT-license"), (20, "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None, "x", 1, 2, "n") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return docs_of(spark, texts)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_pii(docs, none, texts):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def ok(kind, hit):
        d = re.sub("[^0-9]", "", hit)
        odd = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        return [True, all(int(p) <= 255 for p in hit.split(".")) if kind == 1 else 0, 12 <= len(d) <= 19 and odd % 10 == 0, 9 <= len(d) <= 15][kind]

    want = Counter()
    for i, t in texts:
        spans = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, t or "") if ok(k, m[0]))
        want[i, *(sum(s[1] == k for s in spans) for k in range(4)), sha(",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in spans))] += 1
    assert rows(pii.span_digests(docs), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    assert pii.span_digests(none).count() == 0


def test_substrings(spark, docs, none, texts):
    split = [(i, (t or "").encode().split()) for i, t in texts]
    places = Counter(tuple(w[j : j + 35]) for _, w in split for j in range(len(w) - 34))
    want = Counter()
    for i, w in split:
        gone = {k for j in range(len(w) - 34) if places[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        want[i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    assert rows(substrings.without_repeats(spark, docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substrings.without_repeats(spark, none).count() == 0


def test_bpe(docs, none, texts):
    from tokenizers import Tokenizer

    spec = vocabulary()
    tokenizer = Tokenizer.from_str(spec)
    encoded = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in texts}
    got = rows(bpe.digests(docs, spec), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == Counter((i, len(encoded[i]), sha(np.array(encoded[i], "<u4").tobytes()), sha(t or "")) for i, t in texts)
    back = bpe.decode(bpe.encode(docs, spec), spec)
    assert rows(back, "doc_id", "decoded") == Counter((i, t or "") for i, t in texts)
    assert bpe.digests(none, spec).count() == 0


def test_bpe_words_of_many_blocks(spark):
    from tokenizers import Tokenizer

    spec, rng = vocabulary(), random.Random(9)
    tokenizer, splitter = Tokenizer.from_str(spec), bpe.Splitter(spec)
    bits = ["a", "Be", "é", " ", "  ", "\n", "\t", "\xa0", "'s", "'LL", "7", "½", "?!", "<|endoftext|>", "ж", "漢字", "💥", "\u2003", "e\u0301", "\x85"]
    given = ["".join(rng.choices(bits[: 14 if i % 2 else None], k=rng.randrange(40))) for i in range(120)]
    for text in given:
        assert [i for e in splitter.encoded(splitter.words(text)) for i in np.frombuffer(e, "<u4")] == tokenizer.encode(text, add_special_tokens=False).ids
    many = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(many, spec, size=40).collect()}
    assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(given)}
    coded = bpe.word_ids(bpe.block_words(many.select("text", "doc_id"), spec, 40), spec).collect()
    entries = Counter(i for r in coded for i in bpe._unparcel(r["lengths"], r["ids"]))
    assert len({r["block"] for r in coded}) > 20 and set(entries) == set(splitter.encoded(sorted({w for t in given for w in splitter.words(t)})))
    places = np.array([0, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**31])
    assert bpe.unpacked(bpe.packed(places)).tolist() == places.tolist() and bpe.unpacked(b"").size == 0


def test_licenses(docs, none):
    got = {r["doc_id"]: r for r in licenses.licence_labels(docs).collect()}
    assert (got[19]["n_base"], got[19]["first_word"], got[19]["last_word"], got[19]["base_labels"]) == (2, 1, 5, "mit")
    assert got[20]["labels"] == "apache-2" and got[20]["score"] == 1.0
    assert (got[1]["n_words"], got[1]["first_word"], got[1]["labels"], got[6]["score"]) == (0, None, "", 0.0)
    assert licenses.licence_labels(none).count() == 0


def test_base_licences_equal_a_scan_of_all_words(spark):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    rng, bank = random.Random(8), sorted({w for p in phrases for w in p.split()}) + ["É", "İx", "2"]
    marks = [" ", "-", "\n", "\x7f", "_ ", "\x00", ", "]
    given = []
    for i in range(300):
        parts = rng.choices([*bank, *phrases, *phrases], k=rng.randrange(30))
        given.append((i, "".join(rng.choice([p, p.upper(), p.replace(" ", "/")]) + rng.choice(marks) for p in parts)))
    want = Counter()
    for i, t in given:
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = sorted((j, label) for p, label in phrases.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
        want[i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))] += 1
    got = licenses.licence_labels(docs_of(spark, given))
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got.collect())


def test_lines(docs, none, texts):
    kept = rows(lines.without_repeated_lines(docs), "doc_id", "text")
    assert kept[1, None] == 1 and kept[15, "z"] == 1 and kept[14, "a\nb\nc"] == 2 and kept[7, ""] == 1
    assert kept[10, texts[9][1].rsplit("\n", 2)[0]] == 1  # of three equal lines the last two repeat the first two
    assert lines.without_repeated_lines(docs).columns == docs.columns
    assert lines.line_digests(none).count() == 0


def test_runs_of_any_length_count_by_their_words(spark, docs):
    rng, least = random.Random(2), lines.WORDS
    bank = ["a", "b", "c d", "e f", "p q r", "the planted line of all", "", " "]
    given = [(i, "\n".join(rng.choices(bank, k=rng.randrange(1, 7)) + [f"own {i} {i} {i}"] + rng.choices(bank, k=rng.randrange(7)))) for i in range(60)]
    given += [(60, "own 9 9 9\n\nthe planted line of all"), (61, "x"), (62, "x"), (63, None), (64, ""), (None, "p q r")]
    first, want = {}, Counter()
    order = sorted(given, key=lambda r: (r[0] is not None, r[0]))
    spans = lambda w: [(a, b) for a in range(len(w)) for b in range(a + 1, len(w) + 1) if sum(len(x.split()) for _, x in w[a:b]) >= least]
    for i, t in order:
        w = [(k, x) for k, x in enumerate(t.split("\n") if t is not None else []) if x.strip()]
        gone = set()
        for a, b in spans(w):
            if first.setdefault(tuple(x for _, x in w[a:b]), (i, a)) != (i, a):
                gone |= set(range(w[a][0], w[b - 1][0] + 1))
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) if t is not None else None
        want[i, left] += not ((t or "").strip() and not (left or "").strip())
    assert rows(lines.without_repeated_runs(spark.createDataFrame(given, "doc_id long, text string")), "doc_id", "text") == +want
    assert lines.without_repeated_runs(docs).columns == docs.columns


def test_runs_are_doubled_to_their_end_and_merged(spark):
    same = [f"line {i} of many" for i in range(9)]
    given = [(1, "\n".join(["a", *same, "b"])), (2, "\n".join(["c", *same, "d e f", *same[:2]])), (2, "\n".join(["c", *same, "d e f", *same[:2]]))]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    texts = lines.keyed(docs).select("rid", "id", F.posexplode(lines.lines_of("row.text")).alias("at", "s"))
    single = texts.select("rid", "id", "at", F.col("at").alias("line"), F.col("at").alias("last"), F.xxhash64("s").alias("name"), F.lit(3).alias("total"))
    found = {n: t.select("id", "line", "last", "later").collect() for n, t in lines.repeated_runs(single, 3).items()}
    assert {n: len(t) for n, t in found.items()} == {1: 22, 2: 17, 3: 14, 4: 12, 8: 4, 16: 0}  # no length but 16 is without a pair
    assert sorted(map(tuple, found[8])) == [(1, 1, 8, False), (1, 2, 9, False), (2, 1, 8, True), (2, 2, 9, True)]
    spans = {tuple(sorted((s["line"], s["last"]) for s in r["spans"])) for r in lines.later_runs(docs).collect()}
    assert spans == {((1, 9), (11, 12))}


def test_what_a_step_writes_on_its_way_goes(spark, tmp_path):
    made = {}

    def step():
        made["inner"] = rewritten(spark.range(5), "inner")
        return made["inner"].filter("id > 2")

    out = settled(spark, step, "outer")
    assert out.count() == 2 and not os.path.exists(made["inner"].inputFiles()[0].removeprefix("file://"))


def test_line_names_by_doubling(spark):
    df = spark.sql("SELECT transform(split('a b a b a c', ' '), x -> xxhash64(x)) AS n")
    three = df.select(lines.suffix_names(df["n"], 3)).first()[0]
    assert len(three) == 4 and three[0] == three[2] and len(set(three)) == 3 and len(df.select(lines.suffix_names(df["n"], 7)).first()[0]) == 0


def test_sharding(docs, none, texts):
    got = sharding.shuffled(docs, 5, block_rows=3).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(texts)
    of = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(5)}
    assert all(v == list(range(len(v))) for v in of.values()) and {len(v) for v in of.values()} == {4, 5}
    assert sharding.shard_digests(none).count() == 0


def test_shard_digests_keep_their_law(docs, texts):
    got = sharding.shard_digests(docs).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in texts)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    slots = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(40)}
    assert all(v == list(range(len(v))) for v in slots.values()) and {len(v) for v in slots.values()} <= {0, 1}


def test_small_tables_are_dealt_by_a_drawn_matrix(spark, monkeypatch):
    drawn, draw = [], sharding.communication_matrix
    monkeypatch.setattr(sharding, "communication_matrix", lambda *a: drawn.append(draw(*a)) or drawn[-1])
    got = sharding.shuffled(spark.range(3000).toDF("doc_id"), 5).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000)) and len(drawn[0]) > 5
    assert len({tuple(n / sum(r) for n in r) for r in drawn[0]}) > 5
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(5) for k in range(600)]


def test_communication_matrix_is_exact_and_fair():
    total = Counter()
    for seed in range(300):
        m = sharding.communication_matrix([6, 1, 3], [4, 3, 3], seed)
        assert [sum(r) for r in m] == [6, 1, 3] and [sum(c) for c in zip(*m)] == [4, 3, 3]
        total[m[0][0]] += 1
    assert abs(sum(k * n for k, n in total.items()) / 300 - 2.4) < 0.2


def test_minhash(spark, docs, none, texts):
    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        return frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    least = {g: min((texts[i][0] for i in range(len(texts)) if group[i] == g and texts[i][0] is not None), default=None) for g in group}
    want = Counter((i, len(sets[k]), least[group[k]], i is not None and i == least[group[k]]) for k, (i, _) in enumerate(texts))
    assert rows(minhash.near_duplicates(spark, docs), "doc_id", "n_shingles", "component_id", "kept") == want
    kept = minhash.one_of_each(spark, docs)
    assert kept.columns == docs.columns and rows(kept, "doc_id")[7,] == 0 and rows(kept, "doc_id")[1,] == 1
    assert minhash.near_duplicates(spark, none).count() == 0


def test_bands_follow_the_threshold(spark, docs):
    for percent in (70, 80, 85, 90):
        bands, bins = minhash.banding(percent)
        assert (1 - (percent / 100) ** bins) ** bands <= minhash.MISS
    assert minhash.banding(85) == (48, 8)
    assert {len(r["bands"]) for r in minhash.sketches(docs, 5, 80).collect()} == {0, 51}


def test_ann(spark):
    rng = np.random.default_rng(1)
    v = [(i, rng.normal(size=8).tolist()) for i in range(120)] + [(i, [1.0] + [0.0] * 7) for i in range(200, 230)]
    bad = [(300, None), (350, [0.0] * 8), (400, [float("nan")] + [1.0] * 7), (450, [None] + [1.0] * 7), (500, [float("inf")] * 8), (550, []), (None, [1.0] * 8), v[0]]
    got = {}
    for r in ann.nearest(spark.createDataFrame([*v, *bad], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in v}
    for q in (0, 50, 100, 200):
        want = sorted((round(-float(unit[q] @ u), 12), i) for i, u in unit.items() if i != q)[:5]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]
    assert set(got) == {0, 50, 100, 200}


def test_ann_ties_of_many_nodes_go_to_the_least_ids(spark):
    v = [(i, [2.0 ** (i - 1000), 0.0]) for i in range(1001, 1041)] + [(0, [1.0, 0.0]), (1, [0.0, 1.0])]
    got = sorted((r["rank"], r["vec_id"]) for r in ann.nearest(spark.createDataFrame(v, "vec_id long, embedding array<double>")).collect() if r["query_id"] == 0)
    assert got == [(k, 1000 + k) for k in range(1, 6)]


def test_ann_graph_search_finds_the_nearest_of_many_shards_and_blocks(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 24))
    v[1000:2000] = v[:1000] + rng.normal(scale=0.2, size=(1000, 24))  # close pairs, mostly in different shards
    got = {}
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    for r in ann.nearest(frame, every=10, shard=(700, 700), block=(100, 100)).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert ann.parts(3000, (700, 700)) == 5 and ann.parts(300, (100, 100)) == 3 and 700 > ann.ASK_BEAM
    unit, met = v / np.linalg.norm(v, axis=1, keepdims=True), 0
    assert set(got) == set(range(0, 3000, 10))
    for q, answers in got.items():
        score = unit @ unit[q]
        score[q] = -2
        assert sorted(answers) == [1, 2, 3, 4, 5] and all(abs(score[i] - s) < 1e-12 for i, s in answers.values())
        met += len({i for i, _ in answers.values()} & set(np.argsort(-score)[:5].tolist()))
    assert met / (5 * len(got)) >= 0.95


@pytest.mark.parametrize("dims", [16, 64])
def test_ann_graph_is_pruned_and_searched_by_its_edges(dims):
    rng = np.random.default_rng(dims)
    unit = ann._unit(rng.normal(size=(2500, dims)))
    graph, queries = ann.built(unit, 7), ann._unit(rng.normal(size=(200, dims)))
    assert graph.edges.shape == (2500, ann.DEGREE) and (graph.edges != np.arange(2500)[:, None]).all()
    assert all(len(set(e[e >= 0])) == (e >= 0).sum() for e in graph.edges)
    want = np.argsort(-(queries @ unit.T), 1)[:, :5]
    recall = lambda g: np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(g.search(queries, ann.ASK_BEAM)[0], want)])
    assert recall(graph) >= 0.95
    assert ann.ask_beam(4096) == ann.ASK_BEAM and ann.ask_beam(16_384) == 256
    cut = ann.Graph(unit, np.full_like(graph.edges, -1))  # without edges only the entries are found
    assert recall(cut) < 0.2


def test_ann_pruning_leaves_out_what_a_kept_neighbour_covers():
    at = lambda degrees: [np.cos(np.radians(degrees)), np.sin(np.radians(degrees))]
    graph = ann.Graph(ann._unit(np.array([at(0), at(10), at(20), at(-15), at(170)])), np.full((5, ann.DEGREE), -1))
    kept = graph.prune(np.array([0]), np.array([[1, 2, 3, 4, 0, -1, 1]]), 1.0)[0]
    assert kept[kept >= 0].tolist() == [1, 3]


def test_decontamination(spark, docs):
    rng = random.Random(9)
    item = words(rng, 40, 10_000)
    edited = item[:10] + ["new"] + item[10:25] + item[26:]
    spoilt = [w if k % 3 else "no" for k, w in enumerate(item)]
    pad = lambda: words(rng, 50, 20_000)
    more = docs_of(spark, [(101, " ".join(pad() + item + pad())), (102, " ".join(pad() + edited + pad())), (103, " ".join(spoilt)), (104, " ".join(item[:12]))])
    bench = spark.createDataFrame([(1, " ".join(item).upper()), (2, None), (3, ""), (4, "two tokens")], "item_id long, text string")
    found = decontaminate.leaks(docs.unionByName(more), bench)
    assert rows(found, "doc_id", "item_id", "first_word", "distance") == Counter([(101, 1, 50, 0), (102, 1, 50, 2)])
    assert rows(decontaminate.decontaminated(more, bench), "doc_id") == Counter([(103,), (104,)])
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("n", [10, 15, 40, 80])
def test_bit_samples_reach_their_recall_at_the_largest_bound(n):
    rng = random.Random(n)
    letter, e = lambda: rng.getrandbits(62), decontaminate.bound(n)
    met = tried = 0
    for _ in range(150):
        item = [letter() for _ in range(n)]
        edited = list(item)
        for _ in range(e):
            at = rng.randrange(len(edited))
            edited[at : at + rng.randrange(2)] = [letter()] * rng.randrange(2)
        text = np.array([letter() for _ in range(e)] + edited + [letter() for _ in range(n + 3 * e)], np.uint64)
        windows = text[np.arange(2 * e + 1)[:, None] + np.arange(n + e)]
        near = decontaminate.least_distance(np.array(item, np.uint64), windows)[0] <= e
        agree = (decontaminate.embedded(windows[:, :n]) == decontaminate.embedded(np.array([item], np.uint64))[0]).any(1)
        tried, met = tried + near.any(), met + (near & agree).any()
    assert tried == 150 and met / tried >= 0.99


@pytest.mark.parametrize("n", [20, 30, 40, 71, 80, 100])
def test_bit_samples_keep_edited_windows_and_refuse_unrelated_ones(n):
    rng = np.random.default_rng(n)
    letters = lambda *shape: rng.integers(1, 1 << 62, shape, dtype=np.uint64)
    item, other, edited = letters(1, n), letters(200, n), []
    of_item = decontaminate.embedded(item)[0]
    for _ in range(150):
        row = item[0].copy()
        row[rng.choice(n, decontaminate.bound(n), replace=False)] = letters(decontaminate.bound(n))
        edited.append(row)
    assert decontaminate.agreeing(decontaminate.embedded(np.array(edited)), of_item).mean() >= 0.99
    assert decontaminate.agreeing(decontaminate.embedded(other), of_item).mean() < 0.01


def test_language(spark, docs, none):
    rng = random.Random(3)
    syllables = {"aa": ["ka", "ro", "mi"], "bb": ["sch", "üng", "tz"], "cc": ["жи", "ла", "по"]}
    make = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))
    train = [(i, make(lang, 60), lang) for i in range(300) for lang in [rng.choice(list(syllables))]]
    frame = spark.createDataFrame(train, "doc_id long, text string, lang string")
    held = [r for r in language.predictions(frame).collect() if r["held_out"]]
    assert held and all(r["lang_pred"] == dict((i, lang) for i, _, lang in train)[r["doc_id"]] for r in held)
    model = language.learned(frame)
    mixed = spark.createDataFrame([(1, make("aa", 40) + " " + make("bb", 20)), (2, None), (3, "12 …")], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r for r in language.identified(mixed, model).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["aa", "bb"] and got[1]["lang_pred"] == "aa"
    assert (got[2]["lang_pred"], got[3]["lang_pred"], got[2]["score"]) == ("und", "und", 0.0)
    assert language.predictions(none).count() == 0 and {r["lang_pred"] for r in language.predictions(docs).collect()} == {"und"}


def test_language_paths_are_the_best_of_all_labellings():
    rng, model = np.random.default_rng(6), object.__new__(language.Model)
    sizes = [0, 1, 7, 2, 0, 6, 7, 7, 5, 7] * 12
    of = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(scale=language.SWITCH / 2, size=(3, of[-1])) + np.repeat(rng.normal(scale=language.SWITCH / 3, size=(3, len(sizes))), sizes, axis=1)
    label, switched = model.paths(scores, of), 0
    worth = lambda path, own: sum(own[k, j] for j, k in enumerate(path)) - language.SWITCH * sum(a != b for a, b in zip(path, path[1:]))
    for a, b in zip(of, of[1:]):
        if b > a:
            own, path = scores[:, a:b], label[a:b].tolist()
            best = max(worth(p, own) for p in itertools.product(range(3), repeat=int(b - a)))
            assert abs(worth(path, own) - best) < 1e-9
            switched += len(set(path)) > 1
    assert 10 < switched < sum(n > 0 for n in sizes)
