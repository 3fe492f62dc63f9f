"""The registered queries of the subpackage and the pipeline on the smallest tables."""

import random
import shutil
import sys

from compare import compare, duck

import corpus_pipeline
from transitspark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_lines_match_their_sql(spark):
    verdict, detail, _ = compare(spark, duck(SF), "op5_lines", QUERIES["op5_lines"], SQL["op5_lines"], SF)
    assert verdict == "ok", detail


def test_stages_keep_columns_and_clean_documents(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
        sizes.append(out.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > docs.count() / 2
    assert sys.modules["corpus_pipeline"].ORACLE_SQL is None


def test_run_keeps_one_of_each_planted_group(spark, tmp_path):
    rng = random.Random(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = sorted((r for r in docs.filter("length(text) > 3000").collect()), key=lambda r: r["doc_id"])[:4]
    rows, groups = [], []
    for g, r in enumerate(clean):
        words = r["text"].split()
        rng.shuffle(words)  # lines of this group only
        lines = [" ".join(words[a : a + 20]) for a in range(0, 400, 20)]
        exact, near = list(lines), list(lines)
        near[7] = near[7] + f" edited{g} here"
        ids = [900_000 + 10 * g + k for k in range(3)]
        rows += [r.asDict() | {"doc_id": i, "text": "\n".join(t), "n_chars": len("\n".join(t))} for i, t in zip(ids, (lines, exact, near))]
        groups.append(set(ids))
    sf = tmp_path / "sf"
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(str(sf / "documents.parquet"))
    shutil.copy(f"{SF}/benchmark.parquet", sf)
    out = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(sf)).collect()}
    assert [sorted(ids & set(out)) for ids in groups] == [[min(ids)] for ids in groups]
    assert min(out.values()) > 0


def test_line_dedup_cuts_every_line_seen_before(spark):
    rng = random.Random(9)
    unspaced = "日本語の行には空白がない。" * 10
    bank = ["Yes", "No.", "—", "two words", "of three words", unspaced, "x" * 300, "a line of many more words than three"]
    own = lambda i, k: " ".join(f"own{i}x{k}x{j}" for j in range(9))
    given = {i: rng.sample(bank, 4) + [own(i, 0), *rng.choices(bank, k=3), own(i, 1)] for i in range(40)}
    given |= {100: ["Yes"], 101: [unspaced, "Yes"], 102: ["new"], 103: [own(103, 0), "new"]}
    seen, want = set(), {}
    for i, t in given.items():
        left = [x for k, x in enumerate(t) if x not in seen and x not in t[:k]]
        seen |= set(t)
        if left:
            want[i] = "\n".join(left)
    # lines without a word go with the run they stand in, and with nothing else
    given |= {200: [own(200, 0), "Yes", "", "first", "", "second"], 201: [own(201, 0), "first", "", "second", "", own(201, 1)], 202: None}
    want |= {200: "\n".join([own(200, 0), "", "first", "", "second"]), 201: "\n".join([own(201, 0), "", own(201, 1)]), 202: None}
    docs = spark.createDataFrame([(i, t and "\n".join(t)) for i, t in given.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()} == want
