"""Licence texts by diagonal voting.

Every rolling k-gram of words is hashed where it stands; those that occur in a template leave the scan as
hits (row, position, words) and are joined with the template positions of the same words. A hit votes for
the diagonal position - template position; neighbouring diagonals of a template merge, and a span counts
if it covers enough of the template's k-grams. The hits carry their words, so the join compares words and
not only hashes. The templates are constants, so the joined side is small whatever the input.

Defined results: null and empty texts have no words, no places and no labels; every row gives one row,
repeated or not; ids may be null; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitspark.llm.text import NOT_ALNUM, Piece, Words, pieces, words
from transitspark.session import local_rows, rewritten

K = 4
NEAR = 6  # diagonals this close belong to one span: so many words may have been put in or left out
COVER = 0.6  # the least share of a template's k-grams

# The base phrases and the templates, with their labels.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
]


def _words_of(texts: list[str]) -> tuple[Piece, Words]:
    p = next(pieces(pa.array(texts), 1 << 30))
    return p, words(p, NOT_ALNUM, fold=True)


def _span_hashes(texts: list[str], size: int | None) -> np.ndarray:
    """Hashes of all spans of `size` words, or of each whole text."""
    p, w = _words_of(texts)
    if size is None:
        return w.spans().of(w.of[:-1], w.of[1:])
    first = np.concatenate([np.arange(a, b - size + 1) for a, b in zip(w.of[:-1], w.of[1:])])
    return w.spans().of(first, first + size)


def _span_text(p: Piece, w: Words, first: int, size: int) -> str:
    return " ".join(p.data[w.start[j] : w.end[j]].tobytes().lower().decode() for j in range(first, first + size))


_SCAN = "doc_id long, rid long, n_words long, base array<struct<label:string,word:int>>, hits array<struct<word:int,gram:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = np.unique(_span_hashes([t for _, t in TEMPLATES], K))
    phrases = [(label, text, len(text.split()), h) for (label, text), h in zip(PHRASES.items(), _span_hashes(list(PHRASES.values()), None))]
    shape = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int32())]))), ("hits", pa.list_(pa.struct([("word", pa.int32()), ("gram", pa.string())])))])
    for batch in batches:
        for p in pieces(batch.column(2)):
            w = words(p, NOT_ALNUM, fold=True)
            spans = w.spans()
            base: list[list] = [[] for _ in range(p.rows)]
            hits: list[list] = [[] for _ in range(p.rows)]

            def inside(size: int, among: np.ndarray) -> Iterator[tuple[int, int]]:
                first = np.arange(max(0, len(w.hash) - size + 1))
                first = first[np.isin(spans.of(first, first + size), among)]
                row = w.text_of(first)
                for a, r in zip(first, row):
                    if a + size <= w.of[r + 1]:
                        yield int(a), int(r)

            for label, text, size, h in phrases:
                for a, r in inside(size, np.array([h])):
                    if _span_text(p, w, a, size) == text:
                        base[r].append({"label": label, "word": a - int(w.of[r])})
            for a, r in inside(K, grams):
                hits[r].append({"word": a - int(w.of[r]), "gram": _span_text(p, w, a, K)})
            rows = slice(p.first, p.first + p.rows)
            yield pa.record_batch([batch.column(0)[rows], batch.column(1)[rows], pa.array(np.diff(w.of), pa.int64()), pa.array(base, shape.field("base").type), pa.array(hits, shape.field("hits").type)], schema=shape)


def template_grams(spark: SparkSession) -> DataFrame:
    """(gram, template, label, at, grams): where each k-gram stands in the templates."""
    rows = []
    for number, (label, text) in enumerate(TEMPLATES):
        w = text.split()
        rows += [(" ".join(w[i : i + K]), number, label, i, len(w) - K + 1) for i in range(len(w) - K + 1)]
    shape = T.StructType([T.StructField("gram", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("grams", T.IntegerType())])
    return local_rows(spark, shape, rows)


def spans(scanned: DataFrame) -> DataFrame:
    """(rid, label, first_word, last_word, cover): verified spans of templates."""
    hits = scanned.select("rid", F.explode("hits").alias("h")).select("rid", "h.word", "h.gram")
    votes = hits.join(template_grams(scanned.sparkSession), "gram").withColumn("diagonal", F.col("word") - F.col("at"))
    key = ["rid", "template", "label", "grams"]
    lines = votes.groupBy(*key, "diagonal").agg(F.min("word").alias("first_word"), F.max("word").alias("last_word"), F.collect_set("at").alias("places"))
    order = Window.partitionBy(*key).orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True))
    merged = lines.withColumn("run", F.sum(fresh.cast("int")).over(order)).groupBy(*key, "run").agg(F.min("first_word").alias("first_word"), (F.max("last_word") + K).alias("last_word"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("seen"))
    return merged.withColumn("cover", F.col("seen") / F.col("grams")).filter(F.col("cover") >= COVER).select("rid", "label", "first_word", "last_word", "cover")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, n_words, base, hits) of every row, written to the scratch folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col("text").cast("string").alias("text"))
    return rewritten(rows.mapInArrow(_scan, _SCAN), "licences")


def licence_labels(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    scanned = scan(docs)
    found = spans(scanned).groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    base = F.array_sort(F.array_distinct(F.col("base.label")))
    everything = F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>"))))
    return scanned.join(found, "rid", "left").select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").cast("long").alias("first_word"),
        F.array_max("base.word").cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(everything, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )
