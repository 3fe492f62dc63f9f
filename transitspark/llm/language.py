"""Languages of texts and of spans within them.

Per language, trigrams of bytes inside words are counted on training rows. A word's script narrows the
languages it can be of; its score in each is the log-probability of its trigrams. Viterbi's algorithm
labels the words of a text, with a penalty for each change of language, so spans of mixed texts come out.
A text's language is that of most of its letters.

The counts come from a sample of training rows by a hash of the row, about `SAMPLE_ROWS` for each language
(a bound on the classifier's fit; documented and a parameter). Labels, scripts and predictions use whole texts.

Most texts need no walk: if no run of words favours another language than the best one by more than half
the penalty, changing language cannot pay, and the best path stays in one language.

Defined results: null texts and texts without a letter are `und` with score 0, and so is every text if
nothing could be learned; words of a script no training row has count for no language; ties go to the
language first in order; a null id is not held out and not learned from; other columns are carried along by `identified`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitspark.llm.text import Piece, pieces, words

SAMPLE_ROWS, BUCKET_BITS, SWITCH, FLOOR = 3000, 14, 12.0, 8.0
#: Words times languages that are walked side by side, padding included; a longer text is walked alone.
WALK_CELLS = 1 << 20
UNKNOWN = "und"

# What separates words, and the script that a character's first byte tells (0: none).
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[b for b in range(128) if not chr(b).isalpha()]] = True
SCRIPTS = np.zeros(256, np.int8)
for _script, _first, _last in [(1, 0x41, 0x5A), (1, 0x61, 0x7A), (1, 0xC3, 0xCA), (2, 0xCE, 0xCF), (3, 0xD0, 0xD4), (4, 0xD6, 0xD7), (5, 0xD8, 0xDB), (6, 0xE0, 0xE0), (7, 0xE1, 0xE2), (8, 0xE3, 0xE3), (9, 0xE4, 0xE9), (10, 0xEA, 0xED), (11, 0xEE, 0xF4)]:
    SCRIPTS[_first : _last + 1] = _script
N_SCRIPTS = 12


def _folded() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    table[65:91] = table[97:123]
    table[SEPARATORS] = 32
    return table


def trigrams(p: Piece) -> np.ndarray:
    """The bucket of the trigram around each byte; texts end in white space on both sides."""
    letter = _folded()[p.data]
    before, after = np.full(len(letter), 32, np.uint32), np.full(len(letter), 32, np.uint32)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    begin, end = p.at[:-1], p.at[1:]
    some = end > begin
    before[begin[some]], after[end[some] - 1] = 32, 32
    mixed = before * np.uint32(0x9E3779B1) + letter * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS)


def word_scripts(p: Piece, start: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(SCRIPTS[p.data], start) if len(start) else np.zeros(0, np.int8)


class Model:
    """languages, log-probabilities [language, bucket], and whether a language uses a script [script, language]."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        self.languages = languages
        self.log = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1])).astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(0, keepdims=True))
        self.uses = share >= 0.02

    def scores(self, p: Piece, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """[language, word]: log-probabilities; a language that lacks the word's script gets a floor."""
        bucket, script = trigrams(p), word_scripts(p, start)
        out = np.zeros((len(self.languages), len(start)))
        present = np.unique(script)
        sums = np.zeros(len(bucket) + 1)
        for k in range(len(self.languages)):
            if self.uses[present, k].any():
                np.cumsum(self.log[k][bucket], out=sums[1:])
                out[k] = sums[end] - sums[start]
            else:
                out[k] = -np.inf
        for s in present:
            own, uses = script == s, self.uses[s]
            if not uses.any():
                out[:, own] = 0
            elif not uses.all():
                out[np.ix_(~uses, own)] = out[np.ix_(uses, own)].max(0) - FLOOR
        return out

    def paths(self, scores: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The language number of every word."""
        label = np.zeros(scores.shape[1], np.int16)
        some = np.flatnonzero(np.diff(of))
        if not len(some):
            return label
        row = np.repeat(np.arange(len(some)), np.diff(of)[some])
        total = np.add.reduceat(scores, of[some], axis=1)
        best = total.argmax(0)
        label[:] = best[row]
        # the largest gain of any run of words in another language: a running sum over its least value so far
        gain = scores - scores[best[row], np.arange(scores.shape[1])]
        hard = np.zeros(len(some), bool)
        for i, t in enumerate(some):
            run = np.cumsum(gain[:, of[t] : of[t + 1]], axis=1)
            low = np.minimum(0, np.minimum.accumulate(run, axis=1))
            hard[i] = (run - low).max() > SWITCH / 2
        todo = some[hard]
        todo = todo[np.argsort(-np.diff(of)[todo], kind="stable")]
        a = 0
        while a < len(todo):
            # texts side by side are padded to the longest, so what they hold together is bounded
            longest = int(of[todo[a] + 1] - of[todo[a]])
            part = todo[a : a + max(1, min(64, WALK_CELLS // (longest * len(scores))))]
            for t, path in zip(part, self._walk([scores[:, of[t] : of[t + 1]] for t in part])):
                label[of[t] : of[t + 1]] = path
            a += len(part)
        return label

    @staticmethod
    def _walk(texts: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi's paths of several texts side by side, the longest first."""
        k, longest = texts[0].shape
        grid = np.zeros((longest, len(texts), k))
        size = np.array([t.shape[1] for t in texts])
        for i, t in enumerate(texts):
            grid[: t.shape[1], i] = t.T
        back = np.zeros((longest, len(texts)), np.int16)
        moved = np.zeros((longest, len(texts), k), bool)
        value = grid[0]
        for j in range(1, longest):
            top = value.argmax(1)
            best = value[np.arange(len(texts)), top][:, None] - SWITCH
            back[j], moved[j] = top, best > value
            # a text that has ended keeps its values
            value = np.where((j < size)[:, None], np.maximum(value, best) + grid[j], value)
        out = []
        for i, n in enumerate(size):
            path = np.zeros(n, np.int16)
            now = int(value[i].argmax())
            for j in range(n - 1, -1, -1):
                path[j] = now
                if moved[j, i, now]:
                    now = int(back[j, i])
            out.append(path)
        return out


def training_rows(docs: DataFrame, sample_rows: int) -> DataFrame:
    """(lang, text) of a sample of the rows that may be learned from, at most about `sample_rows` a language."""
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter((F.crc32("id") % 3 != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return rows.select("lang", "text").limit(0)
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(scale, scale * sample_rows // n))])
    return rows.filter(F.pmod(F.xxhash64("id"), F.lit(scale)) < share[F.col("lang")]).select("lang", "text")


def learned(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of the languages of `docs`; its size is that of languages * 2**14 numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.asarray(batch.column(0).to_pylist(), object)
            for p in pieces(batch.column(1)):
                bucket, w = trigrams(p), words(p, SEPARATORS, fold=False)
                inside = np.zeros(len(p.data) + 1, np.int32)
                np.add.at(inside, w.start, 1)
                np.add.at(inside, w.end, -1)
                inside = np.cumsum(inside[:-1]) > 0
                owner = np.repeat(np.arange(p.rows), np.diff(p.at))
                script, own = word_scripts(p, w.start), np.repeat(np.arange(p.rows), np.diff(w.of))
                here = langs[p.first : p.first + p.rows]
                for lang in set(here):
                    is_lang = here == lang
                    n = np.bincount(bucket[inside & is_lang[owner]], minlength=1 << BUCKET_BITS)
                    s = np.bincount(script[is_lang[own]], minlength=N_SCRIPTS)
                    key = np.concatenate([np.flatnonzero(n), -1 - np.flatnonzero(s)])
                    yield pa.record_batch([pa.array([lang] * len(key), pa.string()), pa.array(key, pa.int64()), pa.array(np.concatenate([n[n > 0], s[s > 0]]), pa.int64())], ["lang", "key", "n"])

    rows = training_rows(docs, sample_rows).mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    counts, scripts = np.zeros((len(languages), 1 << BUCKET_BITS)), np.zeros((N_SCRIPTS, len(languages)))
    for lang, key, n in rows:
        k = languages.index(lang)
        if key >= 0:
            counts[k, key] = n
        else:
            scripts[-1 - key, k] = n
    return Model(languages, counts, scripts)


def label_piece(model: Model | None, p: Piece) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """Of each text: its language, the share of its letters in it, and its spans (language, first and end byte)."""
    w = words(p, SEPARATORS, fold=False)
    if model is None:
        return [(UNKNOWN, 0.0, [])] * p.rows
    label = model.paths(model.scores(p, w.start, w.end), w.of)
    size = w.end - w.start
    out = []
    for i in range(p.rows):
        a, b = w.of[i], w.of[i + 1]
        ascii_letter = a < b and (p.data[w.start[a:b]] < 128).any()
        if a == b or not (ascii_letter or any(c.isalpha() for c in p.text(i).decode())):
            out.append((UNKNOWN, 0.0, []))
            continue
        weight = np.bincount(label[a:b], weights=size[a:b], minlength=len(model.languages))
        best = int(weight.argmax())
        edge = np.flatnonzero(np.diff(label[a:b])) + a + 1
        heads, ends = np.append(a, edge), np.append(edge, b) - 1
        spans = [(model.languages[label[h]], int(w.start[h] - p.at[i]), int(w.end[e] - p.at[i])) for h, e in zip(heads, ends)]
        out.append((model.languages[best], float(weight[best] / weight.sum()), spans))
    return out


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """(row: all columns of `docs`, lang_pred, score, spans: array of lang, start and end byte)."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    span = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    rows = docs.select(F.struct("*").alias("row"))
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0).field("text").cast(pa.string())
            out = [x for p in pieces(text) for x in label_piece(spread.value, p)]
            spans = [[dict(zip(("lang", "start", "end"), s)) for s in x[2]] for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array(spans, kind)], ["row", "lang_pred", "score", "spans"])

    return rows.mapInArrow(label, T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", span)]))


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 3 == 1, F.lit(False))
    return identified(slim, learned(docs)).select(F.col("row.doc_id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score")
