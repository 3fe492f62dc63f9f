"""Fill-in-the-middle: texts cut in three, their parts reordered behind sentinels, and put back together.

Texts stay UTF-8 bytes. A sparse exception index per piece of texts records where its multibyte characters
stand and how many bytes they add up to; a cut given in bytes becomes code points, or the other way
round, by one `searchsorted` in that list and a subtraction. Stretches of ASCII have no entries, so their
conversion is plain arithmetic, and no text is ever decoded.

`transformed` cuts at units: lines (with their line feed) or code points. Which cuts and which form a document gets
follows from the hash of a seed and its id alone, so it does not depend on order or partitioning. `restored`
is a Spark expression: the sentinels occur once each, so the parts stand between them.

Defined results: a null text is an empty one; empty texts, texts that hold a sentinel and those beyond the rate
are left plain, with null lengths. A null id hashes like an empty one. Rows that repeat give equal rows. `transformed`
carries all columns of its input along, except those it makes (OUT), which it replaces. A task holds one batch
and one piece of about a megabyte, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitspark.llm.text import Piece, pieces

LINE, CHARACTER = "line", "character"
PLAIN, PSM, SPM = "plain", "psm", "spm"
OUT = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Layout:
    """Sentinels and shares. Rates are in percent of the documents."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 100
    spm_rate: int = 50
    seed: int = 7
    unit: str = LINE

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        # a mark that begins inside another could be met where none was set
        tails = [m[i:] for m in marks for i in range(1, len(m))]
        if any(not m for m in marks) or len(set(marks)) < 3 or any(m.startswith(t) or m in t for m in marks for t in tails):
            raise ValueError("sentinels must be three different strings of which none begins inside another")
        if any(a != b and a.startswith(b) for a in marks for b in marks):
            raise ValueError("no sentinel may begin with another")


class Exceptions:
    """The multibyte characters of a byte sequence: where they begin, and the bytes in excess of one up to each."""

    def __init__(self, data: np.ndarray) -> None:
        self.byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.byte]
        self.excess = np.zeros(len(self.byte) + 1, np.int64)
        np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0), out=self.excess[1:])
        self.character = self.byte - self.excess[:-1]

    def characters(self, byte: np.ndarray) -> np.ndarray:
        """How many characters begin before each byte position (the first byte of a character, or the end)."""
        return byte - self.excess[np.searchsorted(self.byte, byte)]

    def bytes(self, character: np.ndarray) -> np.ndarray:
        """The byte position of each character number."""
        return character + self.excess[np.searchsorted(self.character, character)]


def line_ends(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions after each line of the piece, and how many lines each text has."""
    feeds = np.flatnonzero(p.data == 10) + 1
    last = p.at[1:][(p.at[1:] > p.at[:-1])]
    ends = np.union1d(feeds, last)  # a text may end without a line feed
    return ends, np.searchsorted(ends, p.at[1:], "right") - np.searchsorted(ends, p.at[:-1], "right")


def cuts(p: Piece, unit: str, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the byte and code point positions (text, 4) of its start, two cuts and end.

    `draw`: two numbers for each text; the cuts come after draw % (units + 1) of them.
    """
    index = Exceptions(p.data)
    start, end = p.at[:-1], p.at[1:]
    if unit == LINE:
        ends, n = line_ends(p)
        first = np.searchsorted(ends, start, "right")
        after = np.sort(draw % (n + 1)[:, None], axis=1)
        ends = np.append(ends, 0)
        cut = np.where(after > 0, ends[np.maximum(first[:, None] + after - 1, 0)], start[:, None])
        at = np.column_stack([start, cut, end])
        return n, at, index.characters(at.ravel()).reshape(at.shape)
    begin, stop = index.characters(start), index.characters(end)
    n = stop - begin
    characters = np.column_stack([begin, begin[:, None] + np.sort(draw % (n + 1)[:, None], axis=1), stop])
    return n, index.bytes(characters.ravel()).reshape(characters.shape), characters


def _rearranged(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    marks = pre, suf, mid = [m.encode() for m in (layout.prefix, layout.suffix, layout.middle)]
    for batch in batches:
        text, draws = batch.column(1), np.column_stack([batch.column(c).to_numpy() for c in range(2, 6)])
        for p in pieces(text):
            h = draws[p.first : p.first + p.rows]
            n, at, characters = cuts(p, layout.unit, h[:, :2])
            lengths = np.diff(characters, axis=1)
            whole = p.data.tobytes()
            out, forms = [], []
            for i, (a, b, c, d) in enumerate(at.tolist()):
                t = whole[a:d]
                form = PLAIN if a == d or h[i, 2] % 100 >= layout.rate or any(m in t for m in marks) else SPM if h[i, 3] % 100 < layout.spm_rate else PSM
                forms.append(form)
                if form == PSM:
                    t = b"".join((pre, whole[a:b], suf, whole[c:d], mid, whole[b:c]))
                elif form == SPM:
                    t = b"".join((suf, whole[c:d], pre, whole[a:b], mid, whole[b:c]))
                out.append(t)
            plain = np.array([f == PLAIN for f in forms], bool)
            numbers = [pa.array(n, pa.int64()), pa.array(forms, pa.string()), *(pa.array(lengths[:, k], pa.int64(), mask=plain) for k in (0, 1))]
            # the bytes are whole characters of the text and the sentinels, so they are UTF-8
            yield pa.RecordBatch.from_arrays([batch.column(0)[p.first : p.first + p.rows], *numbers, pa.array(out, pa.binary()).cast(pa.string())], ["row", *OUT])


def transformed(docs: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """The columns of `docs` and n (units), form, prefix_chars, middle_chars, output."""
    name = F.sha2(F.concat(F.lit(f"{layout.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(name, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    row = F.struct(*[c for c in docs.columns if c not in OUT]).alias("row")
    rows = docs.select(row, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *draws)
    shape = T.StructType([rows.schema["row"], *T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string").fields])
    return rows.mapInArrow(lambda b: _rearranged(b, layout), shape).select("row.*", *OUT)


def restored(output: Column, form: Column, layout: Layout = Layout()) -> Column:
    """The text an output was made of."""
    after = lambda mark: F.substring_index(output, mark, -1)
    before = lambda part, mark: F.substring_index(part, mark, 1)
    psm = F.concat(before(after(layout.prefix), layout.suffix), after(layout.middle), before(after(layout.suffix), layout.middle))
    spm = F.concat(before(after(layout.prefix), layout.middle), after(layout.middle), before(after(layout.suffix), layout.prefix))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def digests(docs: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row."""
    out = transformed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), layout)
    sha = lambda text: F.sha2(text, 256)
    back = restored(F.col("output"), F.col("form"), layout)
    return out.select("doc_id", *OUT[:4], sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
  FROM documents),
cut AS (
  SELECT doc_id, t, units, len(units) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT doc_id, t, n, form,
         array_to_string(units[1:least(c1, c2)], '') AS p,
         array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(units[greatest(c1, c2) + 1:n], '') AS s
  FROM cut)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
