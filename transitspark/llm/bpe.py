"""Byte-level BPE over one table of the corpus's distinct words.

Tasks split texts into words by the tokenizer's own pattern, on Arrow buffers. Neighbouring rows form blocks of `BLOCK_WORDS`
words; a block lists each of its words once, frequent ones first, and a text becomes its places in that
list. The lists are dealt by the words' hash into as many parts as Spark shuffles into: all blocks' lists of a part
meet in one task, which encodes each distinct word of that part once and hands every list its ids.
Joined by block again, the places of a text pick its ids. A word crosses the network once for each block that
holds it, and a frequent word is one entry of a block like any other; texts do not cross it at all. A task holds the
distinct words of one part, as a hash aggregate would.

`decode` joins every id of every text with its piece in the vocabulary, wherever the ids come from. `round_trip`, which has
the ids of a whole block in one task, picks their pieces there: a join on the distinct ids of a block was built and
measured, and its rows outgrew the budget (README).

Blocks are built twice, for their lists and for their places, so `docs` must give its rows in the same order
whenever it is read, as a table does. A block's name holds a digest of its list: were the order to change in between,
the names would not meet and the job would fail; its results are never wrong.

The pattern's classes are tabled for characters below U+0250, where no version of Unicode differs; a text
with others is split by the tokenizer itself, as is one with the special token's string, which is the special
token, as the tokenizer reads it.

Defined results: null and empty texts have no ids and decode to an empty text; every row gives one row;
ids of documents may be null; other columns are left out by the digests and carried along by `encode`. An id
without a piece ends the job.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from transitspark.llm.text import Piece, pieces
from transitspark.session import local_rows, rewritten

BLOCK_WORDS = 1_000_000

# White space as the tokenizer's pattern means it, and the pattern itself.
_SPACE = r"\t-\r \x85\xa0  -     　"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

FOREIGN = r"[^\x00-\u024F]"


def vocabulary(path: str) -> str:
    """The tokenizer's file with truncation and padding off; a few MB, read once by the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return json.dumps(spec | {"truncation": None, "padding": None})


def _byte_of() -> dict[str, int]:
    """Which byte each character of a piece stands for: printable ones themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_LETTER, _NUMBER, _WHITE, _OTHER = range(4)
#: The class of each character below U+0250.
_KIND = np.array([_WHITE if regex.match(f"[{_SPACE}]", c) else _LETTER if regex.match(r"\p{L}", c) else _NUMBER if regex.match(r"\p{N}", c) else _OTHER for c in map(chr, range(0x250))], np.int8)


def word_starts(p: Piece) -> np.ndarray:
    """Where the words of texts without foreign characters begin, in bytes: `WORD` for all texts of a piece at once."""
    at = np.flatnonzero(p.data & 0xC0 != 0x80)
    lead = p.data[at].astype(np.int32)
    wide = lead >= 0xC0
    code = lead.copy()
    code[wide] = (lead[wide] & 0x1F) << 6 | p.data[np.minimum(at[wide] + 1, len(p.data) - 1)] & 0x3F
    kind = _KIND[np.minimum(code, 0x24F)]
    n = len(at)
    first = np.zeros(n + 1, bool)  # of a text
    first[np.searchsorted(at, p.at)] = True
    begins = first[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(begins)
    end = np.append(run[1:], n)
    # white space before something else: its last character stands alone, or goes with what follows if it is a blank
    white = (kind[run] == _WHITE) & ~first[end]
    last = end[white] - 1
    begins[last] = True
    blank = code[last] == 32
    begins[last[blank] + 1] = False
    # an apostrophe with no blank before it, and an ending after it
    mark = np.flatnonzero((kind[run[:-1]] == _OTHER) & (end[:-1] - run[:-1] == 1) & (code[run[:-1]] == 39) & begins[run[:-1]] & (kind[run[1:]] == _LETTER) & ~first[run[1:]])
    start, stop = run[mark] + 1, end[mark + 1]
    one = code[start]
    two = np.where(stop - start > 1, code[np.minimum(start + 1, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = (two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (two == ord("l")) & (one == ord("l"))
    cut = short | long
    begins[start[cut]] = False
    after = start[cut] + 1 + long[cut]
    begins[after[after < stop[cut]]] = True
    return at[begins]


class Splitter:
    """Words of texts whose ids do not depend on what stands around them."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.special = {t["content"] for t in json.loads(spec)["added_tokens"]}
        self.word = regex.compile(WORD)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.foreign = regex.compile(FOREIGN)

    def words(self, text: str) -> list[str]:
        """The words of one text, of any characters."""
        split = self._by_tokenizer if self.foreign.search(text) else self.word.findall
        if self.cut is None or not self.cut.search(text):
            return split(text)
        return [w for part in self.cut.split(text) for w in ([part] if part in self.special else split(part))]

    def _by_tokenizer(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def of_piece(self, p: Piece) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts of a piece, one after another, and how many each text has."""
        odd = np.flatnonzero(p.data >= 0xCA).tolist() + np.flatnonzero((p.data[:-1] == 0xC9) & (p.data[1:] >= 0x90)).tolist()
        odd = set((np.searchsorted(p.at, np.array(odd, np.int64), "right") - 1).tolist())
        whole = p.data.tobytes()
        for token in (t.encode() for t in self.special):
            i = whole.find(token)
            while i >= 0:
                odd.add(int(np.searchsorted(p.at, i, "right")) - 1)
                i = whole.find(token, i + 1)
        start = word_starts(p)
        of = np.searchsorted(start, p.at)
        offsets = np.append(start, len(p.data)).astype(np.int64)
        flat = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(whole)).dictionary_encode()
        sizes = np.diff(of)
        if not odd:
            return flat, sizes
        flat, parts, first = flat.dictionary_decode(), [], 0
        for i in sorted(odd):
            own = self.words(p.text(i).decode())
            parts += [flat[first : of[i]], pa.array(own, pa.large_string())]
            first, sizes[i] = int(of[i + 1]), len(own)
        return pa.concat_arrays([*parts, flat[first:]]).dictionary_encode(), sizes

    def encoded(self, words: list[str]) -> list[bytes]:
        """Ids of words as little-endian unsigned 32-bit integers."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def packed(places: np.ndarray) -> bytes:
    """Numbers in groups of seven bits, low ones first; all but the last byte of a number have the high bit set."""
    places = places.astype(np.uint32)
    size = 1 + sum((places >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))
    first = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(5):
        has = size > k
        out[first[has] + k] = (places[has] >> np.uint32(7 * k)) & np.uint32(127) | ((size[has] > k + 1) * 128).astype(np.uint32)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    part = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(part < 128) + 1
    if not len(ends):
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], ends[:-1]])
    shift = 7 * (np.arange(len(part)) - np.repeat(first, ends - first))
    return np.add.reduceat((part & 127).astype(np.int64) << shift, first)


class Block:
    """Words of neighbouring rows."""

    def __init__(self) -> None:
        self._numbers: dict[str, int] = {}
        self._codes, self._sizes, self.words = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0

    def add(self, words: pa.DictionaryArray, sizes: np.ndarray) -> None:
        """More texts: their words one after another, and how many each has."""
        number, used = self._numbers, np.asarray(words.indices)
        seen, where = np.unique(used, return_index=True)
        seen = seen[np.argsort(where)]  # by first appearance
        of = np.zeros(len(words.dictionary), np.int32)
        of[seen] = np.fromiter((number.setdefault(w, len(number)) for w in words.dictionary.take(pa.array(seen)).to_pylist()), np.int32, len(seen))
        self._codes.append(of[used])
        self._sizes.append(sizes)
        self.words += len(words)

    def listed(self, at: tuple[int, int]) -> tuple[int, list[str], np.ndarray, np.ndarray]:
        """Its name, its words by falling frequency, the places of its texts in that list, and how many each text has."""
        codes = np.concatenate(self._codes)
        counts = np.bincount(codes, minlength=len(self._numbers))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by_number = list(self._numbers)
        words = [by_number[i] for i in order]
        name = hashlib.blake2b(f"{at} {self.words} ".encode() + "\0".join(words).encode(), digest_size=8).digest()
        return int.from_bytes(name, "little", signed=True), words, rank[codes], np.concatenate(self._sizes)


def _one_thread() -> None:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def _blocks(batches: Iterator[pa.RecordBatch], splitter: Splitter, size: int) -> Iterator[tuple[Block, tuple[int, int], list[pa.Array]]]:
    """Blocks of rows (text, row), their number in the task, and their row columns."""
    partition, number = TaskContext.get().partitionId(), 0
    block, rows = Block(), []
    for batch in batches:
        for p in pieces(batch.column(0)):
            words, sizes = splitter.of_piece(p)
            upto, first = np.concatenate([[0], np.cumsum(sizes)]), 0
            while first < p.rows:
                # the row that fills the block is its last
                end = int(np.searchsorted(upto[1:], upto[first] + size - block.words)) + 1
                full, end = end <= p.rows, min(end, p.rows)
                block.add(words[upto[first] : upto[end]], sizes[first:end])
                rows.append(batch.column(1)[p.first + first : p.first + end])
                if full:
                    yield block, (partition, number), rows
                    block, rows, number = Block(), [], number + 1
                first = end
    if rows:
        yield block, (partition, number), rows


def _parcel(texts: list[bytes]) -> tuple[bytes, bytes]:
    """Strings as their lengths and their compressed sequence."""
    return packed(np.fromiter(map(len, texts), np.int64, len(texts))), zlib.compress(b"".join(texts), 1)


def _unparcel(lengths: bytes, data: bytes) -> list[bytes]:
    data, ends = zlib.decompress(data), np.cumsum(unpacked(lengths)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def block_words(texts: DataFrame, spec: str, size: int = BLOCK_WORDS) -> DataFrame:
    """(block, part, places, lengths, words): each word of a block once, by the part of its hash. `texts`: text, and any column."""
    spread = texts.sparkSession.sparkContext.broadcast(spec)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, at, _ in _blocks(batches, Splitter(spread.value), size):
            name, listed, _, _ = block.listed(at)
            listed = [w.encode() for w in listed]
            part = np.fromiter(map(zlib.crc32, listed), np.int64, len(listed)) % parts
            by_part = np.argsort(part, kind="stable")
            found, first = np.unique(part[by_part], return_index=True)
            out = []
            for of in np.split(by_part, first[1:]) if len(found) else []:
                out.append((packed(np.diff(of, prepend=0)), *_parcel([listed[i] for i in of])))
            binary = [pa.array([o[c] for o in out], pa.binary()) for c in range(3)]
            yield pa.record_batch([np.full(len(found), name), pa.array(found, pa.int32()), *binary], ["block", "part", "places", "lengths", "words"])

    return texts.select("text", F.lit(0).alias("row")).mapInArrow(words, "block long, part int, places binary, lengths binary, words binary")


def block_places(texts: DataFrame, spec: str, size: int = BLOCK_WORDS) -> DataFrame:
    """(block, sizes, places, rows): one row for each block, the places of its texts in its list. `texts`: text, row."""
    spread = texts.sparkSession.sparkContext.broadcast(spec)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, at, rows in _blocks(batches, Splitter(spread.value), size):
            name, _, places, sizes = block.listed(at)
            rows = pa.concat_arrays(rows)
            binary = [pa.array([x], pa.binary()) for x in (packed(sizes), zlib.compress(packed(places), 1))]
            yield pa.RecordBatch.from_arrays([pa.array([name]), *binary, pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], ["block", "sizes", "places", "rows"])

    row = texts.schema["row"].dataType
    return texts.mapInArrow(places, T.StructType.fromDDL("block long, sizes binary, places binary").add("rows", T.ArrayType(row)))


def word_ids(listed: DataFrame, spec: str) -> DataFrame:
    """(block, places, lengths, ids) of what `block_words` gives; each distinct word is encoded once."""
    spread = listed.sparkSession.sparkContext.broadcast(spec)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _one_thread()
        splitter, of, table = Splitter(spread.value), None, {}
        for batch in batches:
            out = []
            for part, lengths, words in zip(*(batch.column(c).to_pylist() for c in (1, 3, 4))):
                if part != of:
                    of, table = part, {}
                words = _unparcel(lengths, words)
                new = [w for w in words if w not in table]
                table.update(zip(new, splitter.encoded([w.decode() for w in new])))
                out.append(_parcel([table[w] for w in words]))
            yield pa.record_batch([batch.column(0), batch.column(2), *(pa.array([o[c] for o in out], pa.binary()) for c in (0, 1))], ["block", "places", "lengths", "ids"])

    by_part = listed.repartition("part").sortWithinPartitions("part")
    return by_part.mapInArrow(ids, "block long, places binary, lengths binary, ids binary")


def pieces_of(spec: str) -> dict[int, bytes]:
    """The bytes of every id of the vocabulary."""
    spec = json.loads(spec)
    byte = _byte_of()
    piece = {i: bytes(byte[c] for c in w) for w, i in spec["model"]["vocab"].items()}
    return piece | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


class _Spans:
    """Byte strings by number, one after another; picks many of them at once."""

    def __init__(self, strings: Sequence[bytes]) -> None:
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.first = np.cumsum(self.size) - self.size

    def picked(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Their bytes joined, and where each string begins, and the end."""
        n = self.size[numbers]
        done = np.concatenate([[0], np.cumsum(n)])
        return self.data[np.repeat(self.first[numbers] - done[:-1], n) + np.arange(done[-1])], done


def _block_entries(words: pa.Table) -> list[bytes]:
    """The ids of each word of a block's list."""
    at = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unpacked(p)) for p in words["places"].to_pylist())])
    table = [b""] * len(at)
    entries = (i for row in zip(words["lengths"].to_pylist(), words["ids"].to_pylist()) for i in _unparcel(*row))
    for place, entry in zip(at.tolist(), entries):
        table[place] = entry
    return table


def _joined(docs: DataFrame, spec: str, keep: Sequence[str], size: int, back: bool) -> DataFrame:
    """(row, ids, decoded): the columns `keep` of every row, the ids of `text` as little-endian binary, and if `back` their text."""
    text = F.col("text").cast("string").alias("text")
    texts = docs.select(text, F.struct(*keep).alias("row"))
    spread = docs.sparkSession.sparkContext.broadcast(spec)
    coded = word_ids(block_words(docs.select(text), spec, size), spec)

    def picked(texts: pa.Table, words: pa.Table) -> pa.Table:
        table, out = _Spans(_block_entries(words)), []
        for sizes, places, rows in zip(texts["sizes"].to_pylist(), texts["places"].to_pylist(), texts["rows"]):
            places, sizes = unpacked(zlib.decompress(places)), unpacked(sizes)
            if len(places) and places.max() >= len(table.size):
                raise RuntimeError("the documents came in another order when read again; write them to a table first")
            data, at = table.picked(places)
            at = at[np.concatenate([[0], np.cumsum(sizes)])]
            ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
            decoded = _decoded(data.view("<i4"), at // 4, spread.value) if back else pa.nulls(len(sizes), pa.string())
            out.append(pa.table({"row": rows.values, "ids": ids, "decoded": decoded}))
        return pa.concat_tables(out) if out else to_arrow_schema(shape).empty_table()

    shape = T.StructType([texts.schema["row"]]).add("ids", T.BinaryType()).add("decoded", T.StringType())
    return block_places(texts, spec, size).groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(picked, shape)


_PIECES: dict[str, _Spans] = {}


def _decoded(ids: np.ndarray, ends: np.ndarray, spec: str) -> pa.Array:
    """Texts of ids, one after another."""
    if spec not in _PIECES:
        piece = pieces_of(spec)
        _PIECES[spec] = _Spans([piece.get(i, b"") for i in range(max(piece, default=-1) + 1)])
    data, at = _PIECES[spec].picked(ids)
    data, bounds = data.tobytes(), at[ends].tolist()
    return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])], pa.string())


def _as_lists(coded: DataFrame) -> DataFrame:
    """Binary ids as arrays of int, cut on Arrow buffers."""
    names = coded.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            data = columns[1].cast(pa.large_binary())
            at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
            flat = np.frombuffer(data.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view("<i4")
            columns[1] = pa.ListArray.from_arrays(pa.array((at - at[0]) // 4, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return coded.mapInArrow(cut, T.StructType([coded.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), *coded.schema.fields[2:]]))


def encode(docs: DataFrame, spec: str, keep: Sequence[str] | None = None, size: int = BLOCK_WORDS) -> DataFrame:
    """The columns of `docs` (or those of `keep`) and `ids` (array of int), the ids of `text`."""
    columns = [c for c in (docs.columns if keep is None else keep) if c != "ids"]
    return _as_lists(_joined(docs, spec, columns, size, False).select("row", "ids")).select("row.*", "ids")


def round_trip(docs: DataFrame, spec: str, keep: Sequence[str] | None = None, size: int = BLOCK_WORDS) -> DataFrame:
    """As `encode`, but `ids` as little-endian unsigned 32-bit integers in a binary, and `decoded`, their text."""
    columns = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]
    return _joined(docs, spec, columns, size, True).select("row.*", "ids", "decoded")


def decode(encoded: DataFrame, spec: str) -> DataFrame:
    """The columns of `encoded` and `decoded`, the text of `ids`: every id is joined with its piece, wherever the ids come from."""
    columns = [c for c in encoded.columns if c != "decoded"]
    vocabulary_ = local_rows(encoded.sparkSession, T.StructType.fromDDL("id int, piece binary"), list(pieces_of(spec).items()))
    rows = rewritten(encoded.select(F.monotonically_increasing_id().alias("__row"), F.struct(*columns).alias("__all")), "encoded")
    tokens = rows.select("__row", F.posexplode("__all.ids").alias("at", "id")).join(F.broadcast(vocabulary_), "id", "left")
    piece = F.coalesce(F.col("piece").cast("string"), F.raise_error(F.concat(F.lit("no piece of id "), F.col("id"))))
    inside = F.transform(F.array_sort(F.collect_list(F.struct("at", piece.alias("piece")))), lambda t: t["piece"])
    texts = tokens.groupBy("__row").agg(F.make_valid_utf8(F.array_join(inside, "")).alias("decoded"))
    back = rows.join(texts, "__row", "left").select("__all.*", F.coalesce("decoded", F.lit("")).alias("decoded"))
    return back.select(*columns, "decoded")


def digests(docs: DataFrame, spec: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, by `round_trip`."""
    rows = round_trip(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), spec, keep=["doc_id"])
    sha = lambda c: F.sha2(c, 256)
    return rows.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), sha("ids").alias("ids_sha256"), sha("decoded").alias("decoded_sha256"))
