"""Word boundaries and hashes of whole texts, computed on Arrow buffers with numpy.

A `Piece` is a run of consecutive rows of one Arrow batch with about `PIECE_BYTES` of text, so the memory
of a task does not grow with its batch. A single longer text is a piece of its own. Null texts have no
words. A word of up to `LANES` bytes is hashed by mixing its eight-byte lanes one after another, a longer one by
BLAKE2b; neither is a polynomial, so no pattern of letters makes two words equal. A span of words is a polynomial
modulo 2**64 over word hashes, the difference of two prefix sums; spans are short (windows, shingles, items).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

U = np.uint64
_WORD_STEP, _LANE_STEP, _LANE_SALT = 0xD1342543DE82EF95 | 1, 0x9E3779B97F4A7C15 | 1, 0xA0761D6478BD642F
#: Bytes of a word that are mixed lane by lane.
LANES = 16


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(step: int, n: int) -> np.ndarray:
    """step**0 .. step**n modulo 2**64; kept between calls and grown by doubling."""
    have = _POWERS.get(step)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        row = np.full(size, step, np.uint64)
        row[0] = 1
        have = _POWERS[step] = np.cumprod(row, dtype=np.uint64)
    return have


def inverse(step: int) -> int:
    return pow(step, -1, 1 << 64)


class Spans:
    """Hashes of spans of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, step: int) -> None:
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(step, n)[:n], out=self.sums[1:])
        self.back = powers(inverse(step), n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


#: A-Z as a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LANE_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    """Hashes of words, given by the bytes they begin and end at; with `fold`, A-Z count as a-z."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data] if fold else data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    left = end - start
    out = mix(left.astype(np.uint64) * U(_WORD_STEP) + U(_LANE_SALT))
    at = np.flatnonzero(left <= LANES)
    place, left = start[at], left[at]
    while len(at):
        lane = eight[place] & _LANE_MASK[np.minimum(left, 8)]
        out[at] = mix(out[at] * U(_LANE_STEP) ^ mix(lane + U(_LANE_SALT)))
        more = left > 8
        at, place, left = at[more], place[more] + 8, left[more] - 8
    for i in np.flatnonzero(end - start > LANES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(padded[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


#: Bytes that are no part of a word: white space; or every ASCII byte but letters and digits.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[b for b in range(128) if not chr(b).isalnum()]] = True


@dataclass
class Piece:
    first: int  # row of the batch
    rows: int
    null: np.ndarray
    data: np.ndarray  # the texts' bytes, one after another
    at: np.ndarray  # where each text starts, and the end

    def text(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    null = np.asarray(column.is_null())
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Piece(i, j - i, null[i:j], data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


@dataclass
class Words:
    start: np.ndarray  # byte offsets in the piece
    end: np.ndarray
    of: np.ndarray  # where the words of each text start, and the end
    hash: np.ndarray

    def text_of(self, word: np.ndarray) -> np.ndarray:
        """The row in the piece of each word number."""
        return np.searchsorted(self.of, word, "right") - 1

    def spans(self) -> Spans:
        return Spans(self.hash, _WORD_STEP)


def words(piece: Piece, breaks: np.ndarray, fold: bool) -> Words:
    data, n = piece.data, len(piece.data)
    inside = ~breaks[data]
    cut = np.zeros(n + 1, bool)
    cut[piece.at] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (cut[:n] | ~before))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (cut[1:] | ~after)) + 1
    return Words(start, end, np.searchsorted(start, piece.at), word_hashes(data, start, end, fold))


def window_starts(of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every window of `size` words inside one text, and its row."""
    counts = np.maximum(np.diff(of) - size + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return of[:-1][row] + first, row


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Consecutive runs of `values` as an Arrow list column."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
