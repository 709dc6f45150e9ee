"""Vectorised text primitives over Arrow string columns.

Everything here works on the raw UTF-8 buffer of a batch: words and lines are byte
spans, their hashes are 64-bit numpy arrays, and no Python object is made per word.
White space is the ASCII set 0x20, 0x09-0x0D, whose bytes never occur inside a
multi-byte code point, so byte spans are whole words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Spans longer than this are hashed one by one, so that a huge span costs one call.
_LONG_SPAN = 2048
#: grams() makes so many at a time, which a processor's cache holds.
_GRAMS = 1 << 14
_GAMMA, _M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h *= _M1
    h ^= h >> U64(27)
    h *= _M2
    h ^= h >> U64(31)
    return h


@dataclass
class Texts:
    """Concatenated UTF-8 bytes of some rows; row i is data[offs[i]:offs[i + 1]]."""

    data: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1

    def lower(self) -> Texts:
        return Texts(_LOWER[self.data], self.offs)


def texts_of(column: pa.Array) -> Texts:
    """A string column's bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8) if off else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(raw[offs[0] : offs[-1]], offs - offs[0])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 4 << 20, max_rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about max_bytes of text in max_rows rows at most; a longer text is alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        if not len(sizes):
            continue
        begin, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > begin and (held + n > max_bytes or i - begin >= max_rows):
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)


@dataclass
class Spans:
    """Byte spans (words or lines) in row order; row i has spans first[i]:first[i + 1]."""

    start: np.ndarray
    length: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def words_of(t: Texts) -> Spans:
    inside = ~SPACE[t.data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = t.offs[1:-1]
    edge = edge[edge < len(t.data)]
    begins[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = edge[edge > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Spans(start, end - start, np.searchsorted(start, t.offs))


def lines_of(t: Texts) -> Spans:
    """Lines split at \\n; an empty row has one empty line."""
    breaks = np.flatnonzero(t.data == 10)
    first = np.searchsorted(breaks, t.offs) + np.arange(len(t.offs))
    ends = np.arange(len(breaks)) + np.searchsorted(t.offs[1:], breaks, side="right")  # each row before has one line more than breaks
    start, end = np.empty((2, first[-1]), np.int64)
    start[first[:-1]], start[ends + 1] = t.offs[:-1], breaks + 1
    end[first[1:] - 1], end[ends] = t.offs[1:], breaks
    return Spans(start, end - start, first)


def hash_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit content hashes of byte spans, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    h = mix(length.astype(U64) + _GAMMA)
    short = length <= _LONG_SPAN
    live = np.flatnonzero(short & (length > 0))
    at = 0
    while len(live):
        left = length[live] - at
        v = eights[start[live] + at]
        tail = left < 8
        v = np.where(tail, v & ((U64(1) << (np.minimum(left, 7).astype(U64) << U64(3))) - U64(1)), v)
        h[live] = mix((h[live] ^ v) * _M2 + _GAMMA)
        live = live[left > 8]
        at += 8
    for i in np.flatnonzero(~short):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + length[i]].tobytes(), seed=11)
    return h


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive items, as if all rows were one; see gram_mask."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, U64)
    for a in range(0, m, _GRAMS):
        part = out[a : a + _GRAMS]
        for k in range(a, a + n):
            part += h[k : k + len(part)]
            part *= _M1
            part += _GAMMA
            part ^= part >> U64(29)
        part[:] = mix(part)
    return out


def gram_mask(first: np.ndarray, n: int) -> np.ndarray:
    """Which positions of grams() lie within one row."""
    total = int(first[-1])
    ok = np.ones(max(0, total - n + 1), bool)
    for k in range(1, n):
        cross = first[1:-1] - k
        cross = cross[(cross >= 0) & (cross < len(ok))]
        # a gram begun k items before a row's end crosses it unless the row is shorter
        ok[cross] = False
    return ok


def per_row_sum(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def later_copies(keys: np.ndarray) -> np.ndarray:
    """Which keys equal a key further to the left."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    s = keys[order]
    out[order[1:][s[1:] == s[:-1]]] = True
    return out
