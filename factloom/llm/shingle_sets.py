"""Which word shingles documents share, found without a row per shingle.

Each map task hashes the shingles of a chunk of documents and deals them, packed into
binary rows, to ranges of the hash space. A range's task counts each shingle's documents
over the whole corpus and answers the chunks with the shingles that two or more documents
have. Only those can be common to two documents, so a document's shared shingles and
its set size are all that an exact Jaccard similarity needs.

Equal sets within a chunk are dealt once, and a shingle of many documents of a chunk
is dealt once with their number, so that a hot shingle costs a range a few entries a chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .exchange import DIRECT, cuts, exchange, lot_of
from .packed import expand, squeeze
from .textcore import U64, grams, hash_spans, mix, texts_of, words_of

SHINGLE, PERCENT = 5, 75
#: Text bytes that make one range of the hash space.
RANGE_BYTES = 8 << 20
#: A shingle of more documents of one chunk is dealt as one entry with their number.
HOT = 12
#: A shingle of more documents (copies of one set within a chunk are one) is of the frequent class.
FREQUENT = 16
LOW48 = U64((1 << 48) - 1)


def pack48(v: np.ndarray) -> bytes:
    return np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def range_count(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> int:
    """Ranges in proportion to the whole text."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(1, -(-size // range_bytes))


def shingle_sets(text: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within it, and where each row's begin.

    Fewer than n words make one shingle, none make no shingle. A-Z count as a-z.
    """
    t = texts_of(text).lower()
    w = words_of(t)
    h = hash_spans(t.data, w.start, w.length)
    g = grams(h, n)
    sets: list[np.ndarray] = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            sets.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            short = np.array([b - a], U64)
            for k in range(a, b):
                short = mix(short * U64(0x9E3779B97F4A7C15) + h[k : k + 1])
            sets.append(short)
        else:
            sets.append(np.zeros(0, U64))
    return np.concatenate([*sets, np.zeros(0, U64)]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _row_counts(row: np.ndarray) -> bytes:
    """How many entries each row has; entries are in order of rows."""
    return squeeze(np.bincount(row).astype(np.uint32))


def _add_by_row(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.concatenate([np.zeros(1, U64), np.cumsum(v, dtype=U64)])
    return c[first[1:]] - c[first[:-1]]


def shared_sets(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE, range_bytes: int = RANGE_BYTES, direct: int = DIRECT) -> DataFrame:
    """A row for each document: doc_id, text_key, n (set size), f1, f2 (fingerprint of the set), tokens, r, prefix, rare.

    tokens (sorted unsigned 64-bit values) and what follows are null unless the document is the first of
    its set in its chunk and enough of its shingles are shared for a link. r: shingles that FREQUENT documents or fewer have.
    prefix: the rarest shared shingles, in an order that is the same for all documents, so many that two linked documents have two or more
    in common; the first `rare` of them are no frequent ones.
    """

    def deal(batch: pa.RecordBatch) -> tuple[object, dict[int, object]]:
        ids = batch.column(0).to_pylist()
        h, first = shingle_sets(batch.column(1), n)
        size = np.diff(first)
        f1, f2 = _add_by_row(mix(h), first), _add_by_row(mix(h ^ U64(0xA5A5A5A5A5A5A5A5)), first)
        _, lead = np.unique(np.stack([f1, f2]), axis=1, return_index=True)
        rep = np.zeros(len(ids), bool)
        rep[lead] = True
        rep &= size > 0
        row = np.repeat(np.arange(len(ids), dtype=np.uint16), size)
        use = rep[row]
        h, row = h[use], row[use]
        order = np.argsort(h, kind="stable")
        h, row = h[order], row[order]
        at = lot_of(h, ranges)
        h &= LOW48
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(h)))
        hot = count > HOT
        inside = np.repeat(hot, count)
        asked = {}
        for r, s in cuts(at):
            a = np.arange(s.start, s.stop)[~inside[s]]
            a = a[np.argsort(row[a], kind="stable")]
            m = slice(*np.searchsorted(start, [s.start, s.stop]))
            many = start[m][hot[m]]
            asked[r] = (pack48(h[a]), _row_counts(row[a]), pack48(h[many]), squeeze(count[m][hot[m]].astype(np.uint32)))
        return (ids, batch.column(2).to_pylist(), size, f1, f2, rep, pack48(h[inside]), row[inside]), asked

    def answer(_: int, asked: list) -> list:
        parts = [(p[0], expand(p[1]), p[2], expand(p[3])) for p in asked]
        token = np.concatenate([unpack48(x) for p in parts for x in (p[0], p[2])])
        weight = np.concatenate([x for p in parts for x in (np.ones(len(p[0]) // 6, np.uint32), p[3])])
        order = np.argsort(token, kind="stable")
        s = token[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        total = np.add.reduceat(weight[order].astype(np.int64), np.flatnonzero(new)) if len(s) else np.zeros(0, np.int64)
        df = np.empty(len(s), np.int64)
        df[order] = total[np.cumsum(new) - 1]
        df = np.minimum(df, 255).astype(np.uint8)
        out, a = [], 0
        for p in parts:
            alone = df[a : a + len(p[0]) // 6]
            a += len(alone)
            many = df[a : a + len(p[3])]
            a += len(p[3])
            yes = alone > 1
            rows = np.repeat(np.arange(len(p[1])), p[1])[yes]
            out.append((pack48(unpack48(p[0])[yes]), _row_counts(rows), alone[yes].tobytes(), p[2], many.tobytes()) if yes.any() or len(p[2]) else None)
        return out

    def gather(own: tuple, parts: list) -> pd.DataFrame:
        ids, keys, size, f1, f2, rep, raw, row = own
        many = unpack48(b"".join(p[3] for p in parts))
        many_df = np.frombuffer(b"".join(p[4] for p in parts), np.uint8)
        order = np.argsort(many)
        local = unpack48(raw)
        local_df = many_df[order][np.searchsorted(many[order], local)] if len(local) else np.zeros(0, np.uint8)
        token = np.concatenate([unpack48(b"".join(p[0] for p in parts)), local])
        counts = [expand(p[1]) for p in parts]
        at = np.concatenate([*(np.repeat(np.arange(len(c)), c) for c in counts), row]).astype(np.int64)
        df = np.concatenate([np.frombuffer(b"".join(p[2] for p in parts), np.uint8), local_df])
        order = np.lexsort((token, df, at))
        token, df, first = token[order], df[order], np.searchsorted(at[order], np.arange(len(ids) + 1))
        out = []
        for i in range(len(ids)):
            t, d = token[first[i] : first[i + 1]], df[first[i] : first[i + 1]]
            if not rep[i] or 100 * len(t) < percent * size[i]:
                out.append((None, None, None, None))
                continue
            # two more than the places that may differ, less the shingles of this document alone, which come first
            reach = int(size[i]) - -(-percent * int(size[i]) // 100) + 2 - (int(size[i]) - len(t))
            out.append((np.sort(t).astype("<u8").tobytes(), int(size[i] - (d > FREQUENT).sum()), t[:reach].astype(np.int64), int((d[:reach] <= FREQUENT).sum())))
        tokens, r, prefix, rare = zip(*out, strict=True)
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "text_key": keys, "n": size, "f1": f1.view(np.int64), "f2": f2.view(np.int64), "tokens": tokens, "r": pd.array(r, "Int64"), "prefix": prefix, "rare": pd.array(rare, "Int64")})

    ranges = range_count(docs, range_bytes)
    rows = id_and_text(docs).withColumn("text_key", F.xxhash64("text"))
    schema = "doc_id bigint, text_key bigint, n bigint, f1 bigint, f2 bigint, tokens binary, r bigint, prefix array<bigint>, rare bigint"
    return exchange(rows, ranges, deal, answer, gather, schema, direct=direct)
