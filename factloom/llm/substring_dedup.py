"""Substring dedup: seed and extend, on winnowed anchors.

Seeds: of each 13-word window the 6-word gram of the least hash is its anchor, so two equal windows have the same anchor at the
same place, and about two in nine grams are anchors. Chunks of documents send their distinct anchors to ranges of the hash space, which
answer with those that two or more documents have: documents are joined on anchors without a pair of occurrences.
Extend: a shared anchor is extended to both sides, by j words to the left and 7 - j to the right for each j that keeps it the window's anchor.
Extensions are compared by a 64-bit hash of all their words, and one is a repeat when a document with a smaller
id has it. Those that follow one another chain into maximal repeats of 13 words or more, given as word spans.

Within a chunk of documents only an extension's occurrences in the smallest document are asked about (the
others repeat it already), so a passage of any number of documents costs a range one entry a chunk. Extensions are dealt by their own hash,
so that those of one frequent anchor go to many ranges.

Defined cases: null and empty texts have no words and stay empty. Rows of equal doc_id and text get equal
results and are no repeats of each other; nor are different texts of one doc_id. A null doc_id is
smaller than any other. Texts of fewer than 13 words stay whole. An empty table gives an empty result.
Columns other than doc_id and text are not read; remove_repeats() passes them through.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_names, map_batches
from .exchange import DIRECT, cuts, exchange, expand, lot_of, squeeze
from .shingle_sets import LOW48, RANGE_BYTES, pack48, range_count, unpack48
from .textcore import U64, Texts, gram_mask, grams, hash_spans, mix, repeated, texts_of, words_of

WINDOW, SEED = 13, 6
_NULL_ID = -(1 << 63)


def anchors(h: np.ndarray, window: int = WINDOW, seed: int = SEED) -> np.ndarray:
    """Of each window's seed grams the least hash, by window begin."""
    low, have, width = grams(h, seed), 1, window - seed + 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        have += step
    return low


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))


def shared_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED, direct: int = DIRECT) -> DataFrame:
    """A row for each chunk of documents: packed, its documents and the windows whose anchor two or more documents have."""
    ranges = range_count(docs, 4 * RANGE_BYTES)

    def words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and keys of the distinct documents, where their words begin, the windows' places, word hashes, and the windows' anchors."""
        ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        _, once = np.unique(np.stack([ids, keys]), axis=1, return_index=True)
        batch = batch.take(pa.array(np.sort(once)))
        t = texts_of(batch.column(1))
        w = words_of(t)
        h = hash_spans(t.data, w.start, w.length)
        at = np.flatnonzero(gram_mask(w.first, window))
        return batch.column(0).to_numpy(), batch.column(2).to_numpy(), w.first, at, h, mix(anchors(h, window, seed)[at])

    def deal(batch: pa.RecordBatch) -> dict[int, object]:
        ids, _, first, at, _, low = words(batch)
        doc = ids[np.searchsorted(first, at, side="right") - 1]
        order = np.argsort(low, kind="stable")
        low, doc = low[order], doc[order]
        head = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else order
        several = np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head) if len(head) else head
        return {r: (pack48(low[head[s]] & LOW48), np.packbits(several[s]).tobytes()) for r, s in cuts(lot_of(low[head], ranges))}

    def answer(_: int, asked: list) -> list:
        anchor = [unpack48(a) for a, _ in asked]
        several = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(a)).astype(bool) for a, (_, b) in zip(anchor, asked, strict=True)]
        of = np.concatenate(anchor)
        shared = repeated(of) | np.concatenate(several)
        cut = np.cumsum([len(a) for a in anchor])[:-1]
        return [pack48(a[yes]) if yes.any() else None for a, yes in zip(anchor, np.split(shared, cut), strict=True)]

    def own(batch: pa.RecordBatch) -> object:
        t = texts_of(batch.column(1))
        return batch.column(0).to_numpy(), batch.column(2).to_numpy(), t.offs, zstandard.compress(np.ascontiguousarray(t.data), 6)

    def gather(own: tuple, replies: list) -> pd.DataFrame:
        ids, keys, offs, raw = own
        if not replies:
            return pd.DataFrame({"text": []}, dtype=object)
        text = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(np.ascontiguousarray(offs)), pa.py_buffer(zstandard.decompress(raw)))
        ids, keys, first, at, h, low = words(pa.RecordBatch.from_arrays([pa.array(ids), text, pa.array(keys)], ["doc_id", "text", "key"]))
        shared = np.unique(np.concatenate([unpack48(r) for r in replies]))
        low = low & LOW48
        at = at[shared[np.minimum(np.searchsorted(shared, low), len(shared) - 1)] == low]
        return pd.DataFrame({"text": [squeeze((ids, keys, first, np.diff(at, prepend=0).astype(np.uint32), grams(h, window)[at]))]})

    return exchange(_keyed(docs), ranges, deal, answer, gather, "text binary", own, direct)


def repeat_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED, direct: int = DIRECT) -> DataFrame:
    """doc_id (least bigint for null), key (xxhash64 of the text), spans: first word and length of each maximal repeat, flat.

    Only documents with a repeat have a row.
    """
    ranges = range_count(docs)

    def deal(batch: pa.RecordBatch) -> tuple[object, dict[int, object]]:
        ids, keys, first, steps, value = expand(batch.column(0)[0].as_py())
        at = np.cumsum(steps.astype(np.int64))
        doc = ids[np.searchsorted(first, at, side="right") - 1]
        order = np.argsort(value, kind="stable")
        new = np.ones(len(at), bool)
        new[1:] = value[order][1:] != value[order][:-1]
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1] if len(at) else doc
        repeats = np.zeros(len(at), bool)
        repeats[order] = doc[order] > least
        ask = np.flatnonzero(~repeats)
        lot = lot_of(value[ask], ranges)
        by = np.argsort(lot, kind="stable")
        ask, lot = ask[by], lot[by]
        asked = {}
        for r, s in cuts(lot):
            docs_, count = _runs(doc[ask[s]])
            asked[r] = value[ask[s]].tobytes(), squeeze((docs_, count, np.diff(ask[s], prepend=0).astype(np.uint32)))
        return squeeze((ids, keys, first, at[repeats], steps)), asked

    def answer(_: int, asked: list) -> list:
        value = np.frombuffer(b"".join(a for a, _ in asked), U64)
        heads = [expand(b) for _, b in asked]
        doc = np.concatenate([np.repeat(d, c) for d, c, _ in heads])
        order = np.argsort(value, kind="stable")
        s = value[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        yes = np.zeros(len(s), bool)
        yes[order] = doc[order] > least
        out, a = [], 0
        for *_, steps in heads:
            places = np.cumsum(steps.astype(np.int64))[yes[a : a + len(steps)]]
            a += len(steps)
            out.append(squeeze(np.diff(places, prepend=0).astype(np.uint32)) if len(places) else None)
        return out

    def gather(own: object, replies: list) -> pd.DataFrame:
        ids, keys, first, local, steps = expand(own)
        at = np.cumsum(steps.astype(np.int64))
        hit = np.concatenate([local, *(at[np.cumsum(expand(r).astype(np.int64))] for r in replies)]).astype(np.int64)
        change = np.zeros(int(first[-1]) + window + 1, np.int64)
        np.add.at(change, hit, 1)
        np.add.at(change, hit + window, -1)
        covered = (np.cumsum(change) > 0)[: int(first[-1])]
        rows = []
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if covered[a:b].any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], covered[a:b], [False]]).astype(np.int8))).reshape(-1, 2)
                edge[:, 1] -= edge[:, 0]
                rows.append((ids[i], keys[i], edge.ravel().astype(np.int32)))
        return pd.DataFrame({c: [r[k] for r in rows] for k, c in enumerate(("doc_id", "key", "spans"))}, dtype=object)

    return exchange(shared_windows(docs, window, seed, direct), ranges, deal, answer, gather, "doc_id bigint, key bigint, spans array<int>", direct=direct, alone=True)


def _runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    return v[start], np.diff(np.append(start, len(v))).astype(np.uint32)


def cut_spans(t: Texts, spans: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the kept words of all rows, joined by one space within a row, where each row's begin,
    and the word counts before and of what is cut."""
    w = words_of(t)
    keep = np.ones(len(w.start), bool)
    for i, s in enumerate(spans):
        for a, n in zip(s[::2], s[1::2], strict=True) if s is not None else ():
            keep[w.first[i] + a : w.first[i] + a + n] = False
    kept = np.flatnonzero(keep)
    row = w.row[kept]
    start, end = w.start[kept], w.start[kept] + w.length[kept]
    inner = np.flatnonzero(row[1:] == row[:-1])  # words with another after them in their row: the byte after is white space
    data = t.data.copy()
    data[end[inner]] = 0x20
    change = np.zeros(len(data) + 1, np.int8)
    change[start] += 1
    np.add.at(change, end, -1)
    take = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    take[end[inner]] = True
    at = np.concatenate([[0], np.cumsum(take)])[t.offs]
    return data[take], at, w.count.astype(np.int64), (w.count - np.bincount(row, minlength=len(t))).astype(np.int64)


def _with_spans(docs: DataFrame, window: int, seed: int) -> tuple[DataFrame, str]:
    """docs with the repeats' spans in an added column, and its name; the spans' side is the one that tasks hold."""
    doc, key, spans = clear_names(docs, "doc", "key", "spans")
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)), key: F.xxhash64(F.col("text").cast("string"))})
    found = repeat_spans(docs, window, seed).groupBy("doc_id", "key").agg(F.first("spans").alias(spans))
    found = found.withColumnsRenamed({"doc_id": doc, "key": key}).hint("shuffle_hash")
    return keyed.join(found, [doc, key], "left").select(*docs.columns, spans), spans


def substring_digest(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_repeats (maximal repeats cut)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = batch.column(2).to_pylist()
        data, at, n, removed = cut_spans(texts_of(batch.column(1)), spans)
        sums = [sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        repeats = [len(s or ()) // 2 for s in spans]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(removed), pa.array(sums), pa.array(repeats, pa.int64())], ["doc_id", "n_words", "n_removed", "kept_sha256", "n_repeats"])

    rows, found = _with_spans(docs.select("doc_id", "text"), window, seed)
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), found)
    return map_batches(rows, one, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, n_repeats bigint")


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """docs with repeats cut from the text; a text without repeats stays as it is, others are their kept words joined by spaces."""
    rows, _ = _with_spans(docs, window, seed)
    names, place = list(docs.columns), docs.columns.index("text")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, old = batch.column(batch.num_columns - 1).to_pylist(), batch.column(place).to_pylist()
        data, at, *_ = cut_spans(texts_of(batch.column(place)), spans)
        new = [o if s is None else data[a:b].tobytes().decode() for o, s, a, b in zip(old, spans, at[:-1].tolist(), at[1:].tolist(), strict=True)]
        columns = [pa.array(new, batch.column(place).type) if i == place else batch.column(i) for i in range(batch.num_columns - 1)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(rows, one, docs.schema)
