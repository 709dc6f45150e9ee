"""Spelling variants: words one edit apart, found by range scans of forward and reversed dictionaries.

Two words that differ by one code point, of which the longer has m, share their first half (m // 2 code points) or, if
the edit lies in it, all that follows it. So a word stands in a forward dictionary by its first half and in a
reversed one by its last half, once as the longer and once as the shorter of a pair. A block is the words of one entry; a
scan over dictionaries sorted by entry compares the words of a block. A block of more than BLOCK words is no work for one task and is
subdivided first: its undecided middle is halved again, into a block that shares the middle's first half too
and one that shares its last half. In the latter only pairs that differ within the former's half count, so each pair is met
exactly once however deep. A middle of one code point is not halved: its block has at most a word a letter, and one more.

A task sends how many near words a word has in a block and the best of them, never pairs; blocks are counted before any is
moved, so a hot one is never gathered.

Defined cases: a null or empty text has no words; a null doc_id counts as an empty string in the hash. Repeated rows count
again. An empty table gives an empty result. Words of any length are compared whole. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, give_back, id_and_text, kept, kept_and_counted
from .textcore import slices

RUNS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, MODULUS = 5, 3, 97
#: Words of a block that are compared with one another.
BLOCK = 64
#: Distinct words that a task counts before it sends them on, and code points of a matrix of words.
_HELD, _CELLS = 200_000, 1 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_counts(docs: DataFrame, modulus: int = MODULUS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: lower-cased runs of letters, one code point left out of those whose hash with their document's id `modulus` divides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = re.compile(RUNS).findall, Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in slices(batches, max_bytes=SLICE_BYTES):
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                begun = crc32(b":" if doc is None else b"%d:" % doc)
                for word, n in Counter(runs((raw or b"").translate(_FOLD).decode())).items():
                    h = crc32(word.encode(), begun)
                    if not h % modulus:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    held[word] += n
            if len(held) > _HELD:
                yield out()
        if held:
            yield out()
        give_back()

    counts = id_and_text(docs).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.char_length("word") >= least_length) & (F.col("n") >= least_count))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row (word, n, m, pre, suf) in the two blocks that halve the middle between what its block shares."""
    half = F.floor((F.col("m") - F.col("pre") - F.col("suf")) / 2).cast("int")
    forward = F.struct((F.col("pre") + half).alias("pre"), F.col("suf").alias("suf"))
    reversed_ = F.struct(F.col("pre").alias("pre"), (F.col("m") - F.col("pre") - half).alias("suf"))
    return _with_entry(rows.select("word", "n", "m", F.explode(F.array(forward, reversed_)).alias("s")).select("word", "n", "m", "s.pre", "s.suf"))


def _with_entry(rows: DataFrame) -> DataFrame:
    """Adds the entry that a word has in the dictionary: what it shares with its block from the front, and from the end read backwards."""
    front = F.substring(F.col("word"), F.lit(1), F.col("pre"))
    back = F.substring(F.reverse("word"), F.lit(1), F.col("suf"))
    return rows.withColumn("front", front).withColumn("back", back)


ENTRY = ["m", "front", "back"]


def near_in_blocks(words: np.ndarray, n: np.ndarray, m: int, pre: np.ndarray, suf: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many near words each word has in its block, and the best one's place (-1: none). Rows stand block by block; words have m or m - 1 code points.

    The last shared code points from the front and from the end say whether one edit is all that differs.
    """
    rows = len(words)
    text = np.array(words, f"<U{m}")
    left = text.view("<u4").reshape(rows, m)
    whole = np.char.str_len(text) == m
    right = np.where(whole[:, None], left, np.concatenate([np.zeros((rows, 1), "<u4"), left[:, :-1]], axis=1))
    order = np.lexsort((text, -n))
    rank = np.empty(rows, np.int64)
    rank[order] = np.arange(rows)
    count, best = np.zeros(rows, np.int64), np.full(rows, rows)
    d = 0
    live = np.arange(rows)
    while True:
        d += 1
        live = live[live + d < rows]
        live = live[block[live] == block[live + d]]
        if not len(live):
            break
        i = live[whole[live] | whole[live + d]]
        j = i + d
        differ = left[i] != left[j]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), m)
        differ = right[i][:, ::-1] != right[j][:, ::-1]
        last = np.where(differ.any(axis=1), differ.argmax(axis=1), m)
        near = (first + last >= m - 1) & (first < m - suf[i]) & (first >= pre[i])
        i, j = i[near], j[near]
        count[i] += 1
        count[j] += 1
        best[i] = np.minimum(best[i], rank[j])
        best[j] = np.minimum(best[j], rank[i])
    return count, np.append(order, -1)[best]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of their entries, a whole number of them at a time; what is left of a batch waits for the next."""

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        m, block = rows["m"].to_numpy(), _blocks(rows)
        width = np.maximum.accumulate(m)  # entries are sorted by m
        first = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(m)]])
        begin = 0
        for at in range(1, len(first)):
            more = at + 1 < len(first)
            if more and m[first[at]] == m[first[begin]] and (first[at + 1] - first[begin]) * int(width[first[at]]) <= _CELLS:
                continue
            part = rows.slice(first[begin], first[at] - first[begin])
            words, n = part["word"].to_numpy(), part["n"].to_numpy()
            count, best = near_in_blocks(words, n, int(m[first[begin]]), part["pre"].to_numpy(), part["suf"].to_numpy(), block[first[begin] : first[at]])
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(words[some], pa.string()), pa.array(count[some]), pa.array(n[best[some]]), pa.array(words[best[some]], pa.string())], ["word", "near", "best_n", "best"])
            begin = at

    left: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.Table.from_batches([*left, batch]).combine_chunks()
        block = _blocks(rows)
        cut = int(np.searchsorted(block, block[-1])) if len(block) else 0
        yield from found(rows.slice(0, cut)) if cut else ()
        left = rows.slice(cut).combine_chunks().to_batches()
    if left and sum(b.num_rows for b in left):
        yield from found(pa.Table.from_batches(left).combine_chunks())
    give_back()


def _blocks(rows: pa.Table) -> np.ndarray:
    """The number of each row's block among those of the table."""
    if not rows.num_rows:
        return np.zeros(0, np.int64)
    changes = np.zeros(rows.num_rows, bool)
    for c in ENTRY:
        values = rows[c].to_numpy()
        changes[1:] |= values[1:] != values[:-1]
    return np.cumsum(changes)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, form, form_n: of every word that has a near one. words (word, n) is a written table of distinct words.

    Rounds go on while a block is too large, at most as many as a middle can be halved.
    """
    length = F.char_length("word")
    roles = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("m"), F.lit(0).alias("pre"), F.lit(0).alias("suf"))
    rows = _halved(roles)
    found: DataFrame | None = None
    while True:
        large = rows.where("m - pre - suf > 1").groupBy(*ENTRY).agg(F.count("*").alias("size")).where(F.col("size") > block)
        marked = rows.join(large, ENTRY, "left")
        rows, counts = kept_and_counted(marked, large=F.sum(F.when(F.col("size").isNotNull(), 1).otherwise(0)))
        dictionary = rows.where("size is null").repartitionByRange(*ENTRY).sortWithinPartitions(*ENTRY, "word")
        part = dictionary.select("word", "n", "m", "pre", "suf", "front", "back").mapInArrow(_scan, "word string, near bigint, best_n bigint, best string")
        found = part if found is None else found.unionByName(part)
        if not counts["large"]:
            break
        rows = _halved(rows.where("size is not null"))
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.w").alias("form"), (-F.col("b.k")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow from a word. forms (word, form) has no cycle; each round doubles how far a word has come."""
    links = kept(forms.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step, counts = kept_and_counted(step, moved=F.sum(F.col("moved").cast("int")))
        links = step.select("word", "root")
        if not counts["moved"]:
            return links


def spelling_variants(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word: its form is its commonest near word (ties: the least), if that is at least twice as common."""
    words = kept(word_counts(docs))
    near = near_words(words, block)
    rows = kept(words.join(near, "word", "left").withColumn("near_n", F.coalesce("n_near", F.lit(0))))
    formed = F.col("form_n") >= 2 * F.col("n")
    forms = rows.select("word", "n", F.col("near_n").alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n"))
    ends = roots(forms.where("form is not null"))
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
