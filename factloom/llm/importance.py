"""Importance resampling towards a target distribution, by hashed runs of words.

Each task counts its documents in a trie of its own (word_trie.py), whose nodes hold how often their run was seen and the CRC
that gives its bucket. A trie that outgrows NODES is added to the task's bucket counts and begun anew, so memory is bounded; a
task sends one row a bucket. Totals of raw and target make one gain a bucket, an array of `buckets` numbers that every
task of the second pass gets; that pass walks each document's paths through a trie whose nodes have their gain attached.
The draw is a range-partitioned sort of three numbers a document; no task sees all.

Defined cases: a null or empty text has no feature and weight 0. A null doc_id is hashed as an empty string and comes after
all others in ties. Rows of equal id and text score alike and are ranked one after another. Empty tables give an empty result;
with an empty target every gain is that of t = T = 0. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, give_back, id_and_text, kept, kept_and_counted
from .textcore import slices
from .word_trie import WordTrie, words_of

BUCKETS, SEED, SHARE, LEAST_WORDS = 10_000, 2024, 10, 20
#: Nodes of a task's trie.
NODES = 1 << 18


def bucket_counts(docs: DataFrame, words: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of up to `words` words fall in each bucket, over all rows. What comes to the driver is `buckets` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trie, count = np.zeros(buckets, np.int64), WordTrie(words), np.zeros(0, np.int64)

        def add() -> None:
            if len(count):
                total[:] += np.bincount(trie.states()[: len(count)] % buckets, count, buckets).astype(np.int64)

        for batch in slices(batches, max_bytes=SLICE_BYTES):
            levels = trie.walk(words_of(batch.column(0)))
            seen = np.bincount(np.concatenate([nodes for nodes, _ in levels]), minlength=len(trie))
            seen[: len(count)] += count
            count = seen
            if len(trie) > NODES:
                add()
                trie, count = WordTrie(words), np.zeros(0, np.int64)
        add()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])
        give_back()

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for b, n in rows.collect():
        out[b] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the smoothed raw share) of each bucket."""
    n, all_raw, all_target = len(raw), int(raw.sum()), int(target.sum())
    return np.array([floor(1000 * log((t + 1) * (all_raw + n) / ((s + 1) * (all_target + n)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, words: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight: the sum of gains over a document's runs of up to `words` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, attached = WordTrie(words), np.zeros(0, np.int64)
        for batch in slices(batches, max_bytes=SLICE_BYTES):
            levels = trie.walk(words_of(batch.column(1)))
            attached = np.concatenate([attached, gain[np.array(trie.state[len(attached) :], np.int64) % len(gain)]])
            weight, features = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for nodes, sizes in levels:
                sums = np.concatenate([[0], np.cumsum(attached[nodes])])
                ends = np.cumsum(sizes)
                weight += sums[ends] - sums[ends - sizes]
                features += sizes
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(levels[0][1]), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])
            if len(trie) > NODES:
                trie, attached = WordTrie(words), np.zeros(0, np.int64)
        give_back()

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def ranked(rows: DataFrame, quota: int) -> DataFrame:
    """Adds rank, 1 to quota by falling score, then doc_id (null last), then row; null beyond quota. rows is a written table.

    Rows are dealt by ranges of that order, numbered within each range, and a range's first number is the sum of the sizes before it: as many numbers as ranges come to the driver.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    dealt = kept(rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("part")))
    before, total = [], 0
    for part, n in sorted(map(tuple, dealt.groupBy("part").count().collect())):
        before.append((part, total))
        total += n
    if not before:
        return rows.withColumn("rank", F.lit(None).cast("bigint"))
    first = F.broadcast(rows.sparkSession.createDataFrame(before, "part int, first bigint"))  # a row a range
    at = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.join(first, "part").withColumn("at", at).withColumn("rank", F.when(F.col("at") <= quota, F.col("at"))).drop("part", "first", "at")


def resample(docs: DataFrame, target: DataFrame, words: int = 1, buckets: int = BUCKETS, seed: int = SEED, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank: every document, and the drawn `share` percent of those with enough words numbered by score.

    score is the weight and Gumbel noise of the id's hash, so that the highest scores are a draw without replacement in proportion to exp(weight / 1000).
    """
    gain = gains(bucket_counts(docs, words, buckets), bucket_counts(target, words, buckets))
    h = F.conv(F.substring(F.sha2(F.concat_ws("", F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weights(docs, gain, words).withColumn("score", (F.col("weight") + noise).cast("bigint")).withColumn("row", F.monotonically_increasing_id())
    enough = F.col("n_words") >= least_words
    rows, counts = kept_and_counted(scored, enough=F.sum(F.when(enough, 1).otherwise(0)))
    drawn = ranked(rows.where(enough), share * counts["enough"] // 100)
    rest = rows.where(~enough).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
