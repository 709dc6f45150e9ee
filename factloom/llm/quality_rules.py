"""Quality rules: an isolation forest on rule statistics.

Each document gets rule statistics (counts over its whole text). The forest grows random
splits over the statistics of labelled good rows; documents outside their range end in
empty boxes after few splits. One map over the documents writes their statistics, and
texts are never shuffled. The statistics' box, and the threshold on the path-length score,
come from all labelled rows: their scores are counted in BINS steps. Each tree grows on its
own draw of rows, as the method has it; every good row has an equal chance, and those that
trees draw from are about DRAWN rows by the hash of their id, or all if there are fewer.

Defined cases: a null or empty text has zero counts and fails the base rules. Repeated
rows each get their own, equal result. An empty table gives an empty result. Without
labels the forest rejects nothing and the base rules alone decide. Columns other than
doc_id and text are neither read nor returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, kept, kept_and_counted, label_rows, map_batches
from .iforest import IsolationForest, calibrate_counts
from .textcore import texts_of
from .textstats import FEATURES, features, statistics

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The statistics that the forest splits on.
RULES = ("chars_per_word", "symbol_rate", "upper_rate", "bang_rate", "pipe_rate", "dup_line_rate", "repeat_rate", "distinct_rate")
_COLUMNS = [FEATURES.index(r) for r in RULES]


def _rules(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x[:, _COLUMNS])


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


#: Rows that trees draw from, and steps of the score that labelled rows are counted in.
DRAWN, BINS = 128 * 1024, 1 << 20
_HASHES = 1 << 31


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and x, the statistics that the forest splits on, a row for each document, written once."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = statistics(texts_of(batch.column(1)))
        x = pa.FixedSizeListArray.from_arrays(pa.array(_rules(features(s)).ravel()), len(RULES)).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s[c].astype(np.int64)) for c in COUNTS), x], ["doc_id", *COUNTS, "x"])

    return kept(map_batches(id_and_text(docs), one, f"doc_id bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, x array<double>"))


def _matrix(x: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(pc.list_flatten(x), float).reshape(-1, len(RULES))


def _map(rows: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Applies fn to batches of statistics, which have no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(fn, batches)

    return rows.mapInArrow(run, schema)


@dataclass
class QualityRules:
    forest: IsolationForest
    threshold: float

    @classmethod
    def fit(cls, stats: DataFrame, labels: DataFrame, trees: int = 128, subsample: int = 1024, drawn: int = DRAWN) -> QualityRules:
        """stats: doc_id and x, as measured() gives them."""
        ends = [f(F.get("x", F.lit(i))).alias(f"{n}{i}") for n, f in (("a", F.min), ("b", F.max)) for i in range(len(RULES))]
        rows, seen = kept_and_counted(stats.select("doc_id", "x").join(label_rows(labels, "quality", 4, 2), "doc_id"), good=F.count_if(F.col("y") == 1))
        if not seen["n"]:
            return cls(IsolationForest.fit(np.zeros((0, len(RULES)))), 1.0)
        box = np.array(rows.agg(*ends).first(), float).reshape(2, -1)
        cut = min(_HASHES, -(-_HASHES * drawn // max(seen["good"], 1)))
        drawn_rows = rows.where((F.col("y") == 1) & (F.pmod(F.xxhash64("doc_id"), F.lit(_HASHES)) < cut)).toArrow()
        x = _matrix(drawn_rows["x"])
        x = x[np.lexsort((*x.T, drawn_rows["doc_id"].to_numpy()))]
        forest = IsolationForest.fit(x, box=box, trees=trees, subsample=subsample)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(_steps(forest.score(_matrix(batch.column(1)))))], ["y", "step"])

        counts = _map(rows.select("y", "x"), one, "y int, step int").groupBy("step").agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") != 1).alias("bad")).orderBy("step").toArrow()
        step = calibrate_counts(*(counts[c].to_numpy() for c in ("step", "good", "bad")))
        return cls(forest, (step + 1) / BINS if step is not None else 1.0)

    def apply(self, stats: DataFrame) -> DataFrame:
        """doc_id, the counts, base_failed, anomaly (path-length score) and kept, a row for each row of measured()."""
        model = self

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = {c: batch.column(1 + i).to_numpy() for i, c in enumerate(COUNTS)}
            failed, score = base_failed(s), model.forest.score(_matrix(batch.column(1 + len(COUNTS))))
            columns = [*(batch.column(i) for i in range(1 + len(COUNTS))), pa.array(failed), pa.array(score), pa.array(~failed & (score <= model.threshold))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "anomaly", "kept"])

        return _map(stats, one, f"doc_id bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean, anomaly double, kept boolean")


def _steps(score: np.ndarray) -> np.ndarray:
    """Which of BINS steps from 0 to 1 a score lies in; one at its upper edge is in it, as kept rows are at or below the threshold."""
    return np.maximum(np.ceil(score * BINS) - 1, 0).astype(np.int32)


def score_quality_rules(docs: DataFrame, labels: DataFrame, **fit: int) -> DataFrame:
    stats = measured(docs)
    return QualityRules.fit(stats, labels, **fit).apply(stats)
