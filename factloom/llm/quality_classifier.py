"""Quality classifier: a generalised additive model with pairwise interactions.

Text statistics are binned; cyclic boosting of shallow trees learns a lookup table for
each statistic and for the strongest pairs, and a document's score is the sum of its
table entries. Fitted on a bounded sample of labelled rows (common.FIT_ROWS) outside the
held-out quarter; scored in one map without a shuffle.

Defined cases: a null or empty text is scored by its zero statistics. Repeated rows get
equal results. An empty table gives an empty result; without labels every score is 0.5.
score_documents() reads doc_id and text alone. keep_documents() passes all columns
through unchanged, whatever their names, and rows with equal text are kept or dropped alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import FIT_ROWS, fitted_rows, id_and_text, labelled_texts, map_batches
from .gam import AdditiveModel
from .textcore import texts_of
from .textstats import features, statistics

THRESHOLD, MODULUS, HELD_OUT = 0.7, 4, 2


@dataclass
class QualityClassifier:
    model: AdditiveModel

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> QualityClassifier:
        return cls(AdditiveModel.fit(*fitted_rows(labelled_texts(docs, labels, "quality", MODULUS, HELD_OUT, bound))))

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.model.score(features(statistics(texts_of(texts))))

    def score_documents(self, docs: DataFrame) -> DataFrame:
        model = self

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = model.score(batch.column(1))
            held = [i is not None and crc32(str(i).encode()) % MODULUS == HELD_OUT for i in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return map_batches(id_and_text(docs), one, "doc_id bigint, held_out boolean, score double, predicted int")

    def keep_documents(self, docs: DataFrame) -> DataFrame:
        """The documents that score at least THRESHOLD, with all their columns."""
        model, at = self, docs.columns.index("text")

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(model.score(batch.column(at)) >= THRESHOLD))

        return map_batches(docs, one, docs.schema)
