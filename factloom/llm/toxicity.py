"""Toxicity: a subsequence string-kernel machine over whole texts.

Fitted on a bounded sample of labelled texts (FIT_TEXTS) outside the held-out fifth; scored in one map.

Defined cases: a null or empty text has no sentence and scores by the machine's bias, as does one without a letter or digit. Repeated
rows get equal results. An empty table gives an empty result; without labels of both kinds every score is
one constant under 0.5. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, labelled_texts, map_batches
from .string_kernel import StringKernelMachine, fit
from .textcore import texts_of

THRESHOLD, MODULUS, HELD_OUT = 0.5, 5, 0
#: Labelled texts that the machine is fitted on, at most. They come to one task.
FIT_TEXTS = 6_000
_SAMPLE = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("text", pa.string())])


@dataclass
class Toxicity:
    machine: StringKernelMachine

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, bound: int = FIT_TEXTS) -> Toxicity:
        """The sample is bounded and goes to one task, which sends back the machine alone."""
        sample = labelled_texts(docs, labels, "toxic", MODULUS, HELD_OUT, bound)

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(batches, _SAMPLE).sort_by([("doc_id", "ascending"), ("text", "ascending")])
            machine = fit(texts_of(rows["text"].combine_chunks()), rows["y"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(machine)], pa.binary())], ["machine"])

        raw = sample.repartition(1).mapInArrow(train, "machine binary").first()
        return cls(pickle.loads(raw[0]) if raw else fit(texts_of(pa.array([], pa.string())), np.zeros(0, int)))

    def score_documents(self, docs: DataFrame) -> DataFrame:
        """doc_id, held_out, score, predicted."""
        machine = self.machine

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = machine.score(texts_of(batch.column(1)))
            held = [i is not None and crc32(str(i).encode()) % MODULUS == HELD_OUT for i in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return map_batches(id_and_text(docs), one, "doc_id bigint, held_out boolean, score double, predicted int")
