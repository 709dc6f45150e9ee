"""SentencePiece encoding and decoding of document texts by streaming Viterbi.

Defined cases: a null or empty text has no ids and decodes to the empty text. A literal
U+2581 in a text is a space to the vocabulary, so it decodes to a space. Very long texts
without spaces are segmented in a window of bounded size. Repeated rows get equal rows.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, map_batches
from .streaming_viterbi import ID, SPACE, SentencePieces
from .subwords import public_path


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids."""
    path = path or public_path("piece_bpe_32k.model")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = SentencePieces.of(path).encode([t or "" for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(i, ID).astype(np.int32) for i in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(id_and_text(docs), one, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""
    path = path or public_path("piece_bpe_32k.model")

    def run(batches):
        for batch in batches:
            model = SentencePieces.of(path)
            texts = [model.decode(np.array(i or [], ID).tobytes()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def encoding_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32, n_decoded (code points of the decoded text), round_trip (it equals the text, U+2581 read as space)."""
    path = path or public_path("piece_bpe_32k.model")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, texts = SentencePieces.of(path), [t or "" for t in batch.column(1).to_pylist()]
        rows = []
        for text, ids in zip(texts, model.encode(texts), strict=True):
            back = model.decode(ids)
            rows.append((len(ids) // 4, crc32(ids), len(back), back == text.replace(SPACE, " ")))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_ids", "ids_crc32", "n_decoded", "round_trip"])

    return map_batches(id_and_text(docs), one, "doc_id bigint, n_ids bigint, ids_crc32 bigint, n_decoded bigint, round_trip boolean")
