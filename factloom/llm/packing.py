"""Best-fit packing: documents as token sequences, by bin completion.

Texts are tokenised in one map; only spans (document, piece, start, length, checksum)
are shuffled. Pieces are dealt evenly by their row's number to groups of bounded size,
each of which is packed by bin_completion; what lies in bins that stayed emptier than
OPEN_TOKENS is packed once more, in groups of the same size drawn from all first groups.

Defined cases: a null or empty text is one end token. Repeated rows are packed each for
itself. An empty table gives an empty result. Long documents are cut at the capacity
and their last piece may be shorter. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bin_completion import place
from .common import id_and_text, kept, map_batches
from .subwords import ID, ChunkEncoder, public_path

CAPACITY, END_ID = 4096, 1
GROUP_PIECES = 32_768
OPEN_TOKENS = 16


def tokenised_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""
    path = path or public_path("word_bpe_49k.json")
    end = np.array([end_id], ID).tobytes()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = ChunkEncoder.of(path, "word")
        rows: list[tuple] = []
        for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
            ids += end
            for piece, a in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[a : a + 4 * capacity]
                rows.append((doc, piece, a // 4, len(own) // 4, crc32(own), own if with_ids else None))
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        keep = 6 if with_ids else 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:keep], kinds, strict=False)], names[:keep])

    return map_batches(id_and_text(docs), one, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def _pack(pieces: DataFrame, groups: int, capacity: int, level: int) -> DataFrame:
    """Adds sequence_id, offset and room (what its sequence has left); takes and keeps all other columns."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        bin_of, offset, used = place(group["length"].to_numpy(), capacity)
        group = group.drop(columns=["grp", *(c for c in ("sequence_id", "offset", "room") if c in group)])
        number = (int(level) << 62) | (int(solve.at) << 24)
        return group.assign(sequence_id=number + bin_of, offset=offset, room=capacity - used[bin_of])

    def grouped(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        solve.at = int(key[0])
        return solve(group.sort_values(["length", "doc_id", "piece", "row"], kind="stable"))

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, row bigint, sequence_id bigint, offset bigint, room bigint"
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(grouped, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece."""
    pieces = kept(tokenised_pieces(docs, path, capacity, end_id).withColumn("row", F.monotonically_increasing_id()))
    first = kept(_pack(pieces, max(1, -(-pieces.count() // group_pieces)), capacity, 0))
    loose = first.where(F.col("room") >= OPEN_TOKENS)
    again = _pack(loose, max(1, -(-loose.count() // group_pieces)), capacity, 1)
    return first.where(F.col("room") < OPEN_TOKENS).unionByName(again).drop("room", "row")


def sequences(docs: DataFrame, packed: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """sequence_id, ids: each packed sequence's token ids as an array, for training input.

    Rows of one doc_id must be one document here.
    """
    pieces = tokenised_pieces(docs, path, capacity, end_id, with_ids=True).select("doc_id", "piece", "ids")
    rows = pieces.join(packed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(group.sort_values("offset")["ids"]), ID)
        return pd.DataFrame({"sequence_id": [group["sequence_id"].iloc[0]], "ids": [ids.astype(np.int64)]})

    return rows.groupBy("sequence_id").applyInPandas(join, "sequence_id bigint, ids array<bigint>")
