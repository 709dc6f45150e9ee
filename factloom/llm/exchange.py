"""Questions from chunks of documents to ranges of a hash space, and the answers back.

A map task turns a chunk into one object that stays with the chunk and one object for each
range that it has something to ask of. A range's task sees the objects of all chunks at once and
answers those that it has an answer for; then the chunk's own object and its answers meet. Rows are packed binaries, so
that the shuffle moves a few large rows instead of one for each hash.

With more than DIRECT ranges, chunks deal to groups of ranges, about the square root of their number, and tasks in between
gather what many chunks have for a group before they deal it to the group's ranges, so that the rows stay in
proportion to the input instead of chunks times ranges.

A chunk is known by a hash of its rows. If a repeated task cuts its rows into other chunks, answers would find no
chunk; that raises an error, and steady() keeps it from happening.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, give_back, kept, map_batches
from .packed import expand, squeeze  # noqa: F401
from .textcore import U64, texts_of

_ROW = "chunk bigint, at bigint, raw binary"
_NAMES = ["chunk", "at", "raw"]
#: More ranges than these are dealt to in two steps.
DIRECT = 512
#: What a task in between gathers before it deals on.
GATHER_BYTES = 16 << 20


def steady(df: DataFrame) -> DataFrame:
    """df, or a checkpoint of it where a repeated task might see its rows in another order: past any shuffle."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    moves = r"^[\s:+\-]*(\w*Join|Aggregate|Repartition\w*|RebalancePartitions|Sort|Window\w*|Deduplicate|\w*Limit|\w*(Groups|CoGroup)\w*)\b"
    return kept(df) if re.search(moves, plan, re.MULTILINE) else df


def chunk_number(batch: pa.RecordBatch) -> int:
    """A hash of the rows, in their order."""
    h = xxhash.xxh3_64(str(batch.num_rows))
    for column in batch.columns:
        h.update(np.packbits(np.asarray(column.is_null().to_numpy(zero_copy_only=False))).tobytes())
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            t = texts_of(column)
            h.update(t.offs.tobytes()), h.update(np.ascontiguousarray(t.data))
        elif pa.types.is_binary(column.type):
            for raw in column.to_pylist():
                h.update(raw or b"")
        else:
            h.update(column.fill_null(0).to_numpy(zero_copy_only=False).tobytes())
    return h.intdigest() >> 1


def lot_of(key: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each key, by its upper half; ascending with the keys."""
    return ((key >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)


def cuts(lot: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of equal values of an ascending array."""
    at, begin = np.unique(lot, return_index=True)
    for r, a, b in zip(at.tolist(), begin.tolist(), [*begin.tolist(), len(lot)][1:], strict=True):
        yield r, slice(a, b)


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    chunk, at, raw = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(at, pa.int64()), pa.array(raw, pa.binary())], _NAMES)


def _deal_on(dealt: DataFrame, tasks: int) -> DataFrame:
    """Rows for groups of ranges made rows for ranges, each of what many chunks have for it."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)
        size = 0

        def flush() -> pa.RecordBatch:
            out = _rows([(-1, r, pickle.dumps(x, protocol=5)) for r, x in sorted(held.items())])
            held.clear()
            return out

        for batch in batches:
            for chunk, at, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at < 0:
                    yield _rows([(chunk, at, raw)])
                    continue
                for r, asked in pickle.loads(raw).items():
                    held[r] += asked
                size += len(raw)
                if size > GATHER_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return dealt.repartition(tasks, "at", F.pmod(F.xxhash64("chunk"), F.lit(8))).mapInArrow(gather, _ROW)


def exchange(
    df: DataFrame,
    ranges: int,
    deal: Callable[[pa.RecordBatch], Any],
    answer: Callable[[int, list[Any]], list[Any]],
    gather: Callable[[Any, list[Any]], pd.DataFrame],
    schema: str,
    own: Callable[[pa.RecordBatch], Any] | None = None,
    direct: int = DIRECT,
    alone: bool = False,
) -> DataFrame:
    """deal: a chunk's own object and its questions by range; answer: of a range and its questions, an answer to each or None;
    gather: rows of `schema` from the chunk's own object and its answers. own: makes the own object in a second pass over df, so that a large one
    passes one shuffle instead of two; deal gives the questions alone then. alone: each row is a chunk, so that their order doesn't matter."""
    df, size = (df, 0) if alone else (steady(df), SLICE_BYTES)
    groups = int(np.ceil(np.sqrt(ranges)))
    wide = -(-ranges // groups)

    def dealt(batch: pa.RecordBatch) -> pa.RecordBatch:
        chunk = chunk_number(batch)
        stays, asked = deal(batch) if own is None else (None, deal(batch))
        rows = [(chunk, -1, pickle.dumps(stays, protocol=5))] if own is None else []
        if ranges <= direct:
            return _rows(rows + [(chunk, r, pickle.dumps([(chunk, x)], protocol=5)) for r, x in asked.items()])
        by_group: dict[int, dict] = defaultdict(dict)
        for r, x in asked.items():
            by_group[r // wide][r] = [(chunk, x)]
        return _rows(rows + [(chunk, g, pickle.dumps(x, protocol=5)) for g, x in by_group.items()])

    def owned(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _rows([(chunk_number(batch), -1, pickle.dumps(own(batch), protocol=5))])

    def answered(group: pd.DataFrame) -> pd.DataFrame:
        at = int(group["at"].iloc[0])
        if at < 0:
            return group[_NAMES]
        asked = [x for raw in group["raw"] for x in pickle.loads(raw)]
        replies = answer(at, [x for _, x in asked])
        rows = [(chunk, at, pickle.dumps(r, protocol=5)) for (chunk, _), r in zip(asked, replies, strict=True) if r is not None]
        del asked, replies
        give_back()
        return pd.DataFrame({c: [r[i] for r in rows] for i, c in enumerate(_NAMES)}, columns=_NAMES)

    def gathered(group: pd.DataFrame) -> pd.DataFrame:
        stays = (group["at"] < 0).to_numpy()
        if not stays.any():
            raise RuntimeError("a repeated task cut its rows into other chunks: keep the input in a table first")
        replies = dict(zip(group["at"][~stays], group["raw"][~stays], strict=True))  # equal chunks have equal answers
        answers = [pickle.loads(raw) for _, raw in sorted(replies.items())]
        found = [gather(pickle.loads(raw), answers) for raw in group["raw"][stays]]
        del replies, answers
        give_back()
        return pd.concat(found, ignore_index=True) if len(found) > 1 else found[0]

    asked = map_batches(df, dealt, _ROW, size)
    if ranges > direct:
        asked = _deal_on(asked, 2 * groups)
    # what stays with its chunk passes the ranges by, in lots of its own
    lot = F.when(F.col("at") < 0, F.pmod(F.xxhash64("chunk"), F.lit(ranges)) - ranges - 1).otherwise(F.col("at"))
    back = asked.withColumn("lot", lot).groupBy("lot").applyInPandas(answered, _ROW)
    if own is not None:
        back = back.unionByName(map_batches(df, owned, _ROW, size))
    return back.groupBy("chunk").applyInPandas(gathered, schema)
