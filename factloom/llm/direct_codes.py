"""Directly addressable codes for token ids.

Each id is split into chunks of `width` bits. Level k holds the k-th chunk of every id
that has one, and a bitmap that says which of those ids go on at level k + 1. A rank
directory (ones before each 512-bit block) maps an id's place to its place one level
down, so any token is read in a constant number of steps without decoding a block.

A segment, all little-endian: magic, chunk width, level count, document count, token
count, then document ids (i8), document starts (i8, one more than documents), and for
each level its length (i8), chunks (u1 or u2), bitmap bytes and directory (u4).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, give_back, id_and_text, new_folder
from .exchange import steady
from .subwords import ID, ChunkEncoder, public_path

MAGIC = b"DACT0001"
_HEAD = struct.Struct("<8sBBHIQ")
_BLOCK = 512
SEGMENT_TOKENS = 1 << 20
END_ID = 0
_FILE = "part bigint, segment bigint, part_start bigint, tokens bigint, first_doc bigint, last_doc bigint, raw binary"


@dataclass
class Level:
    chunks: np.ndarray
    bitmap: np.ndarray  # bytes, little bit order
    directory: np.ndarray

    def more(self, i: int) -> bool:
        return bool(self.bitmap[i >> 3] >> (i & 7) & 1)

    def rank(self, i: int) -> int:
        """Ones before place i."""
        block = i // _BLOCK
        a, b = block * _BLOCK // 8, i >> 3
        ones = int(np.bitwise_count(self.bitmap[a:b]).sum())
        tail = int(self.bitmap[b]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(self.directory[block]) + ones + tail.bit_count()


@dataclass
class Segment:
    width: int
    docs: np.ndarray
    starts: np.ndarray
    levels: list[Level]

    @classmethod
    def of(cls, docs: np.ndarray, starts: np.ndarray, ids: np.ndarray, width: int = 8) -> Segment:
        levels, rest = [], ids.astype(np.uint32)
        while True:
            more = rest >> width > 0
            counts = np.add.reduceat(more, np.arange(0, len(more), _BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
            directory = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
            levels.append(Level((rest & ((1 << width) - 1)).astype("<u2" if width > 8 else "u1"), np.packbits(more, bitorder="little"), directory))
            if not more.any():
                return cls(width, docs.astype("<i8"), starts.astype("<i8"), levels)
            rest = rest[more] >> width

    def to_bytes(self) -> bytes:
        parts = [_HEAD.pack(MAGIC, self.width, len(self.levels), 0, len(self.docs), int(self.starts[-1])), self.docs.tobytes(), self.starts.tobytes()]
        for v in self.levels:
            parts += [struct.pack("<q", len(v.chunks)), v.chunks.tobytes(), v.bitmap.tobytes(), v.directory.tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Segment:
        magic, width, count, _, docs, tokens = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        at = _HEAD.size

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        ids, starts, levels = read("<i8", docs), read("<i8", docs + 1), []
        for _ in range(count):
            n = int(read("<i8", 1)[0])
            levels.append(Level(read("<u2" if width > 8 else "u1", n), read("u1", -(-n // 8)), read("<u4", -(-n // _BLOCK) + 1)))
        if int(starts[-1]) != tokens:
            raise ValueError("token count and document starts differ")
        return cls(width, ids, starts, levels)

    def access(self, i: int) -> int:
        """Token i alone."""
        value, shift = 0, 0
        for v in self.levels:
            value |= int(v.chunks[i]) << shift
            if not v.more(i):
                break
            i, shift = v.rank(i), shift + self.width
        return value

    def decode(self) -> np.ndarray:
        """All ids, from the last level up."""
        below = np.zeros(0, np.uint32)
        for v in reversed(self.levels):
            own = v.chunks.astype(np.uint32)
            more = np.unpackbits(v.bitmap, count=len(own), bitorder="little").astype(bool)
            own[more] |= below << np.uint32(self.width)
            below = own
        return below


def write_codes(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encodes every text and writes the segments, in ascending order of doc_id (null first, ties by row), below folder.

    Input that comes from a shuffle is written first, so that a repeated task numbers its rows as before. The files are rows of a Parquet table (part, segment, part_start, tokens, first_doc, last_doc, raw), so that any store Spark can
    write to will do. A segment holds about segment_tokens tokens, and a longer document alone.
    """
    path = path or public_path("byte_bpe_50k.json")
    end = np.array([end_id], ID).tobytes()
    spark = docs.sparkSession

    def run(batches):
        from pyspark import TaskContext

        from factloom.llm.textcore import slices

        encoder, part = ChunkEncoder.of(path, "byte"), TaskContext.get().partitionId()
        ids, held, number, start = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal number, start
            sizes = np.array([len(h) // 4 for h in held], np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            raw = Segment.of(np.array(ids, np.int64), starts, np.frombuffer(b"".join(held), ID)).to_bytes()
            numbers = [part, number, start, int(starts[-1]), ids[0], ids[-1]]
            out = pa.RecordBatch.from_arrays([*(pa.array([n], pa.int64()) for n in numbers), pa.array([raw], pa.binary())], _FILE.replace(" bigint", "").replace(" binary", "").split(", "))
            number, start = number + 1, start + int(starts[-1])
            ids.clear(), held.clear()
            return out

        size = 0
        for batch in slices(batches, max_bytes=SLICE_BYTES):
            for doc, own in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                ids.append(_NULL_ID if doc is None else doc), held.append(own + end)
                size += len(own) // 4 + 1
                if size >= segment_tokens:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        give_back()

    rows = steady(id_and_text(docs)).withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    ordered.mapInArrow(run, _FILE).write.parquet(folder)


#: How a null doc_id is written: the least 64-bit integer.
_NULL_ID = -(1 << 63)


def read_codes(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (tokens of all documents before), ids_crc32, n_tokens of each document, decoded from the files.

    One total a written part comes to the driver: as many numbers as the writing job had tasks.
    """
    files = spark.read.parquet(folder)
    before, total = {}, 0
    for part, tokens in sorted((r[0], r[1]) for r in files.groupBy("part").agg(F.sum("tokens")).collect()):
        before[part] = total
        total += tokens

    def run(batches):
        for batch in batches:
            for part, at, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = Segment.from_bytes(raw)
                ids, starts = s.decode().astype(ID).tobytes(), s.starts
                sums = [crc32(ids[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                base = before[part] + at
                docs = pa.array(s.docs, mask=s.docs == _NULL_ID)
                yield pa.RecordBatch.from_arrays([docs, pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "part_start", "raw").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokens_at(spark: SparkSession, folder: str, doc_id: int, places: list[int]) -> list[int]:
    """Single tokens of one document, which come to the driver, `places` times the rows of that id; by direct access, in a task that reads the segments whose range of ids has the document and decodes none."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                s = Segment.from_bytes(raw)
                for at in np.flatnonzero(s.docs == doc_id).tolist():
                    out = [s.access(int(s.starts[at]) + p) for p in places if s.starts[at] + p < s.starts[at + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["token"])

    near = spark.read.parquet(folder).where(F.lit(doc_id).between(F.col("first_doc"), F.col("last_doc")))
    return [r[0] for r in near.select("raw").mapInArrow(run, "token bigint").collect()]


def write_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Through files in a new folder of the shared one."""
    folder = new_folder(docs.sparkSession, "codes")
    write_codes(docs, folder, path)
    return read_codes(docs.sparkSession, folder)
