"""Media columns: texts stored as Matroska files, and files as packet tables.

Defined cases: a null or empty text is a payload of 64 zero bytes. Equal texts give equal files. A file
that is null or no Matroska has no packets and its error is told in a row of its own. Repeated
rows each get theirs; empty tables give empty results. Columns other than those named are not read.
"""

from __future__ import annotations

import struct
from hashlib import sha256
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, map_batches
from .matroska import feature, mux, parse, samples

UNIT = 64
PACKETS = "doc_id bigint, packet int, track int, time_ns bigint, offset bigint, size bigint, keyframe boolean, lacing int, error string"


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text as a file."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([mux(payload(t)) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "media"])

    return map_batches(id_and_text(docs), one, "doc_id bigint, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """PACKETS of rows (doc_id, media): a row for each packet, in file order."""

    def run(batches):
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    m, error = parse(raw or b""), None
                    columns = [m.track, m.time_ns, m.offset, m.size, m.key, m.lacing]
                except (ValueError, IndexError, struct.error) as e:
                    error, columns = str(e), [[None]] * 6
                n = len(columns[0])
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array([error] * n, pa.string())],
                    ["doc_id", "packet", "track", "time_ns", "offset", "size", "keyframe", "lacing", "error"],
                )

    return media.select("doc_id", "media").mapInArrow(run, PACKETS)


def media_digest(docs: DataFrame) -> DataFrame:
    """Each text written as a file and read back by its packet table."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            raw = mux(payload(text))
            m = parse(raw)
            stored = samples(raw, m)
            rows.append((len((text or "").encode()), len(stored), sha256(stored).hexdigest(), crc32(stored[-UNIT:]), len(raw), sha256(raw).hexdigest(), feature(m, stored)))
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    return map_batches(id_and_text(docs), one, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
