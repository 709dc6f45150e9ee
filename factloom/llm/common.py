"""What the operators share: reading, Arrow maps, labelled samples, the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most; the rows with the least hash of their id are taken.
FIT_ROWS = 20_000
#: Row groups of kept tables: what a task buffers as it writes one.
BLOCK_BYTES = 16 << 20
#: Text that a function of map_batches() sees at a time; a longer text is alone.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> None:
    """Makes sure of a shared folder: the cluster's spark.checkpoint.dir, or a temporary folder where it is unset and all runs on one machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="factloom-"))


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder below the shared one, known to release()."""
    shared_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid4().hex}"
    _written.append(folder)
    return folder


#: Folders that this process has written below the shared one.
_written: list[str] = []


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes what kept() and other writers here have written so far; results that weren't read yet are lost with it.

    since: how many folders to leave, as counted by written() before."""
    while len(_written) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_all_but_last(spark: SparkSession, since: int) -> None:
    """Deletes what has been written since, but for the last folder."""
    last = _written.pop()
    release(spark, since)
    _written.append(last)


def written() -> int:
    return len(_written)


def kept(df: DataFrame) -> DataFrame:
    """A table in the shared folder: later steps read it, and lost executors lose nothing of it. Unlike checkpoint(), it computes df once."""
    return kept_and_counted(df)[0]


def kept_and_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """The same, with sums over its rows that are taken while it is written; n is their number."""
    spark, seen = df.sparkSession, Observation()
    folder = new_folder(spark, "kept")
    sums = [F.count(F.lit(1)).alias("n"), *(c.alias(name) for name, c in counts.items())]
    df.observe(seen, *sums).write.option("parquet.block.size", BLOCK_BYTES).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), {k: int(v or 0) for k, v in seen.get.items()}


def clear_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for added columns that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while f"__{name}" in taken:
            name += "_"
        out.append(f"__{name}")
    return out


def give_back() -> None:
    """Returns freed memory to the system, so that Python workers that wait for their next task don't hold it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, slice_bytes: int = SLICE_BYTES, done: Callable[[], None] | None = None) -> DataFrame:
    """Applies fn to slices of bounded text size. done: called at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factloom.llm.textcore import slices

        for batch in slices(batches, max_bytes=slice_bytes):
            if (out := fn(batch)) is not None:
                yield out
        if done:
            done()
        give_back()

    return df.mapInArrow(run, schema)


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def remainder(column: str, modulus: int) -> F.Column:
    return F.crc32(F.col(column).cast("string")) % modulus


def label_rows(labels: DataFrame, label: str, modulus: int, held_out: int) -> DataFrame:
    """(doc_id, y) of all labelled rows outside the held-out remainder. Rows with a null id or label are no labels. Contradicting labels of one id all count."""
    ids = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    return ids.where(remainder("doc_id", modulus) != held_out)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, bound: int = FIT_ROWS) -> DataFrame:
    """(doc_id, y, text) of at most `bound` labelled rows outside the held-out remainder.

    Rows with a null id or label are no labels. Contradicting labels of one id all count.
    The sample is broadcast: it has `bound` rows of two numbers at most.
    """
    ids = label_rows(labels, label, modulus, held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return id_and_text(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text")


def fitted_rows(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample, in an order that doesn't hang on the run."""
    from factloom.llm.textcore import texts_of
    from factloom.llm.textstats import FEATURES, features, statistics

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(statistics(texts_of(batch.column(2))))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = map_batches(sample, one, "doc_id bigint, y int, x array<double>").toArrow()
    if not rows.num_rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0, int)
    x = np.array(rows["x"].to_pylist(), float)
    y = rows["y"].to_numpy()
    order = np.lexsort((*x.T, y, rows["doc_id"].to_numpy()))
    return x[order], y[order]
