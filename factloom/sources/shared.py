"""Checkpoints and tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _ensure_folder(spark: SparkSession) -> None:
    """spark.checkpoint.dir; a temporary folder only where that is unset and all runs on one machine, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="factloom-"))


def kept(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder."""
    _ensure_folder(df.sparkSession)
    return df.checkpoint()


#: Whether Spark deletes the files of a query's shuffles when it ends, instead of some time after its plan is garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stored:
    """A table written once below spark.checkpoint.dir. Unlike a checkpoint it computes its plan once; rows is how many were written.

    Nothing reads the shuffles behind it again, so their files go as soon as it is written: that setting holds while it is, and is then as before.
    """

    def __init__(self, df: DataFrame) -> None:
        spark, seen = df.sparkSession, Observation()
        _ensure_folder(spark)
        self.path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid4().hex}"
        before = spark.conf.get(_CLEANUP, "false")
        spark.conf.set(_CLEANUP, "true")
        try:
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(self.path)
        finally:
            spark.conf.set(_CLEANUP, before)
        self.frame = spark.read.schema(df.schema).parquet(self.path)
        self.rows = int(seen.get["n"])

    def drop(self) -> None:
        """Deletes it; nothing that reads it may be computed afterwards."""
        spark = self.frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
