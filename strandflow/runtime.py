"""Where intermediate tables go.

Iterative operators cut their lineage by writing a table into the shared folder that the cluster names
in ``spark.checkpoint.dir`` and reading it back. A lost executor then costs a re-read, not a recomputation.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a local master where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
    os.makedirs(own, exist_ok=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def spread(df: DataFrame, *keys: str, rows: int = 500_000) -> DataFrame:
    """``df`` by ``keys`` in partitions of about that many rows each, so that what a task sorts does not grow with the table where the
    number of shuffle partitions stays as it is."""
    n = -(-df.count() // rows)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)


class Scratch:
    """A folder of intermediate tables below :func:`shared_dir`, removed when the driver ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._fs, at = self._hadoop(self.path)
        self._fs.mkdirs(at)
        self._fs.deleteOnExit(at)
        self._n = 0

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` as Parquet and return it as read back: same rows, no lineage, no known partitioning."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}_{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def save_counting(self, df: DataFrame, name: str, counted: Column) -> tuple[DataFrame, int]:
        """:meth:`save`, and how many of the rows fulfil ``counted``, taken while they are written. A task that runs again may count
        twice, so only 0 is exact."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        out = self.save(df.observe(seen, F.count_if(counted).alias("n")), name)
        return out, seen.get["n"]

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove tables of :meth:`save` that nothing reads any more."""
        for df in tables:
            if df is not None:
                self._fs.delete(self._hadoop(df._scratch_path)[1], True)
