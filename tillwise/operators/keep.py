"""Intermediate results that several steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names (``spark.checkpoint.dir``), which all executors
    share. Only a local session without such a folder gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tillwise-"))
    return context.getCheckpointDir()


def keep_small(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and let every later step read that result.

    It goes to the shared folder, so it outlives lost executors and, unlike a cached plan, never
    answers for files that have changed since.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame) -> DataFrame:
    """As ``keep_small``, for many rows: written as Parquet, which is columnar and compressed."""
    path = f"{_shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
