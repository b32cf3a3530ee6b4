"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The shared folder named by the session. Where it is unset, a temporary one of our own, but only in a session of one
    process (tests): on a cluster each machine would write to its own disk."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not found:
        if not re.match(r"local(\[[^,]*(,\d+)?\])?$", spark.sparkContext.master):
            raise ValueError(f"{KEY} has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def drop(*frames: DataFrame) -> None:
    """Delete tables made by :func:`keep` that nothing will read again."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
