"""Readers and writers with explicit schemas."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LABELLED = "url string, label int, tld string, p double"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it. Where it is unset, a temporary one, but only
    in a session of one process (tests): on a cluster each machine would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[[^,]*(,\d+)?\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def keep_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._kept_at = path
    return back


def drop_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop_table(df: DataFrame) -> None:
    """Delete a table made by :func:`keep_table` that nothing will read again."""
    path = getattr(df, "_kept_at", None)
    if path:
        drop_folder(df.sparkSession, path)


def load_csv(spark: SparkSession, path: str, schema: str | StructType = LABELLED) -> DataFrame:
    """A CSV file with a header; the schema is given, never inferred, and malformed rows fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=True)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """All splits in one table with the column ``split``."""
    return reduce(DataFrame.unionByName, (df.withColumn("split", F.lit(name)) for name, df in splits.items()))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_prior(prior: DataFrame, path: str) -> None:
    """A ``tld, p`` table; one file, as a prior has a row per top-level domain."""
    prior.coalesce(1).write.mode("overwrite").json(path)


def load_prior(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tld string, p double").json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_columns(model: PipelineModel) -> list[str]:
    """The columns that a fitted pipeline assembles, in their order."""
    return [c.removesuffix("_filled") for stage in model.stages if isinstance(stage, VectorAssembler) for c in stage.getInputCols()]


def require_columns(found: Sequence[str], expected: Sequence[str]) -> None:
    """Raise unless names, order and count agree."""
    if list(found) != list(expected):
        raise ValueError(f"the model expects {list(found)}")


def score_file(spark: SparkSession, source: str, model: PipelineModel, target: str, schema: str | StructType) -> None:
    """A CSV of features in, the same with ``prediction`` and ``prediction_text`` out."""
    rows = load_csv(spark, source, schema)
    out = model.transform(rows).select(*rows.columns, F.col("prediction").cast("int").alias("prediction"), F.when(F.col("prediction") == 1, "phishing").otherwise("legitimate").alias("prediction_text"))
    write_csv(out, target)
