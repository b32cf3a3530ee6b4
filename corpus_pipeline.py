"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read back for the next.

1. ``quality_rules`` drops the documents that the base rules or the calibrated model reject.
2. ``line_dedup`` drops lines found in many documents; a document keeps its other lines.
3. ``ngram_join`` keeps one document of each group of near duplicates, the one of the least id.
4. ``decontaminate`` drops documents that share a window of words with a benchmark item.
5. ``packing`` cuts what is left into token sequences of power-of-two lengths.

All stages but the last return the columns of ``documents``; ``n_chars`` follows the text.  Defined results: a row with a null
id goes through each stage like others and is the least of its group only if all ids in it are null; repeated rows are near
duplicates of each other, and one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules, scratch


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.quality_rules(docs, labels).where("kept").select(*docs.columns)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.line_dedup(docs)
    return cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark).where("not contaminated").select(*docs.columns)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("quality_rules", _quality),
    ("line_dedup", _lines),
    ("ngram_join", _near),
    ("decontaminate", _decontaminate),
    ("packing", _pack),
]

#: The model's verdicts and the tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
