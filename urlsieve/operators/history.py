"""Scan history: records, pages, counts and daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.functions import url as u
from urlsieve.sources.tables import drop_folder, drop_table, keep_table

PREDICTIONS, RISKS, SOURCES = ("Safe", "Suspicious", "Phishing"), ("Low", "Medium", "High"), ("web", "extension", "api")
SUMMARY = ("id", "scanned_at", "url", "prediction", "risk_level", "confidence", "source")
SCHEMA = (
    "id long, scanned_at timestamp, url string, normalized_url string, prediction string, risk_level string, confidence double, source string, "
    "host string, phishing_probability double, model_version string, processing_ms double, features map<string,double>, "
    "indicators array<struct<severity:string,source:string,key:string,message:string>>"
)


def record(scans: DataFrame) -> DataFrame:
    """Rows to store: both urls redacted and cut to their column's length, the host cut to 255 characters."""
    return scans.withColumns({"url": F.substring(u.redact(F.col("url")), 1, 2048), "normalized_url": F.substring(u.redact(F.col("normalized_url")), 1, 2048), "host": F.substring("host", 1, 255)})


def append(scans: DataFrame, path: str) -> None:
    """Append to a Parquet table partitioned by day."""
    scans.withColumn("day", F.to_date("scanned_at")).write.mode("append").partitionBy("day").parquet(path)


def upgrade(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows and new ones in one table; columns that old rows lack are null."""
    return new.unionByName(old, allowMissingColumns=True)


def constraints(scans: DataFrame) -> DataFrame:
    """``scans`` with ``violation``: the first constraint a row breaks, null for a valid row."""
    bad = lambda c, allowed: F.coalesce(~F.col(c).isin(*allowed), F.lit(True))
    return scans.withColumn(
        "violation",
        F.when(F.col("scanned_at").isNull() | F.col("url").isNull(), "not null").when(bad("prediction", PREDICTIONS), "prediction").when(bad("risk_level", RISKS), "risk_level").when(bad("source", SOURCES), "source"),
    )


def page(scans: DataFrame, number: int, limit: int, prediction: str | None = None, search: str | None = None) -> DataFrame:
    """One page of summaries, newest first. ``search`` is literal text in url or host, in any case."""
    return matching(scans, prediction, search).orderBy(F.desc("id")).offset((number - 1) * limit).limit(limit).select(*(c for c in SUMMARY if c in scans.columns))


def page_after(scans: DataFrame, last_id: int, limit: int) -> DataFrame:
    """The page after ``last_id``: what deep pages should use, as it reads no rows to skip them."""
    return scans.where(F.col("id") < last_id).orderBy(F.desc("id")).limit(limit)


def matching(scans: DataFrame, prediction: str | None = None, search: str | None = None) -> DataFrame:
    if prediction is not None:
        if prediction not in PREDICTIONS:
            raise ValueError("unknown prediction")
        scans = scans.where(F.col("prediction") == prediction)
    if search:
        found = lambda c: F.lower(c).contains(search.lower())
        scans = scans.where(found("url") | F.coalesce(found("host"), F.lit(False)))
    return scans


def page_totals(scans: DataFrame, limit: int, prediction: str | None = None, search: str | None = None) -> DataFrame:
    return matching(scans, prediction, search).agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / limit).alias("pages"))


def delete(scans: DataFrame, ids: DataFrame) -> DataFrame:
    """What stays after the rows of ``ids`` go."""
    return scans.join(ids.select("id"), "id", "left_anti")


def rewrite_without(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Delete the rows of ``ids`` from a table of :func:`append`: one row ``deleted, kept, days`` (rows of the whole table; days that
    were touched).  Only days that hold such rows are written anew, first to a table of their own; the others keep their files."""
    rows, gone = spark.read.parquet(path), ids.select("id").where("id is not null").distinct()
    hit = rows.join(gone, "id", "left_semi").groupBy("day").agg(F.count("*").alias("deleted")).collect()  # a row for each day
    days = [r["day"] for r in hit]
    touched = rows.where(F.col("day").isin(days)) if None not in days else rows.where(F.col("day").isNull() | F.col("day").isin([d for d in days if d]))
    deleted, total = sum(r["deleted"] for r in hit), rows.count()
    if days:
        left = keep_table(touched.join(gone, "id", "left_anti").select(*rows.columns), "history-left")
        still = {r["day"] for r in left.select("day").distinct().collect()}
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        for day in set(days) - still:  # a day without rows is not written, so its folder goes
            drop_folder(spark, f"{path}/day={day if day is not None else '__HIVE_DEFAULT_PARTITION__'}")
        drop_table(left)
    return spark.createDataFrame([(deleted, total - deleted, len(days))], "deleted long, kept long, days int")


def counts(scans: DataFrame) -> DataFrame:
    """``kind, value, n`` of all predictions, risk levels and sources, 0 included, from one pass."""
    spark = scans.sparkSession
    kinds = (("prediction", PREDICTIONS), ("risk_level", RISKS), ("source", SOURCES))
    all_ = spark.createDataFrame([(k, v) for k, vs in kinds for v in vs], "kind string, value string")
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k, _ in kinds)))
    found = scans.groupBy("prediction", "risk_level", "source").agg(F.count("*").alias("c")).select(cells.alias("x"), "c").groupBy("x.kind", "x.value").agg(F.sum("c").alias("n"))
    return F.broadcast(all_).join(found, ["kind", "value"], "left").select("kind", "value", F.coalesce("n", F.lit(0)).alias("n"))


def span(scans: DataFrame) -> DataFrame:
    return scans.agg(F.min("scanned_at").alias("first_scan_at"), F.max("scanned_at").alias("last_scan_at"), F.count("*").alias("total"))


def daily(scans: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """``day`` and a count for each prediction, over the last ``days`` days with ``as_of`` the last."""
    day = F.to_date("scanned_at")
    recent = scans.where(day >= F.date_sub(F.to_date(F.lit(as_of)), days - 1))
    return recent.groupBy(day.alias("day")).pivot("prediction", list(PREDICTIONS)).count().fillna(0, list(PREDICTIONS))


def calendar(scans: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Each day of the window with its total, 0 included, and whether it is the busiest (the first of equals)."""
    last = F.to_date(F.lit(as_of))
    dates = scans.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    totals = daily(scans, as_of, days).select("day", (F.col("Safe") + F.col("Suspicious") + F.col("Phishing")).alias("total"))
    filled = dates.join(totals, "day", "left").select("day", F.coalesce("total", F.lit(0)).alias("total"))
    best = filled.agg(F.min(F.struct((-F.col("total")).alias("n"), "day")).alias("b"))
    return filled.join(F.broadcast(best)).select("day", "total", ((F.col("day") == F.col("b.day")) & (F.col("total") > 0)).alias("busiest"))


def shares(scans: DataFrame) -> DataFrame:
    """``value, n, percent`` of the predictions and of risky ones together, half a percent rounded up."""
    c = [F.count_if(F.col("prediction") == p) for p in PREDICTIONS]
    cells = [F.struct(F.lit(p).alias("value"), n.alias("n"), F.count("*").alias("t")) for p, n in zip((*PREDICTIONS, "Risky"), (*c, c[1] + c[2]))]
    return scans.agg(F.array(*cells).alias("a")).select(F.inline("a")).select("value", "n", F.when(F.col("t") > 0, F.floor(100 * F.col("n") / F.col("t") + 0.5)).otherwise(0).cast("int").alias("percent"))
