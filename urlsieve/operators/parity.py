"""Audit of stored features against features computed again from the urls.

Some stored values were made from a part of the url only.  A row's stored length tells which: the audit computes the features of
that prefix too, keeps those that depend on the host as the whole url has them, and says how often each feature agrees with
the stored one, for the prefix and for the whole url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve.functions import features as feat
from urlsieve.operators import urls

#: Features that were stored for the whole host even where the rest was cut, and the tolerances of ratios (stored
#: with three decimals) and of other features; a share of the computed value is added to both.
HOST_LEVEL = ("DomainLength", "IsDomainIP", "CharContinuationRate", "TLDLegitimateProb", "TLDLength", "NoOfSubDomain", "IsHTTPS")
RATIO, EXACT, RELATIVE = 0.0015, 1e-6, 1e-5


def tolerance(name: str) -> float:
    return RATIO if "Ratio" in name else EXACT


def close(stored: Column, computed: Column, name: str) -> Column:
    return F.coalesce(F.abs(stored.cast("double") - computed.cast("double")) <= tolerance(name) + RELATIVE * F.abs(computed.cast("double")), F.lit(False))


def recomputed(stored: DataFrame, prior: DataFrame) -> DataFrame:
    """``stored`` (an id, ``url`` and the features) with ``offset`` (stored length less the url's), ``prefix``, and the features of the
    prefix and of the whole url as ``prefix_<name>`` and ``whole_<name>``.  A stored length that no prefix has means the whole url."""
    n, length = F.col("URLLength").cast("int"), F.length("url")
    rows = stored.withColumn("offset", (n - length).cast("long")).withColumn("prefix", F.when(n.between(1, length), F.substring("url", F.lit(1), n)).otherwise(F.col("url")))
    names = list(feat.NAMES)
    rows = rows.withColumnsRenamed({c: f"stored_{c}" for c in names})
    for kind, column in (("whole", "url"), ("prefix", "prefix")):
        rows = urls.with_features(rows, prior, column).withColumnsRenamed({c: f"{kind}_{c}" for c in names})
    return rows.withColumns({f"prefix_{c}": F.col(f"whole_{c}") for c in HOST_LEVEL})


def audit(stored: DataFrame, prior: DataFrame) -> DataFrame:
    """``feature, prefix_share, whole_share``: how often the stored value agrees with each of both."""
    share = lambda kind, c: F.avg(close(F.col(f"stored_{c}"), F.col(f"{kind}_{c}"), c).cast("int"))
    cells = [F.struct(F.lit(c).alias("feature"), share("prefix", c).alias("prefix_share"), share("whole", c).alias("whole_share")) for c in feat.NAMES]
    return recomputed(stored, prior).agg(F.array(*cells).alias("a")).select(F.inline("a"))


def offsets(stored: DataFrame) -> DataFrame:
    """``offset, rows, rejected, changed``: rows by how far the stored length is from the url's, and how many of their urls do not
    normalise, or change when they do."""
    rows = urls.normalize(stored.select("url", (F.col("URLLength").cast("int") - F.length("url")).cast("long").alias("offset")), idna=False)
    bad = F.col("url_error").isNotNull()
    return rows.groupBy("offset").agg(F.count("*").alias("rows"), F.count_if(bad).alias("rejected"), F.count_if(~bad & (F.col("normalized_url") != F.col("url"))).alias("changed"))
