"""Dedup, grouping, splitting and leakage audit of labelled url tables (label 0: phishing, 1: legitimate)."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlsieve.functions.url import let

SPLITS = (("train", 0.8), ("validation", 0.9), ("test", 1.0))


def dedup_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_first(df: DataFrame, key: str = "url", order: str = "id") -> DataFrame:
    """The first row of each key in the order of ``order``; a combinable aggregate, so a frequent key gathers nowhere."""
    whole = F.struct(F.col(order).alias("_o"), F.struct(*df.columns).alias("_r"))
    return df.groupBy(F.col(key).alias("_k")).agg(F.min(whole).alias("_m")).select("_m._r.*")


def label_conflicts(df: DataFrame, key: str = "url") -> DataFrame:
    """Keys with more than one label."""
    return df.groupBy(key).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows")).where("low <> high").select(key, "rows")


def require_consistent(df: DataFrame, key: str = "url") -> DataFrame:
    """``df``; raises with a few of the keys if any has conflicting labels."""
    found = [r[0] for r in label_conflicts(df, key).limit(5).collect()]
    if found:
        raise ValueError(f"conflicting labels: {found}")
    return df


def prepare_stats(df: DataFrame, prepared: DataFrame) -> DataFrame:
    """Rows in, duplicate rows removed, rejected, used, and groups. ``prepared``: one row a url, ``group`` null if rejected."""
    a = df.agg(F.count("*").alias("input_rows"))
    b = prepared.agg(F.count("*").alias("urls"), F.count("group").alias("rows_used"), F.count_distinct("group").alias("groups"))
    return a.join(F.broadcast(b)).select("input_rows", (F.col("input_rows") - F.col("urls")).alias("duplicate_url_rows_removed"), (F.col("urls") - F.col("rows_used")).alias("rejected_by_url_validation"), "rows_used", "groups")


def group_labels(df: DataFrame) -> DataFrame:
    """``group, y, n``: majority label of each group, ties to phishing (1)."""
    return df.groupBy("group").agg((F.avg((F.col("label") == 0).cast("int")) >= 0.5).cast("int").alias("y"), F.count("*").alias("n"))


def rank_key(column: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), column.cast("string")))


def shuffle_rank(df: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """``df`` with ``position``: a seeded shuffle, as places from 1. Places come from counts by hash prefix and windows inside a
    prefix, so no window holds all rows; rows of one key stay next to each other."""
    hashed = df.withColumn("_h", rank_key(F.col(key), seed)).withColumn("_p", F.substring("_h", 1, 3))
    counts = hashed.groupBy("_p").agg(F.count("*").alias("_c"))  # at most 4,096 rows
    before = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key)) + F.col("_s")
    return hashed.join(F.broadcast(before), "_p").withColumn("position", place).select(*df.columns, "position")


#: Multipliers and modulus of the bits that decide swaps.
_MIX, _MODULUS = (48271, 69621), 2147483647


def permutation_keys(seed: int, rounds: int = 24) -> list[int]:
    """Round keys of :func:`permuted`."""
    r = random.Random(seed)
    return [r.getrandbits(62) for _ in range(rounds)]


def permuted(x: Column, n: Column, keys: Column) -> Column:
    """The place of ``x`` under a seeded bijection of 0 to n - 1, by swap-or-not rounds (Hoang, Morris and Rogaway, 2012): each round
    pairs x with its key less x and swaps the pair or not by a bit that both see.  ``keys``: an array of longs."""

    def swap(x: Column, k: Column) -> Column:
        bit = lambda m: F.floor(((m % _MODULUS * _MIX[0] + k % _MODULUS) % _MODULUS * _MIX[1] % _MODULUS) / 65536) % 2 == 1
        return let((k % n + n - x) % n, lambda other: F.when(bit(F.greatest(x, other)), other).otherwise(x))

    return F.aggregate(keys, x.cast("bigint"), swap)


def split_groups(groups: DataFrame, seed: int = 42, key: str = "group", stratum: str = "y") -> DataFrame:
    """``groups`` with ``split``: within each stratum the first 80 %, next 10 % and last 10 % of the groups in the order of a seeded
    hash, cut at the floor of the shares.

    The order is total, so any run gives the same split.  Ranks come from counts by hash prefix and windows inside a prefix:
    no window holds a whole stratum."""
    keyed = groups.withColumns({"_h": rank_key(F.col(key), seed)}).withColumn("_p", F.substring("_h", 1, 3))
    counts = keyed.groupBy(stratum, "_p").agg(F.count("*").alias("_c"))  # at most 4,096 prefixes a stratum
    before = counts.withColumns({
        "_before": F.coalesce(F.sum("_c").over(Window.partitionBy(stratum).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_total": F.sum("_c").over(Window.partitionBy(stratum)),
    }).drop("_c")
    rank = F.row_number().over(Window.partitionBy(stratum, "_p").orderBy("_h", key)) + F.col("_before")
    cut = lambda share: rank <= F.floor(F.lit(share) * F.col("_total"))
    split = F.when(cut(0.8), "train").when(cut(0.9), "validation").otherwise("test")
    return keyed.join(before, [stratum, "_p"]).withColumn("split", split).select(*groups.columns, "split")


def grouped_split(df: DataFrame, seed: int = 42) -> DataFrame:
    """``df`` with ``split``; all rows of a ``group`` share it."""
    return df.join(split_groups(group_labels(df), seed).select("group", "split"), "group")


def split_overlap(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``key, a, b, shared_keys, rows_with_shared_key``: overlap of each pair of splits, rows counted in ``b``."""
    out = []
    for key in keys:
        present = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("value")).pivot("split", [s for s, _ in SPLITS]).count().fillna(0)
        for a, b in (("train", "validation"), ("train", "test"), ("validation", "test")):
            both = (F.col(a) > 0) & (F.col(b) > 0)
            out.append(present.agg(F.count_if(both).alias("shared_keys"), F.coalesce(F.sum(F.when(both, F.col(b))), F.lit(0)).alias("rows_with_shared_key")).select(F.lit(key).alias("key"), F.lit(a).alias("a"), F.lit(b).alias("b"), "shared_keys", "rows_with_shared_key"))
    return reduce(DataFrame.union, out)


def require_disjoint(df: DataFrame, key: str = "group") -> DataFrame:
    """``df``; raises if two splits share a key."""
    shared = df.groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1").limit(1).count()
    if shared:
        raise ValueError(f"splits share values of {key}")
    return df


def describe_splits(df: DataFrame) -> DataFrame:
    """Rows, distinct urls, duplicate rows and classes of each split."""
    by_url = df.groupBy("split", "url").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("bad"))
    return by_url.groupBy("split").agg(
        F.sum("n").alias("rows"), F.count("*").alias("unique_urls"), F.sum(F.col("n") - 1).alias("duplicate_rows"),
        F.sum("bad").alias("phishing"), F.sum(F.col("n") - F.col("bad")).alias("legitimate"),
    )


def profile(df: DataFrame) -> DataFrame:
    """``column, rows, nulls, distinct_values`` of each column, from one aggregate."""
    cells = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(c).alias("distinct_values")) for c in df.columns]
    return df.agg(F.array(*cells).alias("a")).select(F.inline("a"))


def fingerprint(df: DataFrame, key: str = "url", digits: int = 2) -> DataFrame:
    """``split, n, sha256``: a hash of each split's sorted keys.

    The keys are hashed by prefix bucket of their own digest, then the buckets' digests in order, so no group is a whole
    split: a bucket's digest is the bitwise sum (two 61-bit residues and a count) of its keys' digests."""
    h = F.sha2(key, 256)
    part = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")
    buckets = df.select("split", F.substring(h, 1, digits).alias("b"), part(3).alias("x"), part(20).alias("y")).groupBy("split", "b").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    line = F.concat_ws(":", "b", "n", F.col("x").cast("string"), F.col("y").cast("string"))
    return buckets.groupBy("split").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(line)), ",").alias("t")).select("split", "n", F.sha2("t", 256).alias("sha256"))


def digest_tree(df: DataFrame, key: str = "url", digits: tuple[int, ...] = (6, 3, 0), by: str = "split") -> DataFrame:
    """``split, n, sha256``: a digest of each split's keys in the order of their own digests, repeats included.

    Leaves hold the keys whose digests begin with the same ``digits[0]`` hexadecimal digits; a leaf's digest is that of its keys' sorted
    digests, and each level above digests its children in order. Ranges are cut by content, so the value is the same for any
    partitioning and no task holds more than a leaf (one in 16^6 of the keys) or 4,096 digests."""
    rows = df.select(by, F.coalesce(F.sha2(F.col(key), 256), F.lit("null")).alias("at"))
    rows = rows.select(by, F.lit(1).cast("bigint").alias("n"), "at", F.col("at").alias("d"))
    for width in digits:
        # one-way at each level: a child's place and digest both count
        line = F.concat_ws(":", "at", "d")
        rows = rows.groupBy(by, F.substring("at", 1, width).alias("p")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("d")).select(by, "n", F.col("p").alias("at"), "d")
    return rows.select(by, "n", F.col("d").alias("sha256"))


def sample_per_group(df: DataFrame, group: str, n: int, key: str = "id", seed: int = 42) -> DataFrame:
    """``n`` rows of each group, the first in the order of a seeded hash."""
    w = Window.partitionBy(group).orderBy(rank_key(F.col(key), seed), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def class_balance(df: DataFrame) -> DataFrame:
    """Rows of each class and the share of phishing by split."""
    return df.groupBy("split").agg(F.count_if(F.col("label") == 0).alias("phishing"), F.count_if(F.col("label") == 1).alias("legitimate"), F.avg((F.col("label") == 0).cast("double")).alias("phishing_share"))


def numeric_columns(df: DataFrame, leave_out: tuple[str, ...] = ("label",)) -> DataFrame:
    """``df`` with its numeric columns only, less identifiers and the label."""
    return df.select(*(f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in leave_out and not f.name.endswith("id")))


def prepare_texts(df: DataFrame) -> DataFrame:
    """Trimmed non-blank urls with a label of 0 or 1."""
    return df.select("id", F.trim("url").alias("url"), F.col("label").cast("int").alias("label")).where((F.col("url") != "") & F.col("label").isin(0, 1))


def tld_prior(df: DataFrame) -> DataFrame:
    """``tld, p`` from ``tld, p`` rows: the value is constant for a TLD, so the least is any of them."""
    return df.groupBy(F.lower("tld").alias("tld")).agg(F.min("p").alias("p"))


def class_weights(df: DataFrame) -> DataFrame:
    """``label, n, weight``: balanced weights ``rows / (2 n)``."""
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(df.agg(F.count("*").alias("rows")))).select("label", "n", (F.col("rows") / (2 * F.col("n"))).alias("weight"))
