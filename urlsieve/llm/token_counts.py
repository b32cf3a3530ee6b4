"""Exact length histogram: documents by encoded length, and suffix sums that answer questions for every context limit.

``histogram`` has a row per distinct length.  ``limits`` adds, for each distinct length taken as a context limit: documents
and tokens within it, documents that are longer, the tokens that stay when every document is cut at the limit, and the
share of documents and tokens covered.  Between two distinct lengths these are linear, so the table answers every limit;
``quantiles`` and ``at_limits`` read it so.

Defined results: a null or empty text has length 0 and counts as a document; repeated rows count each; other columns are
not read, so clashing names do no harm; an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from . import tokens as tk

#: Lengths in one block of the two-step suffix sums.
BLOCK = 1024


def histogram(documents: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """``length, n_docs``: how many documents have so many ids."""
    shared = tk.share(documents.sparkSession, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tk.encoder(shared, added=True)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"length": pa.array([len(encode(t.as_py() or "")) for t in batch.column(0)], pa.int64())})

    return documents.select(F.col(text).alias("text")).mapInArrow(count, "length long").groupBy("length").agg(F.count("*").alias("n_docs"))


def limits(lengths: DataFrame) -> DataFrame:
    """Suffix sums over the histogram.  No step gathers all lengths in one task: sums run within blocks of ``BLOCK`` lengths,
    and the blocks' own totals are summed the same way one level up."""
    lengths = scratch.keep(lengths, "lengths")
    sums = lambda df, key, w: df.withColumns({f"{c}_from": F.sum(c).over(w) for c in ("n_docs", "n_tokens")})
    rows = lengths.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    rows = sums(rows, "length", Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0))
    blocks = lengths.groupBy(F.floor(F.col("length") / BLOCK).alias("block")).agg(F.sum("n_docs").alias("n_docs"), F.sum(F.col("length") * F.col("n_docs")).alias("n_tokens"))
    blocks = blocks.withColumn("top", F.floor(F.col("block") / BLOCK))
    after = Window.partitionBy("top").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    tops = blocks.groupBy("top").agg(F.sum("n_docs").alias("top_docs"), F.sum("n_tokens").alias("top_tokens"))
    # one row for each 2^20 ids of the longest document's length
    above = Window.orderBy(F.desc("top")).rowsBetween(Window.unboundedPreceding, -1)
    later = tops.select("top", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("top_docs", "top_tokens")))
    blocks = blocks.select("block", "top", F.coalesce(F.sum("n_docs").over(after), F.lit(0)).alias("b_docs"), F.coalesce(F.sum("n_tokens").over(after), F.lit(0)).alias("b_tokens")).join(later, "top").select("block", (F.col("b_docs") + F.col("top_docs")).alias("b_docs"), (F.col("b_tokens") + F.col("top_tokens")).alias("b_tokens"))
    total = lengths.agg(F.sum("n_docs").alias("all_docs"), F.sum(F.col("length") * F.col("n_docs")).alias("all_tokens"))
    docs_over = F.col("n_docs_from") + F.col("b_docs") - F.col("n_docs")
    tokens_over = F.col("n_tokens_from") + F.col("b_tokens") - F.col("n_tokens")
    return rows.join(blocks, "block").crossJoin(F.broadcast(total)).select(
        F.col("length").alias("context_limit"), "n_docs", "n_tokens",
        (F.col("all_docs") - docs_over).alias("docs_within"), (F.col("all_tokens") - tokens_over).alias("tokens_within"),
        docs_over.alias("docs_over"), tokens_over.alias("tokens_over"),
        (F.col("all_tokens") - tokens_over + F.col("length") * docs_over).alias("truncated_tokens"),
        F.col("all_docs").alias("total_docs"), F.col("all_tokens").alias("total_tokens"),
    )


def at_limits(table: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """``context_limit, docs_within, docs_over, truncated_tokens`` for any limits (a short list), from :func:`limits`."""
    asked = table.sparkSession.createDataFrame([(int(x),) for x in wanted], "wanted long")
    best = table.join(F.broadcast(asked), F.col("context_limit") <= F.col("wanted")).groupBy("wanted").agg(F.max(F.struct("context_limit", "docs_within", "docs_over", "truncated_tokens")).alias("s"))
    whole = table.agg(F.max("total_docs").alias("total_docs"))
    return asked.join(best, "wanted", "left").crossJoin(whole).select(
        F.col("wanted").alias("context_limit"),
        F.coalesce("s.docs_within", F.lit(0)).alias("docs_within"),
        F.coalesce("s.docs_over", "total_docs", F.lit(0)).alias("docs_over"),
        F.coalesce(F.col("s.truncated_tokens") + (F.col("wanted") - F.col("s.context_limit")) * F.col("s.docs_over"), F.col("wanted") * F.col("total_docs"), F.lit(0)).alias("truncated_tokens"),
    )


def quantiles(table: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``share, length``: the least length that at least that share of the documents does not exceed."""
    asked = table.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return table.join(F.broadcast(asked), F.col("docs_within") >= F.ceil(F.col("share") * F.col("total_docs"))).groupBy("share").agg(F.min("context_limit").alias("length"))
