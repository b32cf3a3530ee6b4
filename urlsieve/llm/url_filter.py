"""URL filters: host and path rules, and logistic regression on hashed character n-grams for the urls no rule fits.

``parts`` splits urls with built-in functions; ``rule_of`` finds the longest rule of a short list; ``judge`` adds the verdict.  The
model is trained from a small labelled url table ``url, label`` (1: block), at most ``SAMPLE`` rows of it.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the model's verdict
for empty parts; with no labels, or one class only, the model is the base rate (allow, where it is below the threshold);
labelled rows with a null url or label are ignored; ties between rules go to the one with more labels in its host; repeated rows are judged
each; other columns stay, and a column of a result's name is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import logit
from . import textbytes as tb

BUCKETS, SAMPLE, BLOCK_AT = 1 << 16, 20_000, 0.5
GRAMS = (3, 4, 5)
RESULTS = ("host", "path", "rule", "p_block", "verdict")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    found = F.instr(url, "://")
    rest = F.substring(url, found + F.lit(3), F.length(url))
    cut = F.when(found > 0, rest).otherwise(F.lit(""))
    host = F.regexp_extract(cut, r"^([^/?#]*)", 1)
    path = F.regexp_extract(cut, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits, null if none does. ``rules``: (verdict, host, path)."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -r[1].count("."), r[1] + r[2]))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    pick = lambda value: reduce(lambda rest, r: F.when(fits(r[1], r[2]), F.lit(value(r))).otherwise(rest), reversed(ordered), F.lit(None).cast("string"))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def features(host: pa.Array, path: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket and row of each character n-gram of ``^host$`` and of ``^path$``; n-grams run over UTF-8 units."""
    out = []
    for seed, column in ((1, host), (2, path)):
        edged = pa.compute.binary_join_element_wise(pa.scalar("^"), column.cast(pa.string()), pa.scalar("$"), "")
        data, offsets = tb.text_bytes(edged)
        code = data.astype(np.uint64) + np.uint64(1)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for n in GRAMS:
            h = tb.ngrams(code, n)
            whole = row[: len(h)] == row[n - 1 :] if len(h) else np.zeros(0, bool)
            key = tb.mix(h[whole] + np.uint64(seed * 16 + n))
            out.append(((key % np.uint64(BUCKETS)).astype(np.int64), row[: len(h)][whole]))
    return out


def fit(labelled: DataFrame, sample: int = SAMPLE) -> logit.Logit:
    """The model of P(block) from the first ``sample`` rows of ``url, label`` in the order of a hash of the url."""
    host, path = parts(F.col("url"))
    rows = (
        labelled.where(F.col("url").isNotNull() & F.col("label").isin(0, 1))
        .select(F.xxhash64("url").alias("_h"), "url", F.col("label").cast("int").alias("label"), host.alias("host"), path.alias("path"))
        .orderBy("_h", "url", "label").limit(sample).toArrow()
    )
    if rows.num_rows == 0:
        return logit.Logit(np.zeros(BUCKETS, np.float32), -20.0)
    groups = features(rows["host"].combine_chunks(), rows["path"].combine_chunks())
    return logit.fit(logit.entries(groups, rows.num_rows, BUCKETS), rows["label"].to_numpy().astype(float), BUCKETS)


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = (), block_at: float = BLOCK_AT, sample: int = SAMPLE) -> DataFrame:
    """``pages`` (a column ``url``) with ``host, path, rule, p_block, verdict``."""
    model = pages.sparkSession.sparkContext.broadcast(fit(labelled, sample))
    names = [c for c in pages.columns if c not in RESULTS]
    host, path = parts(F.col("url"))
    split = pages.select(*names, host.alias("host"), path.alias("path"))
    schema = split.select("*").schema.add("p_block", "double")
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            groups = features(batch.column(at), batch.column(at + 1))
            p = m.probability(logit.score(m.weights, groups, batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*names, "host", "path", "p_block"])

    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("p_block") >= block_at, F.lit("block")).otherwise(F.lit("allow"))
    return split.mapInArrow(run, schema).select(*names, "host", "path", rule.alias("rule"), "p_block", F.coalesce(verdict, own).alias("verdict"))
