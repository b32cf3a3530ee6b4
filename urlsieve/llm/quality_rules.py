"""Quality rules: base counts over whole texts, and a calibrated hashed n-gram model trained on labelled rows.

``quality_rules(documents, labels)`` keeps every row and column and adds ``n_words``, ``word_chars``, ``n_symbols``,
``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``p_low`` and ``kept`` (a column of one of these names is replaced).

Defined results: a null or empty text has no words, so it fails the base rule (``n_words < 20``) and is not kept; labels
with a null id or a null quality are ignored; ids of different types meet as strings; a document labelled twice counts with both labels; repeated rows are judged
each on their own and alike; with no usable labels, or one class only, the model is the base rate of that sample, and a
sample without any rows keeps all that pass the base rules; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import logit
from . import textbytes as tb

#: Hash buckets of the model, labelled rows and characters of each text that it is fitted on at most, and the probability of low quality that rejects.
BUCKETS, SAMPLE, SAMPLE_CHARS, REJECT = 1 << 18, 3000, 3000, 0.5
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CHAR = (np.arange(256) & 0xC0) != 0x80


def _repeats(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: is an equal item of its row elsewhere; is one earlier."""
    key = hashes ^ tb.mix(rows.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, later


def words_of(data: np.ndarray, offsets: np.ndarray, ranges: tb.RangeHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, row and hash of each word (run of bytes other than white space)."""
    start, end = tb.spans(~tb.SPACE[data], offsets)
    return start, tb.row_of(start, offsets), ranges(start, end)


def base_counts(data: np.ndarray, offsets: np.ndarray, ranges: tb.RangeHash, words: tuple) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    start, row, word = words
    inside = ~tb.SPACE[data]
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    line_start = line_start[line_start < len(data)]
    line_row = tb.row_of(line_start, offsets)
    at = np.searchsorted(breaks, line_start)
    line_end = np.minimum(np.append(breaks, len(data))[at], offsets[line_row + 1])
    filled = np.concatenate(([0], np.cumsum(inside)))
    has = filled[line_end] > filled[line_start]
    _, later = _repeats(line_row[has], ranges(line_start[has], line_end[has]))
    grams = tb.ngrams(word, WINDOW)
    whole = np.flatnonzero(row[: len(grams)] == row[WINDOW - 1 :]) if len(grams) else np.zeros(0, np.int64)
    twice, _ = _repeats(row[whole], grams[whole])
    edge = np.zeros(len(word) + 1, np.int64)
    np.add.at(edge, whole[twice], 1)
    np.add.at(edge, whole[twice] + WINDOW, -1)
    return {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": total(inside & _CHAR[data]),
        "n_symbols": total(_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_row[has][later], minlength=n),
        "n_repeat_words": np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=n),
    }


def features(data: np.ndarray, offsets: np.ndarray, words: tuple) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket and row of each word, word pair, and window of four UTF-8 units."""
    _, row, word = words
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    pair = tb.ngrams(word, 2)
    inner = np.flatnonzero(row[:-1] == row[1:]) if len(row) > 1 else np.zeros(0, np.int64)
    out = [((word >> shift).astype(np.int64), row), ((pair[inner] >> shift).astype(np.int64), row[inner])]
    m = len(data) - 3
    if m > 0:
        gram = np.ndarray((m,), "<u4", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        whole = rows[:m] == rows[3:]
        out.append(((gram[whole] >> shift).astype(np.int64), rows[:m][whole]))
    return out


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, text: str = "text") -> logit.Logit:
    """A model of P(low quality) from labelled rows, the first in the order of a hash of their ids: at most ``sample`` of them,
    each by its first ``sample_chars`` characters.  So a long text among them counts no more than others."""
    kinds = [df.schema["doc_id"].dataType for df in (documents, labels)]
    named = lambda df: F.col("doc_id").cast(kinds[0] if kinds[0] == kinds[1] else "string").alias("_id")
    chosen = (
        labels.select(named(labels), F.col("quality").cast("int").alias("_q"))
        .where(F.col("_id").isNotNull() & F.col("_q").isin(0, 1))
        .orderBy(F.xxhash64("_id"), "_id", "_q")
        .limit(sample)
    )
    texts = documents.select(named(documents), F.substring(F.col(text), 1, sample_chars).alias("_text")).where(F.col("_text").isNotNull())
    # the same bound again: a document id that is repeated must not lengthen the sample
    rows = texts.join(F.broadcast(chosen), "_id").orderBy(F.xxhash64("_id"), "_id", "_q", F.xxhash64("_text")).limit(sample).toArrow()
    if rows.num_rows == 0:
        return logit.Logit(np.zeros(BUCKETS, np.float32), -20.0)
    data, offsets = tb.text_bytes(rows["_text"])
    found = []
    for a, b in tb.chunks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        bucket, row, value = logit.entries(features(part, at, words_of(part, at, tb.RangeHash(part))), b - a, BUCKETS)
        found.append((bucket, row + np.int32(a), value))
    return logit.fit(tuple(map(np.concatenate, zip(*found))), (1 - rows["_q"].to_numpy()).astype(float), BUCKETS)


def quality_rules(documents: DataFrame, labels: DataFrame, reject: float = REJECT, sample: int = SAMPLE, text: str = "text") -> DataFrame:
    """``documents`` with the base counts and the verdict; see the module's docstring."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, sample, text=text))
    names = [c for c in documents.columns if c not in (*COUNTS, "base_failed", "p_low", "kept")]
    schema = documents.select(*names).schema
    for c, kind in (*((c, "long") for c in COUNTS), ("base_failed", "boolean"), ("p_low", "double"), ("kept", "boolean")):
        schema = schema.add(c, kind)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            data, offsets = tb.text_bytes(batch.column(names.index(text)))
            for a, b in tb.chunks(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ranges = tb.RangeHash(part)
                words = words_of(part, at, ranges)
                counts = base_counts(part, at, ranges, words)
                p = m.probability(logit.score(m.weights, features(part, at, words), b - a))
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"])
                extra = [pa.array(counts[c].astype(np.int64)) for c in COUNTS]
                extra += [pa.array(failed), pa.array(p), pa.array(~failed & (p < reject))]
                kept = [batch.column(i).slice(a, b - a) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(kept + extra, names=[*names, *COUNTS, "base_failed", "p_low", "kept"])

    return documents.select(*names).mapInArrow(judge, schema)
