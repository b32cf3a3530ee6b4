"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Windows of ``size`` consecutive words of the benchmark items are the patterns; an item of fewer words is one shorter
window, and windows of one length are searched together.  For patterns of ``m`` words, a table gives each block of two
words the distance to its last place in any pattern: the search looks at the block that ends ``m`` words ahead and skips
by that distance, nine words for most blocks.  Where the distance is 0, the bucket of that suffix lists the patterns to
compare word by word.

The pattern tables are broadcast in shards of about ``SHARD`` pairs of a window and an item (the items of one window may lie in
several shards).  There is a pass over the documents for each; it carries the marks of the passes before, and is written to
the shared folder before the next begins, so an executor holds one shard at a time whatever the benchmark's size.

Defined results: words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; a null or empty text has none and is
clean; an item without words has no window; the items of one id are one item, and those with a null id are together one that
counts but has no id to list; repeated windows count once; repeated documents are judged each; other columns stay, and a column of a
result's name is replaced; empty tables are fine on either side.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textbytes as tb

SIZE, SHARD = 10, 200_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "hit_spans")


def words(text: str | None) -> list[bytes]:
    """Words of ``text``: in UTF-8, A-Z lower-cased, these are the runs of the digits, letters and units above ASCII."""
    return WORD.findall(text.encode().lower()) if text else []


@dataclass
class Tables:
    """Wu-Manber tables for patterns of ``m`` words."""

    m: int
    shift: dict[bytes, int] = field(default_factory=dict)
    bucket: dict[bytes, list[tuple[list[bytes], list[int]]]] = field(default_factory=dict)

    @property
    def block(self) -> int:
        return min(2, self.m)

    def add(self, pattern: list[bytes], items: list[int]) -> None:
        b = self.block
        for end in range(b, self.m + 1):
            key = b" ".join(pattern[end - b : end])
            self.shift[key] = min(self.shift.get(key, self.m), self.m - end)
        self.bucket.setdefault(key, []).append((pattern, items))

    def search(self, text: list[bytes], marks: bytearray, found: set[int]) -> None:
        """Mark the words of ``text`` inside occurrences and collect the items."""
        m, n, shift, most = self.m, len(text), self.shift.get, self.m - self.block + 1
        at, one = m - 1, b"\x01" * m
        if self.block == 2:
            while at < n:
                key = text[at - 1] + b" " + text[at]
                skip = shift(key, most)
                if skip:
                    at += skip
                    continue
                first = at - m + 1
                for pattern, items in self.bucket[key]:
                    if text[first] == pattern[0] and text[first : at + 1] == pattern:
                        marks[first : at + 1] = one
                        found.update(items)
                at += 1
        else:
            for at, word in enumerate(text):
                for _, items in self.bucket.get(word, ()):
                    marks[at] = 1
                    found.update(items)


def windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``pattern, item``: the distinct windows of words (joined by spaces) of each item (its id as a string, or null)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, out = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = words(text.as_py())
                for a in range(max(1, len(w) - size + 1) if w else 0):
                    item.append(i)
                    out.append(b" ".join(w[a : a + size]).decode())
                if len(out) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(out, pa.string())], names=["item", "pattern"])
                    item, out = [], []
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(out, pa.string())], names=["item", "pattern"])

    source = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text"))
    return source.mapInArrow(cut, "item string, pattern string").distinct()


def _load(rows: list) -> list[Tables]:
    by: dict[int, Tables] = {}
    for r in rows:
        pattern = r["pattern"].encode().split(b" ")
        by.setdefault(len(pattern), Tables(len(pattern))).add(pattern, [*r["items"], *[None] * bool(r["anonymous"])])
    return [by[m] for m in sorted(by, reverse=True)]


_OPEN: dict[str, list[Tables]] = {}


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = SIZE, shard: int = SHARD, text: str = "text") -> DataFrame:
    """``documents`` with ``n_words, n_hit, n_items, items_sha256, contaminated``, the ``item_ids`` found and ``hit_spans`` (first
    and last word of each run of hit words)."""
    pairs = scratch.keep(windows(benchmark, size), "windows")
    shards = max(1, -(-pairs.count() // shard))
    out = documents.select(*(c for c in documents.columns if c not in (*RESULTS, "_marks", "_items")), F.lit(None).cast("binary").alias("_marks"), F.lit(None).cast("array<string>").alias("_items"))
    for k in range(shards):
        mine = pairs.where(F.pmod(F.xxhash64("pattern", "item"), F.lit(shards)) == k) if shards > 1 else pairs
        mine = mine.groupBy("pattern").agg(F.collect_set("item").alias("items"), F.max(F.col("item").isNull()).alias("anonymous"))
        rows = [r.asDict() for r in mine.orderBy("pattern").collect()]  # about ``shard`` pairs
        shared, before = documents.sparkSession.sparkContext.broadcast(rows), out
        out = _pass(out, text, shared, k == shards - 1)
        if k < shards - 1:
            out = scratch.keep(out, "marked")
            shared.destroy()
        if k and k < shards - 1:
            scratch.drop(before)
    return out


def _pass(documents: DataFrame, text: str, shared, last: bool) -> DataFrame:
    names = documents.columns
    kept = names[:-2]
    schema = documents.schema
    if last:
        schema = documents.select(*kept).schema
        for c, kind in zip(RESULTS, ("long", "long", "long", "string", "boolean", "array<string>", "array<struct<first:long,last:long>>")):
            schema = schema.add(c, _type(kind))
    where, spark_items, key = names.index(text), len(names) - 1, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key] = _load(shared.value)
        tables = _OPEN[key]
        for batch in (b.slice(i, j - i) for b in batches for i, j in tb.chunks(tb.text_bytes(b.column(where))[1])):
            rows = []
            for t, old, known in zip(batch.column(where), batch.column(spark_items - 1), batch.column(spark_items)):
                w = words(t.as_py())
                marks = bytearray(old.as_py() or len(w))
                found = set(known.as_py() or ())
                for table in tables:
                    table.search(w, marks, found)
                rows.append((marks, found))
            columns = [batch.column(i) for i in range(len(kept))]
            if last:
                results = [_result(m, f) for m, f in rows]
                columns += [pa.array([r[i] for r in results], schema_arrow[i]) for i in range(len(RESULTS))]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *RESULTS])
            else:
                columns += [pa.array([bytes(m) for m, _ in rows], pa.binary()), pa.array([list(f) for _, f in rows], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    schema_arrow = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), span]
    return documents.mapInArrow(run, schema)


def _type(kind: str):
    from pyspark.sql.types import DataType

    return DataType.fromDDL(kind)


def _result(marks: bytearray, found: set) -> tuple:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], np.frombuffer(bytes(marks), np.uint8), [0])).astype(np.int8)))
    ids = sorted(x for x in found if x is not None)
    digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
    return len(marks), sum(marks), len(found), digest, any(marks), ids, [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]
