"""Line dedup through a sharded minimal perfect hash.

1. Documents give the 128-bit hashes of their distinct line keys; counting them by hash finds the keys of at least
   ``min_docs`` documents.
2. These hashes are dealt to shards; each shard becomes a minimal perfect hash (levels of collision-free bit arrays, packed,
   with their ranks; Limasset et al. 2017) with a compact array of 64-bit fingerprints and one of 32-bit counts, in the slot
   order of the hash: about 13 bytes a key.
3. Documents probe the arrays; lines are never joined.  Shards are broadcast in groups of at most ``GROUP_BYTES``, with one pass
   over the documents for each group; rows carry the marks of their lines along, and are written to the shared folder before
   the next pass begins, so an executor holds one group at a time.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; empty keys are never dropped.

Defined results: a null or empty text is one empty line; repeated rows and rows of one id count as the documents they are
(one id, one document); a null id counts as one document; other columns stay, and a column of a result's name is
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textbytes as tb

MIN_DOCS, MIN_CHARS = 10, 1
#: Keys in one shard (on average), and bytes of the shards broadcast together.
SHARD_KEYS, GROUP_BYTES = 1 << 16, 64 << 20
GAMMA = 2.0
WHITE = b" \t\n\x0b\x0c\r"


@dataclass
class Level:
    """A bit array, and the number of set bits before each of its 64-bit words (and in the levels above)."""

    size: int
    words: np.ndarray
    before: np.ndarray

    def slot(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the bits at these places are set, and their ranks."""
        word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        return (word >> bit & np.uint64(1)).astype(bool), self.before[at >> 6].astype(np.int64) + below


@dataclass
class Shard:
    """A minimal perfect hash of 64-bit keys, and the arrays it indexes."""

    levels: list[Level]
    fingerprint: np.ndarray
    count: np.ndarray

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for a key that no level has. Keys outside the set may land anywhere."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for depth, level in enumerate(self.levels):
            hit, rank = level.slot(_place(keys[left], depth, level.size))
            out[left[hit]] = rank[hit]
            left = left[~hit]
        return out

    def counts(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The count of each key (up to 2^32 - 1); 0 for those whose fingerprint differs."""
        at = self.slot(keys)
        found = at >= 0
        found[found] = self.fingerprint[at[found]] == prints[found]
        out = np.zeros(len(keys), np.int64)
        out[found] = self.count[at[found]]
        return out


def _place(keys: np.ndarray, depth: int, size: int) -> np.ndarray:
    return (tb.mix(keys + np.uint64(0x9E3779B97F4A7C15 * (depth + 1) & tb.MASK)) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> Shard:
    """The minimal perfect hash of distinct ``keys``."""
    levels, left, used, depth = [], np.arange(len(keys)), 0, 0
    while len(left):
        size = max(1, int(GAMMA * len(left)))
        at = _place(keys[left], depth, size)
        alone = np.bincount(at, minlength=-(-size // 64) * 64) == 1
        words = np.packbits(alone, bitorder="little").view("<u8")
        ones = np.bitwise_count(words).astype(np.uint32)
        levels.append(Level(size, words, (used + np.cumsum(ones) - ones).astype(np.uint32)))
        used += int(ones.sum())
        left = left[~alone[at]]
        depth += 1
    shard = Shard(levels, np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint32))
    at = shard.slot(keys)
    shard.fingerprint[at], shard.count[at] = prints, np.minimum(counts, (1 << 32) - 1)
    return shard


def split_keys(body: bytes) -> tuple[list[bytes], list[bytes]]:
    lines = body.split(b"\n")
    return lines, [x.strip(WHITE).lower() for x in lines]


def _hashes(keys: list[bytes]) -> np.ndarray:
    """Two unsigned 64-bit halves of each key's hash."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)


def _long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (chars <= 1 or len(key.decode("utf-8", "replace")) >= chars)


def _rows(column: pa.Array) -> Iterator[bytes]:
    data, offsets = tb.text_bytes(column)
    body = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield body[a:b]


def frequent_lines(documents: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, text: str = "text") -> DataFrame:
    """``k, f, n``: both halves of the hash, and the documents, of each line key found in at least ``min_docs`` of them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, found = [], []
            for i, body in enumerate(_rows(batch.column(1))):
                keys = [k for k in dict.fromkeys(split_keys(body)[1]) if k and _long_enough(k, min_chars)]
                owner += [i] * len(keys)
                found += keys
                if len(found) > 200_000:
                    yield _lines(batch, owner, found)
                    owner, found = [], []
            yield _lines(batch, owner, found)

    def _lines(batch: pa.RecordBatch, owner: list[int], found: list[bytes]) -> pa.RecordBatch:
        h = _hashes(found)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(np.ascontiguousarray(h[:, i]).view(np.int64)) for i in (0, 1))], names=["doc_id", "k", "f"])

    source = documents.select(F.col("doc_id"), F.col(text).alias("text"))
    lines = source.mapInArrow(emit, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, k long, f long")
    # a line repeated under one id counts once, so (key, id) pairs meet first: no key gathers its rows in one task
    return lines.groupBy("k", "f", "doc_id").agg(F.lit(1).alias("one")).groupBy("k", "f").agg(F.sum("one").alias("n")).where(F.col("n") >= min_docs)


def index(lines: DataFrame) -> tuple[DataFrame, int]:
    """``shard, body`` rows and the number of shards. ``lines`` comes from :func:`frequent_lines`."""
    lines = scratch.keep(lines, "frequent-lines")
    shards = max(1, -(-lines.count() // SHARD_KEYS))

    def one(key: tuple, table: pa.Table) -> pa.Table:
        u = lambda c: table[c].to_numpy().view(np.uint64)
        body = pickle.dumps(build(u("k"), u("f"), table["n"].to_numpy()))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([body], pa.binary())})

    dealt = lines.withColumn("shard", F.pmod(F.shiftrightunsigned("k", 20), F.lit(shards)).cast("int"))
    return scratch.keep(dealt.groupBy("shard").applyInArrow(one, "shard int, body binary"), "line-index"), shards


def line_dedup(documents: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``documents`` with ``text`` rewritten (null stays null unless lines were dropped), ``n_lines``, ``n_dropped`` and ``kept_sha256``."""
    spark = documents.sparkSession
    table, shards = index(frequent_lines(documents, min_docs, min_chars, text))
    largest = table.agg(F.max(F.length("body"))).first()[0] or 1
    per_group = max(1, group_bytes // largest)
    out = documents.select(*(c for c in documents.columns if c not in ("n_lines", "n_dropped", "kept_sha256", "_hit")), F.lit(None).cast("binary").alias("_hit"))
    for first in range(0, shards, per_group):
        last, before = first + per_group >= shards, out
        rows = table.where(F.col("shard").between(first, first + per_group - 1)).collect()  # at most ``group_bytes``
        shared = spark.sparkContext.broadcast({r["shard"]: bytes(r["body"]) for r in rows})
        out = _probe(out, text, shared, shards, last)
        if not last:
            out = scratch.keep(out, "marked")
            shared.destroy()
            if first:
                scratch.drop(before)
    return out


_OPEN: dict[str, dict[int, Shard]] = {}


def _probe(documents: DataFrame, text: str, shared, shards: int, last: bool) -> DataFrame:
    names = documents.columns
    kept = names[:-1]
    schema = documents.schema
    if last:
        schema = documents.select(*kept).schema.add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")
    where, key = names.index(text), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key] = {k: pickle.loads(v) for k, v in shared.value.items()}
        parts = _OPEN[key]
        for batch in batches:
            _, offsets = tb.text_bytes(batch.column(where))
            for a, b in tb.chunks(offsets):
                yield _mark(batch.slice(a, b - a), parts)

    def _mark(batch: pa.RecordBatch, parts: dict[int, Shard]) -> pa.RecordBatch:
        split = [split_keys(x) for x in _rows(batch.column(where))]
        ends = np.cumsum([0, *(len(lines) for lines, _ in split)])
        keys = [k for _, ks in split for k in ks]
        h = _hashes(keys)
        shard = ((h[:, 0] >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
        hit = np.zeros(len(keys), bool)
        for s in np.unique(shard):
            if s in parts:
                mine = np.flatnonzero(shard == s)
                hit[mine] = parts[s].counts(h[mine, 0], h[mine, 1]) > 0
        hit &= np.fromiter((len(k) > 0 for k in keys), bool, len(keys))
        for i, old in enumerate(batch.column(len(names) - 1)):
            if old.is_valid:
                hit[ends[i] : ends[i + 1]] |= np.frombuffer(old.as_py(), bool)
        columns = [batch.column(i) for i in range(len(kept))]
        if not last:
            return pa.RecordBatch.from_arrays([*columns, pa.array([hit[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], names=names)
        texts, sha, dropped, old = [], [], [], batch.column(where)
        for i, (lines, _) in enumerate(split):
            mark = hit[ends[i] : ends[i + 1]]
            body = b"\n".join([x for x, m in zip(lines, mark.tolist()) if not m]) if mark.any() else b"\n".join(lines)
            texts.append(body.decode("utf-8", "replace") if mark.any() or old[i].is_valid else None)
            sha.append(hashlib.sha256(body).hexdigest())
            dropped.append(int(mark.sum()))
        columns[where] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(ends)), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], names=[*kept, "n_lines", "n_dropped", "kept_sha256"])

    return documents.mapInArrow(run, schema)
