"""Suffix-array dedup: exact repeated byte strings by distributed prefix doubling over sampled positions.

Every string of ``min_bytes`` (L) that starts at two places is removed from both.  Ranking all byte positions by doubling
would sort a rank pair for each byte of the corpus nine times over; here ranks are kept for the few positions that decide:

* A position is sampled when the hash of the ``k`` bytes at it (k about L / 20) is least within some window of w = L - k + 1
  positions.  Each string of L bytes has such a position inside, at the same place in every copy.
* A node is a sampled position with a range of start offsets of strings around it.  The bytes that all strings of the range
  share are its core, all their bytes together its union; both have names, hashes that stand for ranks.  The first nodes are
  the two halves around each position.
* A round ranks: names travel packed in Arrow batches to one of many parts by hash, where they are sorted.  A union found at
  two places settles the node, all its strings are repeated; one node of each such union stays to be compared with.  Of the
  rest, a node stays open if its core is found elsewhere.  Open ranges are cut for the next round, so cores grow towards L
  bytes; after four rounds ranges hold one start, and core and union are the L bytes themselves.

Equal texts are ranked once, as one text; texts of L bytes or more that occur twice are removed whole.  Names that a task
has met twice already are settled there, so a name found everywhere travels once for each task.

Defined results: null text is empty; texts shorter than L bytes lose nothing; repeated rows are copies of each other; a
null or repeated doc_id is fine, rows are matched by text; other columns are not carried; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textbytes as tb

MIN_BYTES = 400
#: Ranges that a range is cut into in each round after the first; the last makes single starts.
CUTS = (4, 4, 1 << 30)
#: Bytes of text for each part that names are dealt to, and repeated names that a task remembers.
PART_BYTES, KNOWN = 8 << 20, 1 << 20
PROP, MULTI = 1, 2


def shape(min_bytes: int) -> tuple[int, int]:
    """Bytes of a sampled position's first rank, and start offsets around it."""
    k = max(1, min_bytes // 20)
    return k, min_bytes - k + 1


def sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    """``op`` over each ``w`` consecutive values, by doubling."""
    span = 1
    while 2 * span <= w:
        a = op(a[:-span], a[span:])
        span *= 2
    return op(a[: len(a) - (w - span)], a[w - span :]) if span < w else a


def halves(min_bytes: int) -> tuple[tuple[int, int], ...]:
    """Start offsets of the two halves around a sampled position."""
    w = shape(min_bytes)[1]
    return ((0, w // 2 - 1), (w // 2, w - 1)) if w > 1 else ((0, 0),)


def sample(data: np.ndarray, offsets: np.ndarray, ranges: tb.RangeHash, min_bytes: int) -> np.ndarray:
    """Sampled positions of all rows together."""
    k, w = shape(min_bytes)
    n = len(data)
    if n < min_bytes:
        return np.zeros(0, np.int64)
    low = (tb.mix((ranges.sums[k:] - ranges.sums[:-k]) * ranges.down[: n - k + 1]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = sliding(low, w, np.minimum)
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    least[end - np.arange(len(least)) < min_bytes] = 0
    pad = np.zeros(w - 1, np.uint32)
    return np.flatnonzero(sliding(np.concatenate((pad, least, pad)), w, np.maximum) == low)


def children(lo: np.ndarray, hi: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, low and high offset of the ranges that each range is cut into."""
    size = -(-(hi - lo + 1) // cut)
    count = -(-(hi - lo + 1) // size)
    of = np.repeat(np.arange(len(lo)), count)
    step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    low = lo[of] + step * size[of]
    return of, low, np.minimum(low + size[of] - 1, hi[of])


def names(data: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, beg: np.ndarray, end: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The names of nodes that have a start inside their text ``beg:end``: core (64 bits), union (128 bits).

    A union ends where the text does: its name tells the starts that it stands for, so texts with the same beginning or end
    share it."""
    first, last = np.maximum(lo, pos + min_bytes - end), np.minimum(hi, pos - beg)
    salt = lambda a, b, kind: tb.mix(((a.astype(np.uint64) << np.uint64(32)) + b.astype(np.uint64)) * np.uint64(4) + np.uint64(kind))
    union = salt(first, last, 2)
    one, two = tb.RangeHash(data), tb.RangeHash(data, 1)
    core = tb.mix(one(pos - lo, pos - hi + min_bytes) + salt(lo, hi, 1))
    return core, *(tb.mix(lane(pos - last, pos - first + min_bytes) + union) for lane in (one, two))


_NODE = (("t", "<i8"), ("pos", "<i4"), ("lo", "<i4"), ("hi", "<i4"), ("flag", "u1"), ("core", "<u8"), ("u1", "<u8"), ("u2", "<u8"))
_OPEN, _LEFT, _SPAN = (*_NODE[:6],), (*_NODE[1:5],), (("start", "<i4"), ("end", "<i4"))


def pack(kinds: tuple, columns: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(c.astype(kind, copy=False)).tobytes() for c, (_, kind) in zip(columns, kinds))


def unpack(kinds: tuple, values: list[bytes]) -> list[np.ndarray]:
    """The columns of all values together."""
    width, out = sum(np.dtype(kind).itemsize for _, kind in kinds), []
    for value in values:
        n, at = len(value) // width, 0
        cols = []
        for _, kind in kinds:
            cols.append(np.frombuffer(value, kind, n, at))
            at += n * np.dtype(kind).itemsize
        out.append(cols)
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, kind) for _, kind in kinds]


def dealt(key: np.ndarray, kinds: tuple, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """The rows packed for each value of ``key``."""
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.diff(key[order], prepend=~key[order][:1]))
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(key)]):
        at = order[a:b]
        yield int(key[at[0]]), pack(kinds, [c[at] for c in columns])


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by ``keys``, and for each place of it: does a group of equal leading keys (all but the last two, which tell the
    node's place) begin; does a new place begin."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys[:-2]:
        new |= np.diff(key[order], prepend=~key[order][:1]) != 0
    place = new.copy()
    for key in keys[-2:]:
        place |= np.diff(key[order], prepend=~key[order][:1]) != 0
    return order, new, place


def _rows(part: list[int], t: list[int], value: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(t, pa.int64()), pa.array(value, pa.binary())], names=["part", "t", "value"])


def _spans(t: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, min_bytes: int) -> Iterator[tuple[int, bytes]]:
    """Settled nodes as spans of their texts."""
    return dealt(t, _SPAN, [np.maximum(pos - hi, 0), pos - lo + min_bytes])


def _named(texts: DataFrame, min_bytes: int, cut: int, parts: int) -> DataFrame:
    """``part, t, value``: nodes with their names by parts, and spans of nodes settled here (part -1, with their text).
    ``texts``: t, text, and for rounds after the first the nodes to cut."""

    def first(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, ...]:
        at = sample(data, edge, tb.RangeHash(data), min_bytes)
        ends = np.array(halves(min_bytes))
        n, row = len(ends), tb.row_of(at, edge)
        lo, hi = np.repeat(ends[:, 0], len(at)), np.repeat(ends[:, 1], len(at))
        return np.tile(row, n), np.tile(at, n), lo, hi, np.zeros(n * len(at), np.uint8)

    def later(lists: pa.Array, edge: np.ndarray) -> tuple[np.ndarray, ...]:
        found = [unpack(_LEFT, x) for x in lists.to_pylist()]
        row = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
        pos, lo, hi, flag = (np.concatenate(c).astype(np.int64) for c in zip(*found))
        # copies of one text may have sent a node twice
        once = np.unique(np.stack((row, pos, lo, hi, flag), 1), axis=0, return_index=True)[1]
        row, pos, lo, hi, flag = (c[once] for c in (row, pos, lo, hi, flag))
        of, lo, hi = children(lo, hi, cut)
        return row[of], pos[of] + edge[row[of]], lo, hi, flag[of].astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = tb.text_bytes(batch.column(1))
            for a, b in tb.chunks(offsets):
                body, edge = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                row, pos, lo, hi, flag = first(body, edge) if cut == 0 else later(batch.column(2).slice(a, b - a), edge)
                use = np.zeros(b - a, bool)
                for i, t in enumerate(ids[a:b].tolist()):
                    use[i] = t not in seen
                    seen.add(t)
                beg, end = edge[row], edge[row + 1]
                alive = np.flatnonzero(use[row] & (pos - lo >= beg) & (pos - hi + min_bytes <= end))
                row, pos, lo, hi, flag, beg, end = (c[alive] for c in (row, pos, lo, hi, flag, beg, end))
                core, u1, u2 = names(body, pos, lo, hi, beg, end, min_bytes)
                core[lo == hi] = 0  # single starts are ranked by their unions alone
                t, pos = ids[a:b][row], pos - beg
                order, new, _ = groups(u1, u2, t, pos)
                size = np.diff(np.append(np.flatnonzero(new), len(order)))
                many, leads = np.empty(len(order), bool), np.empty(len(order), bool)
                many[order], leads[order] = np.repeat(size > 1, size), new
                met = np.fromiter((x in known for x in u1.tolist()), bool, len(u1))
                if len(known) < KNOWN:
                    known.update(u1[leads & many & ~met].tolist())
                settled = (met | ~leads) & (flag & PROP == 0)
                done = list(_spans(t[settled], pos[settled], lo[settled], hi[settled], min_bytes))
                yield _rows([-1 - x % parts for x, _ in done], [x for x, _ in done], [v for _, v in done])
                go = leads & ~met
                cols = [c[go] for c in (t, pos, lo, hi, flag | many.astype(np.uint8) * np.uint8(MULTI), core, u1, u2)]
                out = list(dealt((cols[6] % np.uint64(parts)).astype(np.int64), _NODE, cols))
                yield _rows([x for x, _ in out], [0] * len(out), [v for _, v in out])

    return texts.mapInArrow(run, "part int, t long, value binary")


def _by_union(named: DataFrame, min_bytes: int, parts: int) -> DataFrame:
    """``part, t, value``: nodes that are open or stand for a repeated union, by the parts of their cores; spans as before."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key[0].as_py() < 0:
            yield from batches
            return
        cols = unpack(_NODE, [v for batch in batches for v in batch.column(2).to_pylist()])
        t, pos, lo, hi, flag, core, u1, u2 = cols
        order, new, place = groups(u1, u2, t, pos)
        t, pos, lo, hi, flag, core = (c[order] for c in (t, pos, lo, hi, flag, core))
        of = np.cumsum(new) - 1
        hit = ((np.bincount(of, place) > 1) | (np.bincount(of, flag & MULTI > 0) > 0))[of]
        settled = hit & (flag & PROP == 0)
        out = [(-1, x, v) for x, v in _spans(t[settled], pos[settled], lo[settled], hi[settled], min_bytes)]
        go = np.flatnonzero((~hit | new) & (lo < hi))
        flag = np.where(hit, PROP, flag & PROP).astype(np.uint8)
        out += [(x, 0, v) for x, v in dealt((core[go] % np.uint64(parts)).astype(np.int64), _OPEN, [c[go] for c in (t, pos, lo, hi, flag, core)])]
        for i in range(0, len(out), 20_000):
            yield _rows(*map(list, zip(*out[i : i + 20_000])))

    return named.groupBy("part").applyInArrow(run, "part int, t long, value binary")


def _by_core(nodes: DataFrame) -> DataFrame:
    """``t, value``: the nodes of each text that go into the next round."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, pos, lo, hi, flag, core = unpack(_OPEN, [v for batch in batches for v in batch.column(2).to_pylist()])
        order, new, place = groups(core, t, pos)
        t, pos, lo, hi, flag = (c[order] for c in (t, pos, lo, hi, flag))
        of = np.cumsum(new) - 1
        go = (np.bincount(of, place) > 1) & (np.bincount(of, flag == 0) > 0)
        stay = np.flatnonzero(go[of])
        rows = list(dealt(t[stay], _LEFT, [c[stay] for c in (pos, lo, hi, flag)]))
        for i in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows[i : i + 20_000]], pa.int64()), pa.array([v for _, v in rows[i : i + 20_000]], pa.binary())], names=["t", "value"])

    return nodes.groupBy("part").applyInArrow(run, "t long, value binary")


def repeated_spans(texts: DataFrame, min_bytes: int = MIN_BYTES, parts: int = 1) -> tuple[DataFrame, DataFrame]:
    """``t, value`` (packed spans) of repeated strings, covering all of them, for the distinct texts of ``t, doc_id, text`` rows; and
    the rows ``t, text`` that have any."""
    state, rows, spans, held = texts.select("t", "text"), None, None, []
    for cut in (0, *CUTS):
        found = scratch.keep(_by_union(_named(state, min_bytes, cut, parts), min_bytes, parts), "ranked")
        done = scratch.keep(found.where("part < 0").select("t", "value"), "spans")
        spans = done if spans is None else spans.union(done)
        if cut == CUTS[-1]:
            scratch.drop(found)
            break
        left = scratch.keep(_by_core(found.where("part >= 0")).groupBy("t").agg(F.collect_list("value").alias("nodes")), "nodes")
        scratch.drop(found, *held)
        held = [left]
        if rows is None:
            wanted = done.select("t").union(left.select("t")).distinct()
            one = texts.groupBy("t").agg(F.min("doc_id").alias("rep")).join(wanted, "t")
            one = scratch.keep(one, "wanted")
            same = (texts["t"] == one["t"]) & texts["doc_id"].eqNullSafe(one["rep"])
            rows = scratch.keep(texts.join(one, same).select(texts["t"], texts["text"]), "texts")
            scratch.drop(one)
        # a row of one id and text may be there more than once; a task names a text once, and names of one place are one
        state = rows.join(left, "t")
    return spans, rows


def suffix_dedup(documents: DataFrame, min_bytes: int = MIN_BYTES, text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``removed`` (the spans, end exclusive) of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    texts = documents.select("doc_id", body.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("t"))
    meta = scratch.keep(texts.select("doc_id", "t", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")), "rows")
    parts = 1 + (meta.agg(F.sum("n_bytes")).first()[0] or 0) // PART_BYTES
    spans, rows = repeated_spans(texts, min_bytes, parts)
    by_text = spans.groupBy("t").agg(F.collect_list("value").alias("s"))
    cut = rows.join(by_text, "t").select("t", "text", "s").mapInArrow(_cut, _CUT)
    cut = cut.groupBy("t", "n_bytes").agg(F.first("n_removed").alias("n_removed"), F.first("kept").alias("kept"), F.first("removed").alias("removed"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= min_bytes)
    all_of = F.array(F.struct(F.lit(0).cast("int").alias("start"), F.col("n_bytes").cast("int").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    verdicts = meta.groupBy("t", "n_bytes").agg(F.count("*").alias("copies")).join(cut, ["t", "n_bytes"], "left").select(
        "t", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("kept")).alias("kept"),
        F.when(whole, all_of).otherwise(F.coalesce("removed", none)).alias("removed"),
    )
    verdicts = scratch.keep(verdicts, "verdicts")
    kept = F.coalesce("kept", F.lower(F.hex("sha"))).alias("kept_sha256")
    return meta.join(verdicts, ["t", "n_bytes"]).select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), kept, "removed")


_CUT = "t long, n_bytes long, n_removed long, kept string, removed array<struct<start:int,end:int>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge each text's spans and hash what they leave."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        data, offsets = tb.text_bytes(batch.column(1))
        counts, kept, removed = [], [], []
        for i in range(batch.num_rows):
            body = data[offsets[i] : offsets[i + 1]]
            start, end = unpack(_SPAN, batch.column(2)[i].as_py())
            edge = np.zeros(len(body) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, np.minimum(end, len(body)), -1)
            gone = np.cumsum(edge[:-1]) > 0
            ends = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])).astype(np.int8)))
            counts.append(int(gone.sum()))
            kept.append(hashlib.sha256(body[~gone].tobytes()).hexdigest())
            removed.append([{"start": int(a), "end": int(b)} for a, b in zip(ends[::2], ends[1::2])])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets)), pa.array(counts, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, span)], names=["t", "n_bytes", "n_removed", "kept", "removed"]
        )
