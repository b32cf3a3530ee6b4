"""A paired Poisson bootstrap from sketches that merge by adding.

A row draws its Poisson(1) counts for all repetitions from hashes of its id, so any partitioning draws the same.  A sketch is a
histogram of scores over fixed edges; each of its cells holds the counts of all repetitions in an array.  Tasks fill sketches and
send these, never rows or repetitions, so what is shuffled depends on the number of tasks and repetitions only.

A repetition's boundary is the score at which its negatives pass the cap.  The first sketch finds the bin that it lies in; the next
one cuts just these bins by 256 again, and so on until each boundary's bin holds one distinct score.  Edges are cut in the order-preserving
whole-number form of doubles, so this ends for any scores, mostly after the second sketch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsieve.operators.metrics import linear_percentile

BINS = 256
#: Modulus, multipliers and shifts of the draws, which are plain whole-number arithmetic, so that SQL can repeat them.
MODULUS, MIX, SHIFTS = 2147483647, (48271, 69621, 40692), (15, 13, 16)
#: A draw from 0 to ``MODULUS`` - 1 has as many events as cuts that are not above it: Poisson(1).
CUTS = tuple(int(MODULUS * c) for c in np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(12)]))
#: Rows whose draws are made together.
_BLOCK = 512


def draws(ids: np.ndarray, reps: int) -> np.ndarray:
    """Poisson(1) counts, a row for each id and a column for each repetition."""
    h = ((ids.astype(np.int64) % MODULUS * MIX[0] % MODULUS)[:, None] + np.arange(1, reps + 1) * MIX[1]) % MODULUS
    for shift, by in zip(SHIFTS, MIX):
        h = (h ^ (h >> shift)) * by % MODULUS
    return np.searchsorted(np.array(CUTS), h, "right").astype(np.int32)


def ordered(scores: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order."""
    bits = (scores + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _sketch(df: DataFrame, reps: int, spans: dict[int, list[tuple[int, int]]]) -> dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, int, int]]:
    """For each side, span and bin: positives and negatives of each repetition, and the least and greatest score.  A span is a
    first number and a width of bins."""
    shared = df.sparkSession.sparkContext.broadcast(spans)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            ids, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            keys = [ordered(batch.column(2 + side).to_numpy(zero_copy_only=False).astype(float)) for side in (0, 1)]
            for at in range(0, len(ids), _BLOCK):
                w, label = draws(ids[at : at + _BLOCK], reps), y[at : at + _BLOCK]
                for side, these in shared.value.items():
                    key = keys[side][at : at + _BLOCK]
                    for s, (first, width) in enumerate(these):
                        inside = np.flatnonzero((key >= np.uint64(first)) & ((key - np.uint64(first)) // np.uint64(width) < BINS))
                        place = ((key[inside] - np.uint64(first)) // np.uint64(width)).astype(int)
                        for b in np.unique(place):
                            rows = inside[place == b]
                            cell = got.setdefault((side, s, int(b)), [np.zeros((2, reps), np.int64), (1 << 64) - 1, 0])
                            for c in (0, 1):
                                cell[0][c] += w[rows[label[rows] == c]].sum(axis=0)
                            cell[1], cell[2] = min(cell[1], int(key[rows].min())), max(cell[2], int(key[rows].max()))
        if got:
            side, span, b = zip(*got)
            yield pa.RecordBatch.from_pydict({
                "side": pa.array(side, pa.int32()), "span": pa.array(span, pa.int32()), "bin": pa.array(b, pa.int32()), "sums": pa.array([c[0].tobytes() for c in got.values()], pa.binary()),
                "low": pa.array([str(c[1]).zfill(20) for c in got.values()]), "high": pa.array([str(c[2]).zfill(20) for c in got.values()]),
            })

    def merge(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x, np.int64) for x in table["sums"].to_pylist())
        one = {c: table[c][:1] for c in ("side", "span", "bin")}
        return pa.table(one | {"sums": pa.array([sums.tobytes()], pa.binary()), "low": pa.array([min(table["low"].to_pylist())]), "high": pa.array([max(table["high"].to_pylist())])})

    schema = "side int, span int, bin int, sums binary, low string, high string"
    rows = df.mapInArrow(fill, schema).groupBy("side", "span", "bin").applyInArrow(merge, schema).collect()
    return {(r["side"], r["span"], r["bin"]): (*np.frombuffer(r["sums"], np.int64).reshape(2, reps)[::-1], int(r["low"]), int(r["high"])) for r in rows}


def recalls(df: DataFrame, cap: float, reps: int, a: str, b: str, id_: str) -> np.ndarray:
    """Recall of both scores under the cap, a row for each score and a column for each repetition; NaN without positives."""
    rows = df.select(F.col(id_).cast("long").alias("id"), F.col("y").cast("int").alias("y"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    limits = rows.agg(*(f(s).alias(f"{n}{s}") for s in ("a", "b") for n, f in (("min", F.min), ("max", F.max)))).first()
    out = np.full((2, reps), np.nan)
    if limits["mina"] is None:
        return out
    everyone = np.arange(reps)
    open_: dict[int, list] = {}
    for side, s in enumerate(("a", "b")):
        low, high = (int(ordered(np.array([float(limits[f"{n}{s}"])]))[0]) for n in ("min", "max"))
        # repetitions in a span, with what lies above it
        open_[side] = [((low, -(-(high - low + 1) // BINS)), everyone, np.zeros(reps, np.int64), np.zeros(reps, np.int64))]
    allowed = total = None
    caught = np.zeros((2, reps), np.int64)
    while any(open_.values()):
        got = _sketch(rows, reps, {side: [x[0] for x in these] for side, these in open_.items() if these})
        if allowed is None:
            total = sum((c[0] for (side, *_), c in got.items() if side == 0), np.zeros(reps, np.int64))
            negatives = sum((c[1] for (side, *_), c in got.items() if side == 0), np.zeros(reps, np.int64))
            allowed = np.floor(cap * negatives).astype(np.int64)
        after: dict[int, list] = {0: [], 1: []}
        for side, these in open_.items():
            for s, ((first, width), who, pos, neg) in enumerate(these):
                pos, neg, left = pos.copy(), neg.copy(), np.ones(len(who), bool)
                for at in range(BINS - 1, -1, -1):
                    cell = got.get((side, s, at))
                    if cell is None or not left.any():
                        continue
                    p, n, low, high = cell
                    fits = left & (neg + n[who] <= allowed[who])
                    # the bin where a repetition's negatives pass what is allowed
                    over = left & ~fits
                    if over.any():
                        if low < high:
                            after[side].append(((low, -(-(high - low + 1) // BINS)), who[over], pos[over], neg[over]))
                        else:
                            caught[side, who[over]] = pos[over]
                        left &= ~over
                    pos[fits] += p[who[fits]]
                    neg[fits] += n[who[fits]]
                caught[side, who[left]] = pos[left]
        open_ = after
    return np.where(total > 0, caught / np.maximum(total, 1), np.nan)


def bootstrap_gain(df: DataFrame, cap: float = 0.05, reps: int = 200, a: str = "p", b: str = "p2", id_: str = "id") -> DataFrame:
    """``mean, ci_lo, ci_hi`` of the gain in recall of score ``b`` over ``a``, each at the lowest threshold whose false-positive rate
    is at most ``cap`` in the repetition.  ``id_``: a whole number that tells the rows apart."""
    one, two = recalls(df, cap, reps, a, b, id_)
    gain = np.sort((two - one)[~np.isnan(two - one)])
    row = (float(gain.mean()), linear_percentile(gain, 0.025), linear_percentile(gain, 0.975)) if len(gain) else (None, None, None)
    return df.sparkSession.createDataFrame([row], "mean double, ci_lo double, ci_hi double")
