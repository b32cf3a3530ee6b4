"""Histogram boosting of trees for two classes, grown best leaf first over distributed gradient histograms.

* Columns become bins of one byte (0: null or NaN), cut at quantiles of one aggregate.  Rows with equal bins and label are one cell
  with their number and weight: that is all a tree can see of them.
* A leaf's histogram holds, for each column and bin, the sums of gradients, hessians, weights and rows of its cells.  Of two
  siblings only the smaller one is counted; the other is their parent's less that one.
* The leaf of the greatest gain is split first, up to ``leaves``.  To take one aggregate a level instead of one a split, the
  choice is played through with what is known: leaves that are chosen and have no known children are counted together, until
  none is left.  What is counted ahead but not chosen in the end is cut off again.
* Sums are whole numbers (``SCALE`` to the unit), so they are the same for any order of rows and any partitioning, and so are the trees.
  They are exact for about 2^29 rows of weight one in a partition and 2^38 in all.

Cells stay a table; each round reads it once a level and writes its scores anew.  Up to ``local_cells`` cells (about 30 bytes each)
the same steps run over arrays instead, with the same result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsieve.sources.tables import drop_table, keep_table

SCALE = 1 << 24
#: What a histogram sums up.
GRADIENT, HESSIAN, WEIGHT, ROWS = range(4)


@dataclass(frozen=True)
class Boosting:
    """Parameters, and ``fit``.  ``depth`` 0: no limit.  ``rows``, ``columns``: shares that each tree sees, drawn by seeded hashes
    (of a cell of n rows, n times the share, rounded up or down by the hash).  ``newton``: gains weigh by hessians, otherwise by
    weights, as in boosting of residuals; leaf values come from one Newton step either way."""

    rounds: int = 300
    rate: float = 0.1
    leaves: int = 31
    depth: int = 0
    min_rows: int = 20
    min_hessian: float = 1e-3
    l2: float = 0.0
    rows: float = 1.0
    columns: float = 1.0
    newton: bool = True
    bins: int = 255
    seed: int = 42
    local_cells: int = 1 << 18

    def fit(self, df: DataFrame, columns: Sequence[str], label: str = "y", weight: str | None = "w") -> BoostedTrees:
        columns = list(columns)
        edges = quantile_edges(df, columns, self.bins)
        cells = keep_table(binned_cells(df, columns, edges, label, weight), "boosting-cells")
        total = cells.agg(F.sum("w").alias("w"), F.sum(F.when(F.col("y") == 1, F.col("w"))).alias("pos"), F.count("*").alias("n")).first()
        share = min(max((total["pos"] or 0) / (total["w"] or 1), 1e-9), 1 - 1e-9)
        model = BoostedTrees(columns, edges, float(np.log(share / (1 - share))), self.rate)
        if not total["n"]:
            return model
        source = _Arrays(cells, self) if total["n"] <= self.local_cells else _Table(cells, self)
        source.start(model.base)
        for number in range(self.rounds):
            tree = grow(source, self, len(columns), number)
            model.trees.append(tree)
            source.add(tree)
        source.close()
        return model


@dataclass
class Tree:
    """Nodes in parallel lists; a node goes left where the column's bin is at most ``cut``.  Leaves have left -1."""

    column: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def node(self) -> int:
        for part, x in ((self.column, 0), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            part.append(x)
        return len(self.left) - 1

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The node without children that each row of ``bins`` reaches."""
        column, cut, left, right = (np.array(x) for x in (self.column, self.cut, self.left, self.right))
        at, open_ = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(open_):
            open_ = open_[left[at[open_]] >= 0]
            here = at[open_]
            at[open_] = np.where(bins[open_, column[here]] <= cut[here], left[here], right[here])
        return at


@dataclass
class BoostedTrees:
    columns: list[str]
    edges: list[list[float]]
    base: float
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for t in self.trees:
            out += self.rate * np.array(t.value)[t.leaf(bins)]
        return out

    def scored(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` and ``p``, the probability of class 1."""
        model, n = df.sparkSession.sparkContext.broadcast(self), len(keep)
        schema = df.select(*keep).schema.add("p", "double")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = model.value
            for b in batches:
                p = 1 / (1 + np.exp(-m.margins(bins_of(b, n, m.edges))))
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(p)], names=[*keep, "p"])

        return df.select(*keep, *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(self.columns))).mapInArrow(score, schema)

    def importances(self) -> dict[str, float]:
        """The share of splits that use each column."""
        used = np.bincount([c for t in self.trees for c, left in zip(t.column, t.left) if left >= 0], minlength=len(self.columns))
        return dict(zip(self.columns, (used / max(1, used.sum())).tolist()))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> BoostedTrees:
        d = json.loads(text)
        return cls(**d | {"trees": [Tree(**t) for t in d["trees"]]})


def quantile_edges(df: DataFrame, columns: Sequence[str], bins: int = 255) -> list[list[float]]:
    """For each column the greatest values of its bins but the last: all distinct values where these are at most ``bins``,
    distinct quantiles otherwise."""
    if not 2 <= bins <= 255:
        raise ValueError("bins must be 2 to 255")
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    long = df.select(*(value(c).alias(f"q{i}") for i, c in enumerate(columns))).unpivot([], [f"q{i}" for i in range(len(columns))], "c", "v")
    distinct = long.where("v is not null").groupBy("c", "v").agg(F.lit(1).alias("one"))
    few = distinct.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") <= bins)
    found: dict[str, set[float]] = {}
    for r in distinct.join(F.broadcast(few), "c").select("c", "v").collect():  # at most ``bins`` values of each column
        found.setdefault(r["c"], set()).add(r["v"])
    at = F.array(*(F.lit(k / bins) for k in range(1, bins + 1)))
    row = df.agg(*(F.percentile_approx(value(c), at, 100_000).alias(f"q{i}") for i, c in enumerate(columns))).first()
    return [sorted(found.get(f"q{i}", set(q or [])))[:-1] for i, q in enumerate(row)]


def bins_of(batch: pa.RecordBatch, skip: int, edges: list[list[float]]) -> np.ndarray:
    """A byte for each row and column after the first ``skip``."""
    out = np.zeros((batch.num_rows, len(edges)), np.uint8)
    for i, e in enumerate(edges):
        v = batch.column(skip + i).to_numpy(zero_copy_only=False).astype(float)
        out[:, i] = np.where(np.isnan(v), 0, 1 + np.searchsorted(np.array(e), v))
    return out


def binned_cells(df: DataFrame, columns: Sequence[str], edges: list[list[float]], label: str, weight: str | None) -> DataFrame:
    """``bins, y, n, w``: the cells, with their rows and their weight in units of 1 / ``SCALE``."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    rows = df.select(F.col(label).cast("int").alias("y"), F.rint(w * SCALE).cast("long").alias("w"), *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body = bins_of(b, 2, edges)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in body], pa.binary()), b.column(0), b.column(1)], names=["bins", "y", "w"])

    return rows.mapInArrow(cut, "bins binary, y int, w long").groupBy("bins", "y").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


def _unit(bins: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """A number below 1 for each cell, by a hash of its bins, label and the seed."""
    h = y.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & (1 << 64) - 1)
    for c in bins.T:
        h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(11)).astype(float) / (1 << 53)


def histograms(bins: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray, margin: np.ndarray, tree: Tree, wanted: Sequence[int], p: Boosting, number: int) -> np.ndarray:
    """Sums over some cells by wanted node, column and bin (256), in whole numbers."""
    slot = np.full(len(tree.left), -1)
    slot[list(wanted)] = np.arange(len(wanted))
    at = slot[tree.leaf(bins)]
    drawn = n.astype(float) if p.rows >= 1 else np.floor(n * p.rows + _unit(bins, y, p.seed * 100_003 + number))
    inside = (at >= 0) & (drawn > 0)
    at, body, y, w, drawn = at[inside], bins[inside], y[inside], (w / SCALE * drawn / n)[inside], drawn[inside]
    q = 1 / (1 + np.exp(-margin[inside]))
    units = [np.rint(x * SCALE) for x in (w * (q - y), w * q * (1 - q), w)] + [drawn]
    out = np.zeros((len(wanted), bins.shape[1], 256, 4), np.int64)
    for c in range(bins.shape[1]):
        place = at * 256 + body[:, c]
        for k, x in enumerate(units):
            out[:, c, :, k] = np.bincount(place, x, 256 * len(wanted)).reshape(-1, 256).astype(np.int64)
    return out


class _Arrays:
    """Cells as arrays."""

    def __init__(self, cells: DataFrame, p: Boosting):
        rows = cells.toArrow().to_pydict()  # at most local_cells
        drop_table(cells)
        self.p = p
        self.bins = np.frombuffer(b"".join(rows["bins"]), np.uint8).reshape(len(rows["bins"]), -1)
        self.y, self.n, self.w = (np.array(rows[c]) for c in ("y", "n", "w"))

    def start(self, base: float) -> None:
        self.margin = np.full(len(self.y), base)

    def histograms(self, tree: Tree, wanted: Sequence[int], number: int) -> np.ndarray:
        return histograms(self.bins, self.y, self.n, self.w, self.margin, tree, wanted, self.p, number)

    def add(self, tree: Tree) -> None:
        self.margin += self.p.rate * np.array(tree.value)[tree.leaf(self.bins)]

    def close(self) -> None:
        pass


class _Table:
    """Cells as a table with their scores so far."""

    def __init__(self, cells: DataFrame, p: Boosting):
        self.p, self.cells = p, cells

    def _with(self, made: DataFrame) -> None:
        old, self.cells = self.cells, keep_table(made, "boosting-scores")
        drop_table(old)

    def start(self, base: float) -> None:
        self._with(self.cells.withColumn("margin", F.lit(base)))

    def histograms(self, tree: Tree, wanted: Sequence[int], number: int) -> np.ndarray:
        p = self.p

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                bins = np.stack([np.frombuffer(x, np.uint8) for x in b.column("bins").to_pylist()]) if b.num_rows else np.zeros((0, 1), np.uint8)
                y, n, w, margin = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "n", "w", "margin"))
                got = histograms(bins, y, n, w, margin, tree, wanted, p, number) if b.num_rows else 0
                total = got if total is None else total + got
            if isinstance(total, np.ndarray):
                for k in range(total.shape[0]):
                    keys = np.arange(total.shape[1])
                    yield pa.RecordBatch.from_pydict({"node": pa.array(np.full(len(keys), k, np.int32)), "col": pa.array(keys.astype(np.int32)), "sums": pa.array([x.tobytes() for x in total[k]], pa.binary())})

        def merge(table: pa.Table) -> pa.Table:
            whole = sum(np.frombuffer(x, np.int64) for x in table["sums"].to_pylist())
            return pa.table({"node": table["node"][:1], "col": table["col"][:1], "sums": pa.array([whole.tobytes()], pa.binary())})

        rows = self.cells.mapInArrow(count, "node int, col int, sums binary").groupBy("node", "col").applyInArrow(merge, "node int, col int, sums binary").collect()
        width = 1 + max(r["col"] for r in rows)
        out = np.zeros((len(wanted), width, 256, 4), np.int64)
        for r in rows:
            out[r["node"], r["col"]] = np.frombuffer(r["sums"], np.int64).reshape(256, 4)
        return out

    def add(self, tree: Tree) -> None:
        rate, kind = self.p.rate, self.cells.schema

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    bins = np.stack([np.frombuffer(x, np.uint8) for x in b.column("bins").to_pylist()])
                    margin = b.column("margin").to_numpy(zero_copy_only=False) + rate * np.array(tree.value)[tree.leaf(bins)]
                    yield b.set_column(b.schema.get_field_index("margin"), "margin", pa.array(margin))

        self._with(self.cells.mapInArrow(move, kind))

    def close(self) -> None:
        drop_table(self.cells)


def best_split(sums: np.ndarray, p: Boosting, allowed: np.ndarray) -> tuple[float, int, int]:
    """Gain, column and cut of a node's best split, the first of equal ones; gain 0 where there is none."""
    left = np.cumsum(sums, axis=1)[:, :-1] / np.array([SCALE, SCALE, SCALE, 1])
    whole = sums[0].sum(axis=0) / np.array([SCALE, SCALE, SCALE, 1])
    right = whole - left
    by = HESSIAN if p.newton else WEIGHT
    part = lambda s: s[..., GRADIENT] ** 2 / np.maximum(s[..., by] + p.l2, 1e-12)
    gain = part(left) + part(right) - part(whole)
    ok = allowed[:, None] & (left[..., ROWS] >= p.min_rows) & (right[..., ROWS] >= p.min_rows) & (left[..., ROWS] > 0) & (right[..., ROWS] > 0)
    ok &= (left[..., HESSIAN] >= p.min_hessian) & (right[..., HESSIAN] >= p.min_hessian)
    gain = np.where(ok, gain, 0)
    best = int(np.argmax(gain))
    column, cut = divmod(best, gain.shape[1])
    return float(gain[column, cut]), column, cut


def grow(source: _Arrays | _Table, p: Boosting, width: int, number: int) -> Tree:
    """The next tree."""
    allowed = np.ones(width, bool)
    if p.columns < 1:
        allowed[:] = False
        allowed[np.random.default_rng((p.seed, number)).permutation(width)[: max(1, round(p.columns * width))]] = True
    tree, split, sums, depth = Tree(), {}, {}, {}

    def known(node: int, got: np.ndarray, level: int) -> None:
        sums[node], depth[node] = got, level
        split[node] = best_split(got, p, allowed) if not p.depth or level < p.depth else (0.0, 0, 0)

    tree.node()
    known(0, source.histograms(tree, [0], number)[0], 0)
    while True:
        chosen, open_, heap = [], [], [(-split[0][0], 0)]
        while heap and len(chosen) + 1 < p.leaves:
            gain, node = heapq.heappop(heap)
            if -gain <= 1e-9:
                break
            chosen.append(node)
            if tree.left[node] < 0:
                open_.append(node)
            else:
                for x in (tree.left[node], tree.right[node]):
                    heapq.heappush(heap, (-split[x][0], x))
        if not open_:
            break
        asked = []
        for node in open_:
            _, tree.column[node], tree.cut[node] = split[node]
            tree.left[node], tree.right[node] = tree.node(), tree.node()
            rows = sums[node][tree.column[node], :, ROWS]
            small_left = 2 * rows[: tree.cut[node] + 1].sum() <= rows.sum()
            asked.append((node, *((tree.left[node], tree.right[node]) if small_left else (tree.right[node], tree.left[node]))))
        for (node, small, large), got in zip(asked, source.histograms(tree, [x[1] for x in asked], number)):
            known(small, got, depth[node] + 1)
            known(large, sums[node] - got, depth[node] + 1)
    for node in set(range(len(tree.left))) - set(chosen):
        tree.left[node] = tree.right[node] = -1
        whole = sums[node][0].sum(axis=0) / SCALE
        tree.value[node] = float(-whole[GRADIENT] / max(whole[HESSIAN] + p.l2, 1e-12))
    return tree
