"""Leaf-bounded histogram boosting: rows become counted cells of bins, and every grid point and fold is fitted in a task of its own."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import stored
from .metrics import weighted_average_precision
from .models import Frozen, freeze_medians, group_folds

#: The declared grid and its learning rate, penalty, bins and least rows of a leaf.
GRID = [{"leaves": 3, "rounds": 100}, {"leaves": 7, "rounds": 100}, {"leaves": 7, "rounds": 200}, {"leaves": 15, "rounds": 200}]
RATE, PENALTY, BINS, LEAST_IN_LEAF = 0.05, 1.0, 255, 20


def edges_of(rows: DataFrame, inputs: list[str], bins: int) -> list[np.ndarray]:
    """Upper edges of each input's bins but the last: midpoints of distinct values where there are at most `bins`, else quantiles."""
    out = []
    for c in inputs:
        few = sorted(r[0] for r in rows.select(c).distinct().limit(bins + 1).collect())
        if len(few) <= bins:
            x = np.array(few, float)
            out.append((x[1:] + x[:-1]) / 2)
        else:
            out.append(np.unique(rows.approxQuantile(c, [k / bins for k in range(1, bins)], 0.1 / bins)))
    return out


def cells_of(rows: DataFrame, inputs: list[str], edges: list[np.ndarray], keys: list[str]) -> DataFrame:
    """(keys, bins, n): how many rows fall into each cell; tasks count first, so a hot cell costs one row a task."""
    place = lambda c, e: F.size(F.filter(F.array(*[F.lit(float(x)) for x in e]).cast("array<double>"), lambda x: x < F.col(c)))
    return rows.select(*keys, F.array(*[place(c, e) for c, e in zip(inputs, edges, strict=True)]).cast("array<int>").alias("bins")).groupBy(*keys, "bins").agg(F.count("*").alias("n"))


@dataclass
class Trees:
    """Boosted trees over bins. A node is (input, last bin that goes left, left, right, value); leaves have input -1."""

    base: float
    trees: list[np.ndarray]

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        rows = np.arange(len(bins))
        for t in self.trees:
            at = np.zeros(len(bins), np.int64)
            while True:
                inner = t["input"][at] >= 0
                if not inner.any():
                    break
                left = bins[rows, np.maximum(t["input"][at], 0)] <= t["cut"][at]
                at = np.where(inner, np.where(left, t["left"][at], t["right"][at]), at)
            out += t["value"][at]
        return out


_NODE = np.dtype([("input", "i4"), ("cut", "i4"), ("left", "i4"), ("right", "i4"), ("value", "f8")])


class _Growth:
    """One tree: the leaf of most gain is split first, until there are enough leaves or no split is allowed."""

    def __init__(self, bins: np.ndarray, count: np.ndarray, g: np.ndarray, h: np.ndarray, least: int, penalty: float) -> None:
        self.width = int(bins.max(initial=0)) + 1
        self.inputs = bins.shape[1]
        self.flat = bins + np.arange(self.inputs) * self.width
        self.columns, self.least, self.penalty = (count, g, h), least, penalty

    def histogram(self, rows: np.ndarray) -> np.ndarray:
        at = self.flat[rows].ravel()
        return np.stack([np.bincount(at, np.repeat(c[rows], self.inputs), self.inputs * self.width) for c in self.columns]).reshape(3, self.inputs, self.width)

    def best(self, hist: np.ndarray) -> tuple[float, int, int]:
        """(gain, input, cut); the lowest input and cut on ties."""
        left = np.cumsum(hist, 2)[:, :, :-1]
        if not left.size:
            return 0.0, 0, 0
        total = hist.sum(2, keepdims=True)[:, :1]
        right = total - left
        score = lambda x: x[1] ** 2 / (x[2] + self.penalty)
        gain = np.where((left[0] >= self.least) & (right[0] >= self.least), score(left) + score(right) - score(total), 0.0)
        k = int(gain.argmax())
        return float(gain.ravel()[k]), k // gain.shape[1], k % gain.shape[1]

    def grow(self, leaves: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, value of each row)."""
        nodes, values = [], np.zeros(len(self.flat))
        open_: list[tuple[float, int]] = []
        held: dict[int, tuple] = {}

        def add(rows, hist):
            k = len(nodes)
            _, g, h = hist[:, 0].sum(1)
            nodes.append((-1, 0, 0, 0, -rate * g / (h + self.penalty)))
            gain, where, cut = self.best(hist)
            held[k] = (rows, hist, where, cut)
            if gain > 1e-12:
                heapq.heappush(open_, (-gain, k))
            return k

        every = np.arange(len(self.flat))
        add(every, self.histogram(every))
        while open_ and len(held) < leaves:
            _, k = heapq.heappop(open_)
            rows, hist, where, cut = held.pop(k)
            goes = self.flat[rows, where] - where * self.width <= cut
            a, b = rows[goes], rows[~goes]
            small = self.histogram(a if len(a) <= len(b) else b)  # the sibling's is the difference
            left = add(a, small if len(a) <= len(b) else hist - small)
            right = add(b, hist - small if len(a) <= len(b) else small)
            nodes[k] = (where, cut, left, right, 0.0)
        for k, (rows, *_) in held.items():
            values[rows] = nodes[k][4]
        return np.array(nodes, _NODE), values


def boost(bins: np.ndarray, y: np.ndarray, n: np.ndarray, leaves: int, rounds: int, rate: float = RATE, penalty: float = PENALTY, least: int = LEAST_IN_LEAF) -> Trees:
    """Logistic boosting of balanced classes over counted cells; the same trees as over the rows themselves."""
    total, p = n.sum(), (n * y).sum()
    w = np.where(y == 1, total / (2 * max(p, 1)), total / (2 * max(total - p, 1))) * n
    share = np.clip((w * y).sum() / w.sum(), 1e-9, 1 - 1e-9)
    base = float(np.log(share / (1 - share)))
    z, out = np.full(len(y), base), []
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-z))
        nodes, values = _Growth(bins, n, w * (mu - y), w * mu * (1 - mu), least, penalty).grow(leaves, rate)
        out.append(nodes)
        z += values
    return Trees(base, out)


@dataclass
class FrozenTrees(Frozen):
    edges: list[np.ndarray] | None = None
    trees: Trees | None = None

    def score(self, df: DataFrame) -> DataFrame:
        """df with score; no label is read."""
        kept, inputs, edges, trees = df.schema, self.inputs, self.edges, self.trees
        rows = self.prepare(df).select(*[f"`{c}`" for c in df.columns], *[F.col(c).alias(f"__in{k}") for k, c in enumerate(inputs)])
        names = [*df.columns, "score"]

        def run(batches):
            for b in batches:
                own = b.columns[: len(names) - 1]
                bins = np.stack([np.searchsorted(e, b.column(len(own) + k).to_numpy(zero_copy_only=False), "left") for k, e in enumerate(edges)], 1)
                yield pa.RecordBatch.from_arrays([*own, pa.array(1 / (1 + np.exp(-trees.margin(bins))))], names=names)

        return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"]))


def _arrays(table: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fold, bins, y, n) of a group's cells in a fixed order, so that sums do not depend on how rows arrived."""
    t = pa.Table.from_batches(table)
    bins = t.column("bins").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).astype(np.int64)
    fold, y, n = (t.column(c).to_numpy() for c in ("fold", "y", "n"))
    place = np.lexsort((*bins.T[::-1], y, fold))
    return fold[place], bins[place], y[place].astype(float), n[place].astype(float)


def gbdt_select(history: DataFrame, features: list[str], label: str, group: str, grid: list[dict] | None = None, most_cells: int = 500_000) -> FrozenTrees:
    """Boosted trees by the grid point of best mean average precision over grouped folds; the first declared wins ties; refit on all.

    Rows are binned once and counted by (fold, bins, label), so a fit reads cells, each with its number of rows, and all rows
    take part whatever their number. Where there are more than most_cells cells, inputs get half as many bins, until there
    are not; so a task holds a bounded table. All grid points and folds are fitted side by side, one in a task.
    """
    grid = grid or GRID
    frozen = freeze_medians(history, features)
    rows, k = group_folds(history, group, label)
    rows = stored(frozen.prepare(rows).select(*frozen.inputs, F.col(label).cast("int").alias("y"), "fold"), "boosting")
    bins = BINS
    while True:
        edges = edges_of(rows, frozen.inputs, bins)
        cells = stored(cells_of(rows, frozen.inputs, edges, ["fold", "y"]), "cells")
        if bins <= 2 or cells.count() <= most_cells:
            break
        bins = max(2, bins // 2)
    points = [(g * k + f, f, grid[g]["leaves"], grid[g]["rounds"]) for g in range(len(grid)) for f in range(k)]

    def table(models):
        one = lambda m: F.struct(*[F.lit(v).alias(n) for v, n in zip(m, ("model", "own", "leaves", "rounds"), strict=True)])
        return cells.withColumn("m", F.explode(F.array(*map(one, models)))).select("m.*", *cells.columns)

    out = pa.schema([("model", pa.int32()), ("y", pa.int32()), ("score", pa.float64()), ("n", pa.float64())])

    def held_out(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, own, leaves, rounds = (x.as_py() for x in key)
        fold, bins, y, n = _arrays(list(batches))
        train = fold != own
        trees = boost(bins[train], y[train], n[train], leaves, rounds)
        yield pa.RecordBatch.from_arrays([pa.array(np.full((~train).sum(), model), pa.int32()), pa.array(y[~train], pa.int32()), pa.array(trees.margin(bins[~train])), pa.array(n[~train])], schema=out)

    # one task a model, as the models are few and long to fit
    scored = table(points).repartition(len(points), "model").groupBy("model", "own", "leaves", "rounds").applyInArrow(held_out, "model int, y int, score double, n double")
    ap = {r["model"]: r.average_precision or 0.0 for r in weighted_average_precision(stored(scored, "held-out"), "y", "score", "n", ["model"], null_if_one_class=False).collect()}
    means = [sum(ap.get(g * k + f, 0.0) for f in range(k)) / k for g in range(len(grid))]
    best = max(range(len(grid)), key=lambda g: (round(means[g], 12), -g))
    last = (len(points), -1, grid[best]["leaves"], grid[best]["rounds"])

    def refit(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, bins, y, n = _arrays(list(batches))
        t = boost(bins, y, n, key[2].as_py(), key[3].as_py())
        yield pa.RecordBatch.from_arrays([pa.array([t.base]), pa.array([[x.tobytes() for x in t.trees]], pa.list_(pa.binary()))], names=["base", "trees"])

    found = table([last]).groupBy("model", "own", "leaves", "rounds").applyInArrow(refit, "base double, trees array<binary>").first()
    trees = Trees(found.base, [np.frombuffer(bytes(t), _NODE) for t in found.trees])
    return FrozenTrees(frozen.features, frozen.medians, frozen.flagged, choice=grid[best] | {"folds": k, "bins": bins, "cv_average_precision": means[best]}, edges=edges, trees=trees)
