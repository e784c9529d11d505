"""Gradient-boosted trees by histograms, leaf by leaf: all models of a learner grow in one barrier stage.

Features are cut once at exact quantiles into at most `bins` bins. To a tree, rows of the same bins are one: `cells_of` leaves
of each goal and cell the number of its rows and the sum of their labels, so what is held and looked at in every step is cells, never
more than the rows and never more than the product of the features' bins. A barrier stage then holds the cells, one byte
for each bin, in its tasks until the last tree stands. In every step each model splits the leaf of greatest gain: the
tasks add up the histograms (gradient, hessian, rows) of the smaller child of every model in one message, along a binary tree of
connections between them; the larger child is the parent less the smaller. What travels is models x features x bins
numbers, whatever the number of rows, and all tasks come to the same split by themselves.

Labels and predictions are rounded to whole multiples of a unit such that no sum is ever rounded. So trees do not depend on how rows are
partitioned, and a stage that was lost and tried again gives the same ones.

A goal without rows raises; a goal with one class or equal labels gives that constant; features
that are not a number lie right of every cut; a forest's size is bounded by goals x rounds x leaves.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..shipping import ship
from ..sources.scratch import settled
from .quantiles import cut_points
from .together import Peers, in_tasks
from .validate import require

CHUNK, LEAST_HESSIAN = 1 << 17, 1e-3
#: A number whose product with a power of two has another top six bits for each of them (a de Bruijn sequence).
FIRST, ALL = 0x03F79D71B4CB0A89, (1 << 64) - 1
NODES = "goal int, base double, rows long, tree int, node int, feature int, cut double, left int, right int, value double"


@dataclass(frozen=True)
class Goal:
    """A model to grow: a label (column) over the rows where it applies; binary labels by log loss, others by squares."""

    label: Column
    where: Column | None = None
    binary: bool = True

    def column(self) -> Column:
        label = self.label.cast("double")
        return label if self.where is None else F.when(self.where, label)


@dataclass(frozen=True)
class Settings:
    rounds: int = 150
    leaves: int = 31
    step: float = 0.05
    least_rows: int = 20
    l2: float = 1e-3
    bins: int = 255
    depth: int | None = None


def gains(sums: np.ndarray, s: Settings) -> np.ndarray:
    """Gain of each cut (feature, bin: rows up to the bin go left) from a histogram (gradient, hessian, rows); -1 where it is not allowed."""
    left = sums.cumsum(-1)
    all_ = left[:, :, -1:]
    right = all_ - left
    fine = (left[2] >= s.least_rows) & (right[2] >= s.least_rows) & (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / (left[1] + s.l2) + right[0] ** 2 / (right[1] + s.l2) - all_[0] ** 2 / (all_[1] + s.l2)
    return np.where(fine, gain, -1.0)


class Tree:
    """One tree of a goal on its way, in one task: cells of each leaf, histograms of leaves, and the splits so far."""

    def __init__(self, s: Settings, bins: np.ndarray, offsets: np.ndarray, width: int, g: np.ndarray, h: np.ndarray, n: np.ndarray, units: np.ndarray):
        self.s, self.bins, self.offsets, self.width, self.units = s, bins, offsets, width, units
        self.g, self.h, self.n, self.rows = g, h, n, {0: np.arange(len(g), dtype=np.int32)}
        self.sums: dict[int, np.ndarray] = {}
        self.depth, self.split, self.queue, self.made, self.leaves = {0: 0}, {}, [], 1, 1
        self.asked: int | None = 0
        self.pair: tuple[int, int, int] | None = None

    def histogram(self) -> np.ndarray:
        """This task's part of the histogram that is asked for."""
        f, out = self.bins.shape[1], np.zeros((3, self.bins.shape[1] * self.width))
        rows = self.rows[self.asked]
        for at in range(0, len(rows), CHUNK):
            some = rows[at : at + CHUNK]
            where = (self.bins[some] + self.offsets).ravel()
            for i, x in enumerate((self.g, self.n) if self.h is self.n else (self.g, self.n, self.h)):
                out[(0, 2, 1)[i]] += np.bincount(where, np.repeat(x[some], f), out.shape[1])
        if self.h is self.n:
            out[1] = out[2]
        return out.reshape(3, f, self.width)

    def take(self, sums: np.ndarray) -> None:
        """The summed histogram of the node asked for; its sibling's follows, then the next split."""
        if self.pair is None:
            self._leaf(0, sums)
        else:
            parent, other, node = self.pair
            rest = self.sums.pop(parent) - sums
            for n in sorted((node, other)):
                self._leaf(n, sums if n == node else rest)
        self.asked = None
        if self.leaves < self.s.leaves and self.queue:
            self._split()

    def _leaf(self, node: int, sums: np.ndarray) -> None:
        self.sums[node] = sums
        if self.s.depth is not None and self.depth[node] >= self.s.depth:
            return
        scaled = sums.copy()
        scaled[:2] *= self.units[:, None, None]
        gain = gains(scaled, self.s)
        best = int(gain.argmax())
        if gain.flat[best] > 0:
            heapq.heappush(self.queue, (-gain.flat[best], node, best))

    def _split(self) -> None:
        _, node, best = heapq.heappop(self.queue)
        feature, cut = divmod(best, self.width)
        left, right, self.made = self.made, self.made + 1, self.made + 2
        rows = self.rows.pop(node)
        goes = self.bins[rows, feature] <= cut
        self.rows[left], self.rows[right] = rows[goes], rows[~goes]
        self.depth[left] = self.depth[right] = self.depth[node] + 1
        self.split[node] = feature, cut, left, right
        self.leaves += 1
        counts = self.sums[node][2, feature]
        less, more = (left, right) if 2 * counts[: cut + 1].sum() <= counts.sum() else (right, left)
        self.asked, self.pair = less, (node, more, less)

    def finish(self, raw: np.ndarray) -> list[tuple]:
        """Adds the leaves' values to the cells; node, feature, bin, left, right, value of each node."""
        out = []
        for node in range(self.made):
            if node in self.split:
                out.append((node, *self.split[node], 0.0))
            else:
                g, h = self.sums[node][:2, 0].sum(-1) * self.units
                value = -self.s.step * g / (h + self.s.l2)
                raw[self.rows[node]] += value
                out.append((node, -1, -1, -1, -1, value))
        return out


@dataclass(frozen=True)
class Scale:
    """Of a goal: its rows, the least and the greatest label, and the unit of which labels and predictions are whole multiples, counted from `low`."""

    binary: bool
    rows: int
    least: float
    greatest: float

    @property
    def low(self) -> float:
        return 0.0 if self.binary else self.least

    @property
    def unit(self) -> float:
        """Sums of whole multiples stay under 2**52, whatever their order."""
        reach = 1.0 if self.binary else max(self.greatest - self.least, 1e-300)
        return reach * 2.0 ** (math.ceil(math.log2(max(self.rows, 1))) - 51)

    def base(self, sums: float) -> float:
        """What a model starts from. sums: of all labels, in units."""
        if self.least == self.greatest:
            return (math.inf if self.greatest > 0 else -math.inf) if self.binary else self.greatest
        mean = sums * self.unit / max(self.rows, 1) + self.low
        return math.log(mean) - math.log1p(-mean) if self.binary else mean


Cells = tuple[np.ndarray, np.ndarray, np.ndarray]  # bins (cells x features), rows, sums of labels in units


def train(cells: list[Cells], scales: list[Scale], width: int, s: Settings, peers: Peers) -> Iterator[tuple]:
    """(goal, base, rows, tree, (node, feature, bin, left, right, value)) of all goals, from this task's cells of each."""
    offsets = np.arange(cells[0][0].shape[1]) * width
    total = peers.total(np.array([sums.sum() for _, _, sums in cells]))
    base = [scale.base(t) for scale, t in zip(scales, total, strict=True)]
    live = [k for k, scale in enumerate(scales) if scale.greatest > scale.least]
    raw = {k: np.full(len(cells[k][1]), base[k] - scales[k].low) for k in live}
    for k, scale in enumerate(scales):
        yield k, base[k], scale.rows, -1, (0, -1, -1, -1, -1, 0.0)
    for nth in range(s.rounds):
        trees = {}
        for k in live:
            (bins, n, sums), unit = cells[k], scales[k].unit
            if scales[k].binary:
                p = 1 / (1 + np.exp(-raw[k]))
                g, h, units = n * np.rint(p / unit) - sums, n * np.rint(p * (1 - p) / unit), np.array([unit, unit])
            else:
                g, h, units = n * np.rint(raw[k] / unit) - sums, n, np.array([unit, 1.0])
            trees[k] = Tree(s, bins, offsets, width, g, h, n, units)
        asking = list(live)
        while asking:
            sums = peers.total(np.stack([trees[k].histogram() for k in asking]))
            for k, part in zip(asking, sums, strict=True):
                trees[k].take(part)
            asking = [k for k in asking if trees[k].asked is not None]
        for k in live:
            for node in trees[k].finish(raw[k]):
                yield k, base[k], scales[k].rows, nth, node


class Forest:
    """Grown models, for scoring."""

    def __init__(self, nodes: pd.DataFrame, binary: list[bool]):
        self.binary = binary
        self.models = []
        self.rows = [int(nodes[nodes["goal"] == k]["rows"].iloc[0]) for k in range(len(binary))]
        for k in range(len(binary)):
            own = nodes[nodes["goal"] == k]
            trees = own[own["tree"] >= 0].sort_values(["tree", "node"])
            first = np.flatnonzero(trees["node"].to_numpy() == 0)
            shift = np.repeat(first, np.diff(np.append(first, len(trees))))
            feature = trees["feature"].to_numpy()
            left, right = (np.where(feature >= 0, trees[c].to_numpy() + shift, np.arange(len(trees))) for c in ("left", "right"))
            self.models.append((float(own["base"].iloc[0]), first, np.maximum(feature, 0), trees["cut"].to_numpy(), left, right, trees["value"].to_numpy(), feature < 0))

    def raw(self, x: np.ndarray, k: int) -> np.ndarray:
        base, first, feature, cut, left, right, value, leaf = self.models[k]
        tables = self._tables(k)
        if tables is not None:
            return self._by_tables(x, base, *tables)
        out = np.full(len(x), base)
        most = max(1, (1 << 20) // max(1, len(first)))
        for at in range(0, len(x) if len(first) else 0, most):
            part = x[at : at + most]
            node = np.tile(first, (len(part), 1))
            rows = np.arange(len(part))[:, None]
            while not leaf[node].all():
                node = np.where(part[rows, feature[node]] <= cut[node], left[node], right[node])
            for t in range(len(first)):  # in the order of training
                out[at : at + most] += value[node[:, t]]
        return out

    def _tables(self, k: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray] | None:
        """(feature, cuts, masks: trees x bins) of each feature and the leaves' values; None for trees of more than 64 leaves.

        A mask has a bit for each leaf, from left to right, that a value of the bin leaves in reach; of the leaves that all features
        leave, the first is the row's. Values stand where `FIRST` puts that leaf's bit. Made once in a process.
        """
        made = self.__dict__.setdefault("_made", {})
        if k not in made:
            _, first, feature, cut, left, right, value, leaf = self.models[k]
            if not len(first) or (np.diff(np.append(first, len(leaf))).max() + 1) // 2 > 64:
                made[k] = None
                return None
            cuts = {int(f): np.unique(cut[(feature == f) & ~leaf]) for f in np.unique(feature[~leaf])}
            masks = {f: np.full((len(first), len(c) + 1), ~np.uint64(0)) for f, c in cuts.items()}
            values = np.zeros((len(first), 64))
            for t, root in enumerate(first):
                order, stack, span, n = [], [int(root)], {}, 0
                while stack:
                    node = stack.pop()
                    order.append(node)
                    if leaf[node]:
                        span[node] = n, n + 1
                        values[t, ((1 << n) * FIRST & ALL) >> 58] = value[node]
                        n += 1
                    else:
                        stack += [int(right[node]), int(left[node])]
                for node in reversed(order):
                    if not leaf[node]:
                        (low, middle), (_, high) = span[int(left[node])], span[int(right[node])]
                        span[node] = low, high
                        f = int(feature[node])
                        masks[f][t, np.searchsorted(cuts[f], cut[node]) + 1 :] &= np.uint64(ALL ^ ((1 << middle) - (1 << low)))
            made[k] = [(f, cuts[f], masks[f]) for f in cuts], values
        return made[k]

    @staticmethod
    def _by_tables(x: np.ndarray, base: float, features: list[tuple[int, np.ndarray, np.ndarray]], values: np.ndarray) -> np.ndarray:
        out = np.full(len(x), base)
        most = max(1, (1 << 18) // len(values))
        for at in range(0, len(x), most):
            part, here = x[at : at + most], out[at : at + most]
            bits = np.full((len(values), len(part)), ~np.uint64(0))
            for f, cuts, masks in features:
                bits &= masks[:, np.searchsorted(cuts, part[:, f])]
            bits &= ~bits + np.uint64(1)  # the first leaf's bit alone
            where = (bits * np.uint64(FIRST)) >> np.uint64(58)
            for t in range(len(values)):  # in the order of training
                here += values[t][where[t]]
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def scores(self, x: np.ndarray, k: int) -> np.ndarray:
        raw = self.raw(x, k)
        if not self.binary[k]:
            return raw
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-raw))

    def add(self, df: DataFrame, out: dict[str, Column | int], features: str = "features") -> DataFrame:
        """`df` with the columns of `out`: by the model of that number, which may differ from row to row."""
        ship(df.sparkSession)
        forest = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(x: pd.Series, which: pd.Series) -> pd.Series:
            found, which = np.zeros(len(x)), which.to_numpy()
            values = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 0))
            for k in np.unique(which):
                at = np.flatnonzero(which == k)
                found[at] = forest.value.scores(values[at], int(k))
            return pd.Series(found)

        x = F.col(features) if isinstance(df.schema[features].dataType, ArrayType) else vector_to_array(features)
        return df.withColumns({name: score(x, (F.lit(k) if isinstance(k, int) else k).cast("int")) for name, k in out.items()})


def merged(bins: np.ndarray, y: np.ndarray) -> Cells:
    """Rows of the same bins as one: bins, how many, the sum of y."""
    words = np.zeros((len(bins), -(-max(1, bins.shape[1]) // 8) * 8), np.uint8)
    words[:, : bins.shape[1]] = bins
    key = words.view(np.uint64)
    _, first, at = np.unique(key[:, 0] if key.shape[1] == 1 else words.view(np.dtype((np.void, words.shape[1])))[:, 0], return_index=True, return_inverse=True)
    sums = np.zeros(len(first), np.int64)
    np.add.at(sums, at, y)
    return bins[first], np.bincount(at, minlength=len(first)), sums


def cells_of(table: DataFrame, edges: list[np.ndarray], scales: list[Scale]) -> DataFrame:
    """bins, goal, n, s: of each goal and cell of bins the rows and the sum of their labels in units. table: x and y, an array of a label for each goal."""
    ship(table.sparkSession)
    shared, f = table.sparkSession.sparkContext.broadcast(edges), len(edges)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            bins, labels = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            for k, scale in enumerate(scales):
                own = np.flatnonzero(~np.isnan(labels[:, k]))
                if len(own):
                    cell, n, s = merged(bins[own], np.rint((labels[own, k] - scale.low) / scale.unit).astype(np.int64))
                    for at in range(0, len(n), 10_000):
                        part = slice(at, at + 10_000)
                        key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(f), len(n[part]), [None, pa.py_buffer(np.ascontiguousarray(cell[part]))]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(n[part]), k, np.int32)), pa.array(n[part]), pa.array(s[part])], ["bins", "goal", "n", "s"])

        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, f)
            bins = np.stack([np.searchsorted(e, values[:, i]) for i, e in enumerate(shared.value)], 1).astype(np.uint8)
            held.append((bins, batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(scales))))
            rows += batch.num_rows
            if rows >= CHUNK:
                yield from out()
                held, rows = [], 0
        if rows:
            yield from out()

    found = table.mapInArrow(merge, "bins binary, goal int, n long, s long")
    return found.groupBy("bins", "goal").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def grow(rows: DataFrame, goals: list[Goal], s: Settings, features: str = "features", tasks: int | None = None) -> Forest:
    """The models of all goals on `rows`, grown together. tasks: how many share the cells."""
    spark = rows.sparkSession
    ship(spark)
    x = F.col(features) if isinstance(rows.schema[features].dataType, ArrayType) else vector_to_array(features)
    table = settled(rows.select(x.alias("x"), F.array(*(F.nanvl(g.column(), F.lit(None)) for g in goals)).alias("y")), "to_learn_from")
    label = [F.col("y")[k] for k in range(len(goals))]
    facts = table.agg(F.max(F.size("x")).alias("f"), *(how(v).alias(f"{name}{k}") for k, v in enumerate(label) for name, how in (("n", F.count), ("a", F.min), ("b", F.max)))).first()
    for k in range(len(goals)):
        require(facts[f"n{k}"] > 0, f"no rows to learn goal {k} from")
    f = facts["f"]
    edges = cut_points(table.select(*(F.col("x")[i].alias(f"x{i}") for i in range(f))), [f"x{i}" for i in range(f)], s.bins)
    width = max(map(len, edges)) + 1
    scales = [Scale(g.binary, facts[f"n{k}"], facts[f"a{k}"], facts[f"b{k}"]) for k, g in enumerate(goals)]
    cells, shared = settled(cells_of(table, edges, scales), "cells"), spark.sparkContext.broadcast(edges)

    def run(peers: Peers, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[Cells]] = [[] for _ in scales]
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, f)
            goal, n, sums = (batch.column(c).to_numpy() for c in ("goal", "n", "s"))
            for k in np.unique(goal):
                at = np.flatnonzero(goal == k)
                held[k].append((bins[at], n[at].astype(float), sums[at].astype(float)))
        own = [tuple(np.concatenate([none, *(h[i] for h in held[k])]) for i, none in enumerate((np.zeros((0, f), np.uint8), np.zeros(0), np.zeros(0)))) for k in range(len(scales))]
        held.clear()
        found = list(train(own, scales, width, s, peers))
        for at in range(0, len(found) if peers.rank == 0 else 0, 10_000):  # every task has the same trees
            part = [(k, b, m, t, node, feature, float(shared.value[feature][cut]) if feature >= 0 else 0.0, left, right, value) for k, b, m, t, (node, feature, cut, left, right, value) in found[at : at + 10_000]]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(part, columns=[c.split()[0] for c in NODES.split(", ")]).astype({"goal": "int32", "tree": "int32", "node": "int32", "feature": "int32", "left": "int32", "right": "int32"}), preserve_index=False)

    nodes = in_tasks(cells, -(-cells.count() // len(goals)), run, NODES, tasks).toPandas()  # goals x rounds x 2 leaves rows at most
    return Forest(nodes, [g.binary for g in goals])
