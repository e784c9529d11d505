"""Trees grow on cells of equal bins: what the tasks hold follows from the cells, not from the rows; scores by tables are those of a walk."""

import threading
from multiprocessing import Pipe

import numpy as np
import pandas as pd
import pytest
from liftwork.operators import boosting, quantiles
from liftwork.operators.together import Peers
from pyspark.sql import functions as F
from test_boosting import SETTINGS, plain_trees

ALONE = Peers(0, ["here"], lambda said: [said], b"")  # of one task: no connection


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(8)
    x = np.stack([np.round(draw.normal(size=400), 1), np.round(draw.normal(size=400), 1)], 1)
    y = (draw.random(400) < 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1]))).astype(float)
    return x, y, x[:, 0] + draw.normal(size=400)


def test_tasks_hold_cells_not_rows(spark, data, monkeypatch):
    """Six times the rows are as many cells, and the trees are those of all rows."""
    x, y, z = data
    rows = spark.createDataFrame([(i, a.tolist(), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, z, strict=True))], "i int, features array<double>, y double, z double")
    goals, held, real = [boosting.Goal(F.col("y")), boosting.Goal(F.col("z"), binary=False)], [], boosting.in_tasks
    monkeypatch.setattr(boosting, "in_tasks", lambda table, *more: held.append(table.count()) or real(table, *more))
    for times in (1, 6):
        many = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(times)))).repartition(3)
        got = boosting.grow(many, goals, SETTINGS).add(rows, {"p0": 0, "p1": 1}).orderBy("i").toPandas()
        edges = quantiles.cut_points(many.select(*(F.col("features")[i].alias(f"x{i}") for i in range(2))), ["x0", "x1"], SETTINGS.bins)
        for name, label, binary in (("p0", y, True), ("p1", z, False)):
            want = plain_trees(np.tile(x, (times, 1)), np.tile(label, times), binary, SETTINGS, edges)[: len(x)]
            assert np.allclose(got[name], want, atol=1e-9)
    assert held[0] == held[1] < 2 * 400  # all 400 and all 2,400 rows stood in the tasks before


def joined(n):
    """Tasks in a tree, joined by pipes."""
    peers = [Peers(0, ["here"], lambda said: [said], b"") for _ in range(n)]
    for rank in range(1, n):
        peers[rank].parent, peers[rank].rank = None, rank
        above, below = Pipe()
        peers[rank].parent = below
        peers[(rank - 1) // 2].children.append(above)
    return peers


def test_cells_on_many_tasks_make_the_same_trees(data):
    x, y, z = data
    bins = np.stack([np.unique(c, return_inverse=True)[1] for c in x.T], 1).astype(np.uint8)
    scales = [boosting.Scale(True, 400, 0.0, 1.0), boosting.Scale(False, 400, float(z.min()), float(z.max()))]

    def cells(own):
        out = []
        for scale, label in zip(scales, (y, z), strict=True):
            c, n, s = boosting.merged(bins[own], np.rint((label[own] - scale.low) / scale.unit).astype(np.int64))
            out.append((c, n.astype(float), s.astype(float)))
        return out

    want, got = list(boosting.train(cells(np.arange(400)), scales, 200, SETTINGS, ALONE)), {}
    deal = np.random.default_rng(1).integers(0, 4, 400)  # cells that meet only in the sums
    deal[deal == 2] = 0  # a task without rows
    peers = joined(4)
    tasks = [threading.Thread(target=lambda r=r: got.update({r: list(boosting.train(cells(np.flatnonzero(deal == r)), scales, 200, SETTINGS, peers[r]))})) for r in range(4)]
    for t in tasks:
        t.start()
    for t in tasks:
        t.join(60)
    assert all(got[r] == want for r in range(4))


@pytest.mark.parametrize("leaves", [2, 31, 64, 70])
def test_tables_score_as_a_walk(data, leaves):
    x, y, _ = data
    bins = np.stack([np.unique(c, return_inverse=True)[1] for c in x.T], 1).astype(np.uint8)
    edges, scale = [np.unique(c) for c in x.T], boosting.Scale(True, 400, 0.0, 1.0)
    c, n, s = boosting.merged(bins, np.rint(y / scale.unit).astype(np.int64))
    found = boosting.train([(c, n.astype(float), s.astype(float))], [scale], 200, boosting.Settings(rounds=5, leaves=leaves, least_rows=1), ALONE)
    nodes = [(k, b, m, t, node, f, float(edges[f][cut]) if f >= 0 else 0.0, left, right, v) for k, b, m, t, (node, f, cut, left, right, v) in found]
    forest = boosting.Forest(pd.DataFrame(nodes, columns=[d.split()[0] for d in boosting.NODES.split(", ")]), [True])
    asked = np.concatenate([x, x + 0.05, [[np.nan, 0.0], [0.0, np.nan], [np.inf, -np.inf]]])
    by_tables = forest.raw(asked, 0)
    assert (forest._tables(0) is None) == (leaves == 70)
    forest._made[0] = None
    assert np.array_equal(by_tables, forest.raw(asked, 0))


def test_wide_rows_are_told_apart():
    bins = np.random.default_rng(0).integers(0, 2, (300, 11)).astype(np.uint8)
    cell, n, s = boosting.merged(bins, np.arange(300))
    want = {}
    for i, b in enumerate(bins):
        want.setdefault(b.tobytes(), []).append(i)
    assert {c.tobytes(): (int(a), int(b)) for c, a, b in zip(cell, n, s, strict=True)} == {k: (len(v), sum(v)) for k, v in want.items()}
