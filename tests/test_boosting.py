"""Boosted trees against a plain numpy version, whatever the partitioning; order statistics against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftwork.operators import boosting, quantiles

SETTINGS = boosting.Settings(rounds=6, leaves=9, step=0.3, least_rows=5, l2=1e-3, bins=32)


def plain_trees(x, y, binary, s, edges):
    """Leaf by leaf, every node's best cut tried in full."""
    p = y.mean()
    raw = np.full(len(y), math.log(p / (1 - p)) if binary else p)
    for _ in range(s.rounds):
        q = 1 / (1 + np.exp(-raw))
        g, h = (q - y, q * (1 - q)) if binary else (raw - y, np.ones(len(y)))

        def best(rows):
            found = (0.0, None)
            for f in range(x.shape[1]):
                for e in edges[f]:
                    left = rows[x[rows, f] <= e]
                    right = rows[x[rows, f] > e]
                    if min(len(left), len(right)) < s.least_rows or min(h[left].sum(), h[right].sum()) < 1e-3:
                        continue
                    gain = sum(g[r].sum() ** 2 / (h[r].sum() + s.l2) * w for r, w in ((left, 1), (right, 1), (rows, -1)))
                    if gain > found[0] + 1e-9:
                        found = (gain, (left, right))
            return found

        leaves = [(np.arange(len(y)), best(np.arange(len(y))))]
        while len(leaves) < s.leaves:
            i = max(range(len(leaves)), key=lambda i: leaves[i][1][0])
            if leaves[i][1][1] is None:
                break
            left, right = leaves[i][1][1]
            leaves[i : i + 1] = [(left, best(left)), (right, best(right))]
        for rows, _ in leaves:
            raw[rows] -= s.step * g[rows].sum() / (h[rows].sum() + s.l2)
    return 1 / (1 + np.exp(-raw)) if binary else raw


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(500, 3))
    x[:, 2] = np.round(x[:, 2])
    y = (draw.random(500) < 1 / (1 + np.exp(-x[:, 0] - x[:, 1] * x[:, 2]))).astype(float)
    z = x[:, 0] * x[:, 1] + draw.normal(size=500) / 5
    df = spark.createDataFrame([(i, a.tolist(), float(b), float(c), i % 3) for i, (a, b, c) in enumerate(zip(x, y, z, strict=True))], "i int, features array<double>, y double, z double, part int")
    return df.cache(), x, y, z


def goals():
    return [boosting.Goal(F.col("y")), boosting.Goal(F.col("z"), binary=False), boosting.Goal(F.col("y"), F.col("part") != 0), boosting.Goal(F.lit(1), F.col("part") == 1), boosting.Goal(F.lit(2.5), binary=False)]


def test_trees_equal_plain_ones(rows):
    df, x, y, z = rows
    edges = quantiles.cut_points(df.select(*(F.col("features")[i].alias(f"x{i}") for i in range(3))), ["x0", "x1", "x2"], SETTINGS.bins)
    got = boosting.grow(df, goals(), SETTINGS).add(df, {f"p{k}": k for k in range(5)}).orderBy("i").toPandas()
    part = np.arange(500) % 3 != 0
    assert np.allclose(got["p0"], plain_trees(x, y, True, SETTINGS, edges), atol=1e-9)
    assert np.allclose(got["p1"], plain_trees(x, z, False, SETTINGS, edges), atol=1e-9)
    assert np.allclose(got["p2"][part], plain_trees(x[part], y[part], True, SETTINGS, edges), atol=1e-9)
    assert (got["p3"] == 1).all() and (got["p4"] == 2.5).all()


def test_trees_do_not_depend_on_partitions(rows):
    df = rows[0]
    one, four = (boosting.grow(df.repartition(n), goals(), SETTINGS, tasks=tasks) for n, tasks in ((1, 1), (5, 4)))
    for a, b in zip(one.models, four.models, strict=True):
        assert all(np.array_equal(u, v) for u, v in zip(a, b, strict=True))


def test_depth_leaves_and_rows_bound_a_tree(rows):
    df, x, *_ = rows
    for s in (boosting.Settings(rounds=1, depth=2), boosting.Settings(rounds=1, leaves=3, least_rows=100)):
        base, first, feature, cut, left, right, value, leaf = boosting.grow(df, goals()[1:2], s).models[0]
        assert len(first) == 1 and leaf.sum() <= (4 if s.depth else 3)
        node = np.zeros(len(x), int)
        for _ in range(5):
            node = np.where(x[np.arange(len(x)), feature[node]] <= cut[node], left[node], right[node])
        assert np.unique(node, return_counts=True)[1].min() >= s.least_rows


def test_no_rows_raise(rows):
    with pytest.raises(ValueError, match="no rows"):
        boosting.grow(rows[0], [boosting.Goal(F.col("y"), F.lit(False))], SETTINGS)


def test_models_by_row(rows):
    df = rows[0]
    forest = boosting.grow(df, goals(), SETTINGS)
    got = forest.add(df, {"p": F.col("part"), "p0": 0, "p1": 1, "p2": 2})
    assert got.filter("p <> CASE part WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END").isEmpty()


@pytest.mark.parametrize("few", [0, 20, 1 << 17])
def test_order_statistics(spark, few):
    draw = np.random.default_rng(0)
    values = {
        "normal": draw.normal(size=700), "ties": draw.integers(-2, 3, 700).astype(float), "powers": np.sign(draw.normal(size=700)) * 2.0 ** draw.integers(-900, 900, 700),
        "huge": np.append(draw.normal(size=698), [1e308, -1e308]), "ends": np.append(draw.normal(size=698), [np.inf, -np.inf]), "tiny": draw.integers(0, 700, 700) * 5e-324, "same": np.full(700, 3.25), "close": 1 + draw.integers(0, 300, 700) * 2.0**-52,
    }
    rows = [tuple(float(v[i]) for v in values.values()) for i in range(700)] + [(None,) * 8, (float("nan"),) * 8]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in values)).repartition(3)
    ranks = {1, 2, 175, 350, 351, 699, 700, 701}
    got = quantiles.order_statistics(df, {c: ranks for c in values}, few=few)
    assert got == {(c, r): np.sort(v)[r - 1] for c, v in values.items() for r in ranks if r <= 700}


def test_percentiles(spark):
    df = spark.createDataFrame([(float(i), None, float(i % 7)) for i in range(101)], "a double, b double, c double")
    got = quantiles.percentiles(df, ["a", "b", "c"], [0.0, 0.013, 0.5, 1.0], few=10)
    assert got["b"] == [None] * 4
    for c in "ac":
        assert got[c] == list(df.agg(*(F.percentile(c, p) for p in (0.0, 0.013, 0.5, 1.0))).first())
    assert quantiles.percentiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}
