"""Means over the nearest rows: by brute force, whatever the pieces, with queries and rows of one place asked and held once."""

import numpy as np
import pytest
from liftwork.operators import heads, kernels, learners, neighbours
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(9)
    x = np.round(draw.normal(size=(600, 2)), 1)
    x[:200] = x[0]  # a third of the rows are one place
    t, y = draw.integers(0, 2, 600), draw.integers(0, 2, 600)
    return x, t, y, spark.createDataFrame([(i, int(t[i]), int(y[i]), *map(float, x[i])) for i in range(600)], "epk_id long, t int, y int, a double, b double").repartition(4).cache()


@pytest.mark.parametrize("piece", [4096, 5])
def test_means_equal_brute_force(rows, monkeypatch, piece):
    monkeypatch.setattr(neighbours, "PIECE", piece)
    x, t, y, df = rows
    got = neighbours.nearest_means(df.filter("epk_id % 3 = 0"), df.filter("epk_id % 3 > 0"), ["a", "b"], 12, "t", [12, 3, 1]).collect()
    assert sorted(r["epk_id"] for r in got) == list(range(0, 600, 3))
    for r in got:
        d2 = ((x - x[r["epk_id"]]) ** 2)[:, 0] + ((x - x[r["epk_id"]]) ** 2)[:, 1]
        for g in (0, 1):
            order = sorted((d2[i], i) for i in range(600) if i % 3 and t[i] == g)
            for n in (12, 3, 1):
                assert r[f"mean_{g}_{n}"] == pytest.approx(np.mean([y[i] for _, i in order[:n]]))


def test_places_are_asked_and_held_once(rows, monkeypatch):
    """200 rows of one place are one query, and at most k rows of each group there are candidates."""
    x, t, _, df = rows
    seen, real = [], neighbours._asked
    monkeypatch.setattr(neighbours, "_asked", lambda queries, *more: seen.append((queries.count(), real(queries, *more))) or seen[-1][1])
    assert neighbours.nearest_means(df, df, ["a", "b"], 12, "t", [12]).count() == 600
    (asked, (filed, *_)), places = seen[0], len(np.unique(x, axis=0))
    assert asked == places  # all 600 rows were asked before
    assert filed.count() == len(np.unique(np.column_stack([x, t]), axis=0)) and max(len(r["ids"]) for r in filed.collect()) == 12


@pytest.fixture
def asked_places(monkeypatch):
    seen, real = [], neighbours._asked
    monkeypatch.setattr(neighbours, "_asked", lambda queries, *more: seen.append(queries.count()) or real(queries, *more))
    return seen


def test_residual_correction_asks_places(rows, asked_places):
    """Its base scorer asks each place of a fold once, in training and in scoring; each row was asked before."""
    x, _, _, df = rows
    df = df.withColumn("features", array_to_vector(F.array("a", "b")))
    base = lambda some: kernels.neighbour_stand_in(some, ["a", "b"], 12)
    got = learners.residual_correction(df, base, learners.Trees(rounds=2), folds=2).predict(df)
    assert got.count() == 600 and got.filter("cate IS NULL").isEmpty()
    places = len(np.unique(x, axis=0))
    assert len(asked_places) == 3 and max(asked_places) == places and all(n < 300 for n in asked_places[:2])


def test_tuned_head_asks_places(rows, asked_places):
    """Outcomes under an untuned head are the means of the nearest, one query for each place."""
    x, _, _, df = rows
    got = heads.with_outcomes(df, df, ["a", "b"], 12, {0: 0.4, 1: 0.6}, np.zeros((2, heads.WIDTH))).collect()
    want = {r["epk_id"]: (r["mean_0_12"], r["mean_1_12"]) for r in neighbours.nearest_means(df, df, ["a", "b"], 12, "t", [12]).collect()}
    assert {r["epk_id"]: (r["mu0"], r["mu1"]) for r in got} == want
    assert asked_places[0] == len(np.unique(x, axis=0))
