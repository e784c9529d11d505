"""The network, Gaussian processes and nearest neighbours against finite differences, dense grids and brute force."""

import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftwork.functions import statistics as st
from liftwork.operators import gaussian, kernels, neighbours, network, prepare, regimes

NET = network.Net(width=6, epochs=4, batch=32, step=1e-2, patience=2, seed=3)


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(8)
    x, t = draw.normal(size=(400, 3)), draw.integers(0, 2, 400)
    y = (draw.random(400) < 0.25 + 0.5 * t * (x[:, 0] > 0)).astype(int)
    return spark.createDataFrame([(i, int(t[i]), int(y[i]), *map(float, x[i])) for i in range(400)], "epk_id long, t int, y int, a double, b double, c double").cache()


def test_gradients_by_finite_differences():
    draw = np.random.default_rng(0)
    x, t, y = draw.normal(size=(20, 3)), draw.integers(0, 2, 20).astype(float), draw.integers(0, 2, 20).astype(float)
    w = network.first_weights(3, NET)
    assert w["g0"].shape == (6, 3) and w["v0"].shape == (3, 1)
    got = network.gradients(w, x, t, y)
    assert set(got) == set(w)
    for name, v in w.items():
        for at in list(np.ndindex(v.shape))[:8]:
            kept = v[at]
            v[at] = kept + 1e-6
            up = network.losses(network.forward(w, x), t, y)
            v[at] = kept - 1e-6
            down = network.losses(network.forward(w, x), t, y)
            v[at] = kept
            assert got[name][at] == pytest.approx((up - down) / 2e-6, abs=1e-5), name


def test_weights_do_not_depend_on_partitions(rows):
    one, four = (network.fit(rows.repartition(n), ["a", "b", "c"], NET, tasks=tasks) for n, tasks in ((1, 1), (6, 4)))
    assert all(np.allclose(one[k], four[k], atol=1e-9) for k in one)


def test_every_row_is_in_one_batch_an_epoch():
    u = np.random.default_rng(1).random(5000)
    first, second = network.batches_of(u, 0, 10), network.batches_of(u, 1, 10)
    assert set(first) == set(range(10)) and np.bincount(first).min() > 350 and (first != second).mean() > 0.8


def test_network_stops_by_validation_rows(rows):
    """Validation rows whose outcomes are turned round only get worse, so the first epochs are kept."""
    turned = rows.withColumn("y", 1 - F.col("y"))
    net = network.Net(width=16, epochs=60, batch=64, step=5e-3, patience=3)
    w = network.fit(rows, ["a", "b", "c"], net, turned)
    assert w["epochs"][0] < 20
    with pytest.raises(ValueError):
        network.fit(rows.filter("t = 1"), ["a", "b", "c"], net, turned)
    with pytest.raises(ValueError):
        network.fit(rows, ["a", "b", "c"], network.Net(width=1), turned)


def test_likelihood_gradient_and_maximum():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(60, 2))
    y = np.sin(x[:, 0]) + 0.3 * draw.normal(size=60)
    z, d2 = (y - y.mean()) / y.std(), gaussian.squares(x, x)
    f = lambda at: gaussian.likelihood(at, d2, z, 1e-6)
    at = np.log([0.8, 1.3, 0.2])
    for i in range(3):
        e = np.eye(3)[i] * 1e-5
        assert f(at)[1][i] == pytest.approx((f(at + e)[0] - f(at - e)[0]) / 2e-5, rel=1e-4, abs=1e-5)
    best = max(gaussian.climb(f, s, gaussian.BOUNDS)[0] for s in gaussian.starts(x, 2, 0))
    dense = max(f(np.log([a, b, c]))[0] for a in (0.1, 0.3, 1, 3, 10) for b in (0.1, 0.3, 0.6, 1, 1.5, 2, 3, 6) for c in (0.01, 0.03, 0.1, 0.2, 0.4, 1))
    assert best >= dense - 1e-6


def test_inducing_rows_that_are_all_rows_are_exact():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(80, 2))
    y, new, theta = x[:, 0] ** 2 + draw.normal(size=80) / 4, draw.normal(size=(30, 2)), np.log([1.2, 0.9, 0.1])
    exact = gaussian.Posterior.exact(x, y, theta, 1e-9)
    k = gaussian.kernel(x, x, *np.exp(theta[:2]))
    mean, spread = gaussian.normal(y)
    sparse = gaussian.Posterior.induced(x, theta, mean, spread, k.T @ k, k.T @ ((y - mean) / spread), 1e-9)
    for a, b in zip(exact.at(new), sparse.at(new), strict=True):
        assert np.allclose(a, b, atol=1e-3)


def test_intervals_widen_with_the_level(rows):
    narrow, wide = (kernels.gp_cate(rows, ["a", "b", "c"], components=2, most_control=100, most_treated=500, restarts=0, level=level).predict(rows).toPandas() for level in (0.5, 0.95))
    assert np.allclose(narrow["cate"], wide["cate"])
    assert (wide["cate_high"] - wide["cate_low"] > narrow["cate_high"] - narrow["cate_low"]).all()
    assert narrow[narrow["a"] > 0]["cate"].mean() > narrow[narrow["a"] <= 0]["cate"].mean() + 0.1
    for bad in ({"level": 1.0}, {"components": 0}, {"restarts": -1}):
        with pytest.raises(ValueError):
            kernels.gp_cate(rows, ["a", "b", "c"], **bad)


def test_principal_components(rows):
    x = rows.orderBy("epk_id").toPandas()[["a", "b", "c"]].to_numpy()
    got = np.array([r["pc"] for r in prepare.principal_components(rows, ["a", "b", "c"], 2, ["epk_id"]).orderBy("epk_id").collect()])
    want = x @ np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


@pytest.mark.parametrize("piece", [4096, 7])
def test_nearest_equal_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(neighbours, "PIECE", piece)
    draw = np.random.default_rng(5)
    x = np.round(draw.normal(size=(500, 2)), 1)
    x[:170] = x[0]  # a third of the rows are one point
    t, y = draw.integers(0, 3, 500), draw.random(500)
    rows = spark.createDataFrame([(i, int(t[i]), float(y[i]), *map(float, x[i])) for i in range(500)], "epk_id long, t int, y double, a double, b double").repartition(4)
    asked = rows.filter("epk_id % 5 = 0")
    got = {}
    for r in neighbours.nearest(asked, rows, ["a", "b"], 12, "t").collect():
        got.setdefault((r["query"], r["grp"]), []).append((r["nth"], r["id"], r["d2"], r["y"]))
    for q in range(0, 500, 5):
        for g in range(3):
            d2 = ((x - x[q]) ** 2)[:, 0] + ((x - x[q]) ** 2)[:, 1]
            want = sorted((d2[i], i) for i in range(500) if t[i] == g)[:12]
            assert [(k + 1, i, d, y[i]) for k, (d, i) in enumerate(want)] == sorted(got[q, g])
    assert len(neighbours.nearest(asked, rows.filter("epk_id < 4"), ["a", "b"], 12, "t").collect()) == 100 * 4


def test_lists_out_of_reach_are_not_looked_at(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(4000, 2)) + 40 * draw.integers(0, 6, (4000, 2))
    rows = spark.createDataFrame([(i, 0, 0.0, *map(float, x[i])) for i in range(4000)], "epk_id long, t int, y double, a double, b double")
    shares = neighbours.share_looked_at(rows.filter("epk_id % 20 = 0"), rows, ["a", "b"], 5, "t")
    assert shares < 0.1


def test_exact_p_values(spark):
    draw = np.random.default_rng(7)
    table, want = [], {}
    for c in range(12):
        n = [3, 4, 5, 6, 7, 9][c % 6]
        a, b = draw.integers(0, 6, n).astype(float), draw.integers(0, 9, n).astype(float)
        if c == 11:
            a[:] = 1.0
        table += [("d", "x", f"c{c}", f"m{i}", float(a[i]), float(b[i])) for i in range(n)]
        want[f"c{c}"] = st.spearman(-a, b)
        if n <= 6 and not math.isnan(want[f"c{c}"][0]):
            rx, ry = st.average_ranks(-a), st.average_ranks(b)
            hits = [abs(st.pearson(rx, np.array(p))) >= abs(want[f"c{c}"][0]) - 1e-12 for p in permutations(ry)]
            assert want[f"c{c}"][1] == pytest.approx(np.mean(hits))
    df = spark.createDataFrame(table, "dataset string, axis string, severity_tag string, model string, pehe_mean double, qini_mean double")
    got = {r["severity_tag"]: r for r in regimes.rank_agreement(df).collect()}
    assert set(got) == set(want)
    for k, (rho, p) in want.items():
        if math.isnan(rho):
            assert got[k]["spearman_rho"] is None and got[k]["p_value"] is None
        else:
            assert got[k]["spearman_rho"] == pytest.approx(rho) and got[k]["p_value"] == pytest.approx(p)


def test_a_query_is_written_once_for_each_group(spark):
    draw = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, i % 2, 0.0, *map(float, draw.normal(size=2))) for i in range(3000)], "epk_id long, t int, y double, a double, b double")
    filed, asked = neighbours._asked(rows.filter("epk_id % 3 = 0"), rows, ["a", "b"], 16, "t", "epk_id", "pivots")[:2]
    assert filed.count() == 3000 and asked.count() == 2 * 1000
    empty = rows.limit(0)
    assert neighbours.nearest(rows, empty, ["a", "b"], 3, "t").isEmpty() and neighbours.nearest(empty, rows, ["a", "b"], 3, "t").isEmpty()
