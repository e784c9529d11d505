"""The tuned head against finite differences, plain numpy neighbours and the untuned stand-in."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from liftwork.operators import heads, kernels, learners
from liftwork.sources.scratch import settled

X = ["a", "b"]
SMALL = heads.Episodes(epochs=2, tasks=2, validation_tasks=1, context=60, queries=16, patience=2, seed=3)


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(11)
    x, t = np.round(draw.normal(size=(600, 2)), 1), draw.integers(0, 2, 600)
    y = (draw.random(600) < 0.2 + 0.5 * t * (x[:, 0] > 0)).astype(int)
    plain = spark.createDataFrame([(i, int(t[i]), int(y[i]), *map(float, x[i])) for i in range(600)], "epk_id long, t int, y int, a double, b double")
    return settled(VectorAssembler(inputCols=X, outputCol="features").transform(plain).repartition(4), "head_rows")


def truth(df):
    """Labels that are the known outcome means."""
    return df.withColumn("label0", F.lit(0.2)).withColumn("label1", F.when(F.col("a") > 0, 0.7).otherwise(0.2))


def pool_of(rows, s=SMALL, k=8):
    return heads.Pool(truth(rows).toPandas(), X, s, k)


def test_gradient_by_finite_differences():
    draw = np.random.default_rng(0)
    seen, labels, w = draw.normal(size=(30, 2 * heads.WIDTH)), draw.random((30, 2)), draw.normal(size=(2, heads.WIDTH))
    _, g = heads.loss(w, seen, labels)
    for at in np.ndindex(w.shape):
        e = np.zeros_like(w)
        e[at] = 1e-6
        assert g[at] == pytest.approx((heads.loss(w + e, seen, labels)[0] - heads.loss(w - e, seen, labels)[0]) / 2e-6, abs=1e-6)


def test_episodes_hold_every_stratum_and_keep_queries_apart(rows):
    pool = pool_of(rows)
    t, y = pool.t, pool.y
    for nth in range(5):
        context, asked, seen, labels = pool.episode(nth)
        assert len(context) == 60 and not set(context) & set(asked) and not pool.hold[context].any()
        assert pool.hold[asked].all() == (nth == 4) and pool.hold[asked].any() == (nth == 4)
        assert {(a, b) for a, b in zip(t[context], y[context], strict=True)} == {(0, 0), (0, 1), (1, 0), (1, 1)}
        for a in (0, 1):  # neighbours by a plain sort
            own = context[t[context] == a]
            for row, q in enumerate(asked):
                near = sorted(own, key=lambda i: (((pool.x[i] - pool.x[q]) ** 2).sum(), i))[:8]
                want = [y[near].mean(), y[near[:2]].mean() - y[near].mean(), y[near[0]] - y[near].mean(), y[own].mean() - y[near].mean()]
                assert np.allclose(seen[row, a * 4 : a * 4 + 4], want)
        assert np.array_equal(labels, pool.labels[asked])


def test_a_stratum_of_one_row_is_in_every_context(rows):
    rest, one = truth(rows).filter("t = 0 OR y = 0"), truth(rows).filter("t = 1 AND y = 1").orderBy("epk_id").limit(1)
    pool = heads.Pool(rest.unionByName(one).toPandas(), X, SMALL, 8)
    place = np.flatnonzero((pool.t == 1) & (pool.y == 1))
    assert len(place) == 1 and all(place[0] in pool.episode(n)[0] for n in range(5))


def test_untuned_head_is_the_stand_in(rows):
    means = {r["t"]: r["m"] for r in rows.groupBy("t").agg(F.avg("y").alias("m")).collect()}
    got = heads.with_outcomes(rows, rows.select("epk_id", "t", "y", *X), X, 16, means, np.zeros((2, heads.WIDTH))).orderBy("epk_id").toPandas()
    want = kernels.neighbour_stand_in(rows, X, 16).predict(rows).orderBy("epk_id").toPandas()
    assert np.allclose(got[["mu0", "mu1"]], want[["mu0", "mu1"]])


def test_scoring_sees_what_episodes_see(rows):
    """The same head over the same neighbours, by columns and by numpy."""
    w, frame = np.random.default_rng(1).normal(size=(2, heads.WIDTH)) / 5, rows.toPandas().sort_values("epk_id")
    x, t, y = frame[X].to_numpy(), frame["t"].to_numpy(), frame["y"].to_numpy(float)
    seen = [heads.representation(y[t == a][np.argsort(heads.distances(x, x[t == a]), 1, kind="stable")[:, :32]], y[t == a].mean()) for a in (0, 1)]
    want = np.clip(heads.outcomes(w, np.concatenate(seen, 1)), 0, 1)
    got = heads.with_outcomes(rows, rows.select("epk_id", "t", "y", *X), X, 32, {a: y[t == a].mean() for a in (0, 1)}, w).orderBy("epk_id").toPandas()
    assert np.allclose(got[["mu0", "mu1"]], want)


def test_tuning_moves_the_head_alone_and_nearer_to_the_labels(rows):
    s = heads.Episodes(epochs=30, tasks=4, validation_tasks=2, context=200, queries=64, patience=5, seed=3)
    fitted = heads.tuned_stand_in(rows, X, 16, s, labels=truth)
    again = heads.tuned_stand_in(rows.repartition(7), X, 16, s, labels=truth)
    assert fitted.settings["head"] == again.settings["head"]  # whatever the partitions
    assert fitted.settings["trainable"] == 8 and fitted.settings["head_shift"] > 0 and 1 <= fitted.settings["epochs_used"] <= 30
    pool = pool_of(rows, s, 16)
    checks = [pool.episode(120 + i)[2:] for i in range(2)]
    before = np.mean([heads.loss(np.zeros((2, heads.WIDTH)), *c)[0] for c in checks])
    assert fitted.settings["validation_loss"] < before
    got = fitted.predict(rows).toPandas()
    assert len(got) == 600 and got["mu0"].between(0, 1).all() and np.isfinite(got["cate"]).all()
    assert got[got["a"] > 0]["cate"].mean() > got[got["a"] <= 0]["cate"].mean() + 0.2
    assert fitted.predict(rows.filter("epk_id < 0")).count() == 0


def test_early_stop_keeps_the_best_epoch():
    """Episodes that pull away from the validation labels stop after `patience` epochs, with the first epoch's head."""
    s = heads.Episodes(epochs=9, tasks=1, validation_tasks=1, step=0.1, patience=2)
    seen = np.zeros((4, 2 * heads.WIDTH))
    made = {i: (seen, np.ones((4, 2))) for i in range(9)} | {9: (seen, np.full((4, 2), 0.1))}
    w, history = heads.tuned_head(made, s)
    assert len(history) == 3 and history[0][1] == min(v for _, v in history) and w[:, 0] == pytest.approx(0.1, abs=1e-3)


def test_labels_are_in_range_and_do_not_depend_on_partitions(rows):
    trees = learners.Trees(rounds=5, step=0.3, leaves=4)
    one, two = (learners.potential_outcome_labels(r, trees, 3).orderBy("epk_id").toPandas() for r in (rows, rows.repartition(3)))
    assert np.array_equal(one[["label0", "label1"]], two[["label0", "label1"]]) and list(one.columns) == [*rows.columns, "label0", "label1"]
    assert len(one) == 600 and one[["label0", "label1"]].min().min() >= 0 and one[["label0", "label1"]].max().max() <= 1
    effect = one["label1"] - one["label0"]
    assert effect[one["a"] > 0].mean() > effect[one["a"] <= 0].mean() + 0.2


def test_what_cannot_be_tuned_raises(rows):
    for bad in ({"epochs": 0}, {"context": 3}, {"held": 0.5}, {"step": 0.0}, {"patience": 0}):
        with pytest.raises(ValueError):
            heads.tuned_stand_in(rows, X, 8, heads.Episodes(**bad), labels=truth)
    with pytest.raises(ValueError):
        heads.tuned_stand_in(rows.filter("t = 1"), X, 8, SMALL, labels=truth)
    with pytest.raises(ValueError):
        heads.tuned_stand_in(rows.limit(6), X, 8, SMALL, labels=truth)
    with pytest.raises(ValueError):
        heads.tuned_stand_in(rows, X, 0, SMALL, labels=truth)
