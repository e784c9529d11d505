"""Weights by binomial splitting: exact sums, the multinomial's moments, the same for any partitioning, metrics by plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftwork.operators import bootstrap, curves


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(5)
    n = 700
    t, y, score = draw.integers(0, 2, n), draw.integers(0, 2, n), np.round(draw.random(n), 2)
    data = [(m, i * 3, int(t[i]), int(y[i]), float(score[i] if m == "a" else -score[i])) for i in range(n) for m in ("a", "b")]
    return spark.createDataFrame(data, "model string, epk_id long, t int, y int, score double").repartition(5)


def weights(n, draws, seed):
    chunks = [min(bootstrap.DRAWS, draws - c) for c in range(0, draws, bootstrap.DRAWS)]
    return np.concatenate([np.concatenate([bootstrap.block_weights(n, b, size, seed, c) for b in range(-(-n // bootstrap.BLOCK))], 1) for c, size in enumerate(chunks)])


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 1000])
def test_draws_sum_to_n(n):
    w = weights(n, 300, 4)
    assert w.shape == (300, n) and (w.sum(1) == n).all() and (w >= 0).all()


def test_moments_of_the_multinomial():
    """Each weight has mean 1 and variance 1 - 1/n, two have covariance -1/n, within a block and across."""
    n, draws = 600, 4000
    w = weights(n, draws, 1).astype(float)
    assert np.abs(w.mean(0) - 1).max() < 5 / draws**0.5
    assert w.var(0).mean() == pytest.approx(1 - 1 / n, abs=0.01)
    assert (w == 0).mean() == pytest.approx((1 - 1 / n) ** n, abs=0.002)
    halves = w[:, :256].sum(1)  # a block's total is Binomial(n, 256 / n)
    assert halves.var() == pytest.approx(n * (256 / n) * (1 - 256 / n), rel=0.1)
    assert np.abs(np.corrcoef(w[:, :40].T) - np.eye(40)).max() < 0.08


def test_same_weights_for_any_partitioning(spark):
    n, draws = 600, bootstrap.DRAWS + 5
    placed = spark.range(n).withColumnRenamed("id", "idx")
    want = weights(n, draws, 9)
    for parts in (1, 7):
        got = np.zeros((draws, n), int)
        for r in bootstrap.with_split_weights(placed.repartition(parts), F.lit(n), draws, 9).collect():
            assert got[r["b"], r["idx"]] == 0 and r["w"] > 0
            got[r["b"], r["idx"]] = r["w"]
        assert np.array_equal(got, want)
    assert bootstrap.with_split_weights(placed.limit(0), F.lit(0), 3, 9).count() == 0


def test_metrics_of_repeated_rows(rows):
    """A draw's metrics are those of the rows written out as often as they were drawn, paired over the models."""
    ids = sorted(r["epk_id"] for r in rows.select("epk_id").distinct().collect())
    w = weights(len(ids), 3, 6)
    got = {(r["model"], r["b"]): r for r in bootstrap.metric_draws(rows, ["model"], 3, 6, picks="split").collect()}
    for b in range(3):
        times = rows.sparkSession.createDataFrame([(i, int(k)) for i, k in zip(ids, w[b], strict=True) if k], "epk_id long, k long")
        many = rows.join(times, "epk_id").withColumn("nth", F.explode(F.sequence(F.lit(1), "k"))).withColumn("epk_id", F.col("epk_id") * 1000 + F.col("nth"))
        for r in curves.evaluate_uplift(many, ["model"], "epk_id").collect():
            assert got[r["model"], b]["qini_auc_normalized"] == pytest.approx(r["qini_auc_normalized"])
            assert got[r["model"], b]["ate"] == pytest.approx(r["ate_observed"])


def test_cells_are_drawn_as_alone(rows):
    both = rows.withColumn("cell", F.lit("x")).unionByName(rows.filter("epk_id < 900").withColumn("cell", F.lit("y's")))
    got = {(r["cell"], r["model"], r["b"]): r["auuc"] for r in bootstrap.metric_draws(both, ["cell", "model"], 4, 2, cell=["cell"], picks="split").collect()}
    assert len(got) == 16
    for cell in ("x", "y's"):
        own = bootstrap.metric_draws(both.filter(F.col("cell") == cell).drop("cell"), ["model"], 4, 2, picks="split").collect()
        for r in own:
            assert got[cell, r["model"], r["b"]] == pytest.approx(r["auuc"])


def test_bad_settings(rows):
    for bad in ({"picks": "poisson"}, {"draws": 0, "picks": "split"}, {"seed": -1, "picks": "split"}):
        with pytest.raises(ValueError):
            bootstrap.metric_draws(rows, ["model"], bad.get("draws", 2), bad.get("seed", 0), picks=bad["picks"])
