"""Files of runs, reports, variants, tables of draws, and the network's validation rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftwork.operators import bootstrap, kernels, learners, regimes, splits, trials
from liftwork.plans import runs
from liftwork.sources import scratch, tables


@pytest.fixture(scope="module")
def scores(spark):
    draw = np.random.default_rng(3)
    rows = [(i, int(draw.integers(2)), int(draw.random() < 0.3), float(draw.integers(12))) for i in range(400)]
    return spark.createDataFrame([(m, i, t, y, s if m == "a" else float(i)) for i, t, y, s in rows for m in "ab"], "model string, epk_id long, t int, y int, score double")


def test_draw_table_against_plain_resampling(spark, scores):
    draws, seed = 6, 4
    got = {(r["model"], r["metric"]): r for r in bootstrap.draw_table(scores, ["model"], draws, seed).collect()}
    frame = scores.toPandas()
    weights = bootstrap.draw_weights(spark, 400, draws, seed).toPandas()
    for model in "ab":
        own = frame[frame["model"] == model].sort_values("epk_id").reset_index(drop=True)
        tops = []
        for b in range(draws):
            times = weights[weights["b"] == b].set_index("idx")["w"].reindex(range(400), fill_value=0)
            drawn = own.loc[own.index.repeat(times)].sort_values(["score", "epk_id"], ascending=[False, True]).head(80)
            tops.append(drawn[drawn["t"] == 1]["y"].mean() - drawn[drawn["t"] == 0]["y"].mean())
        row = got[model, "uplift_at_20pct"]
        best = own.sort_values(["score", "epk_id"], ascending=[False, True]).head(80)
        assert row["point_estimate"] == pytest.approx(best[best["t"] == 1]["y"].mean() - best[best["t"] == 0]["y"].mean())
        assert [row["ci_low"], row["ci_high"]] == pytest.approx(np.quantile(tops, [0.025, 0.975]))
        assert (row["n_rows"], row["n_draws"], row["n_failed_resamples"]) == (400, draws, 0)
    assert len(got) == 2 * len(bootstrap.METRICS)


def test_draws_without_an_arm_fail(spark):
    rows = spark.createDataFrame([("a", i, int(i == 0), i % 2, float(i)) for i in range(12)], "model string, epk_id long, t int, y int, score double")
    row = bootstrap.draw_table(rows, ["model"], 30, 1).filter("metric = 'ate'").first()
    assert 0 < row["n_failed_resamples"] < 30 and row["n_draws"] + row["n_failed_resamples"] == 30


def test_files(spark, tmp_path):
    assert tables.read_trials(spark, f"{tmp_path}/trials.csv").count() == 0
    params = '{"depth": 3, "name": "a, \\"b\\""}'
    tables.write_rows(f"{tmp_path}/trials.csv", [{"model": "m", "trial": 1, "status": "ok", "objective": 0.5, "params_json": params}], [f.split()[0] for f in tables.TRIAL_ROW.split(", ")])
    row = tables.read_trials(spark, f"{tmp_path}/trials.csv").first()
    assert (row["trial"], row["objective"], row["fit_seconds"], row["params_json"]) == (1, 0.5, None, params)
    good = spark.createDataFrame([(1, 0, 1, 0.5, "m")], "epk_id long, t int, y int, score double, model string")
    good.write.parquet(f"{tmp_path}/p/one/predictions.parquet")
    (tmp_path / "p" / "two.parquet").write_bytes(b"no parquet at all")
    assert tables.predictions_scan(spark, f"{tmp_path}/p").count() == 1
    np.savez(f"{tmp_path}/x.npz", x=np.arange(12.0).reshape(3, 2, 2))
    assert [tuple(r) for r in tables.covariates(spark, f"{tmp_path}/x.npz").orderBy("epk_id").collect()] == [(0, 0.0, 2.0), (1, 4.0, 6.0), (2, 8.0, 10.0)]
    about = tables.manifest("data", good.withColumn("split", F.lit("train")), seed=3)
    assert about["seed"] == 3 and about["rows"] == [{"split": "train", "n": 1, "treatment_rate": 0.0, "outcome_rate": 1.0}]


def test_intermediate_tables_can_be_discarded(spark):
    import os

    since = scratch.made()
    kept = scratch.settled(spark.range(5), "five")
    path = kept.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    scratch.discard(spark, since)
    assert not os.path.exists(path) and scratch.made() == since


def test_variants_and_order(spark):
    assert trials.variants("m", "context", [4096, 1024], 2048) == [("m#context1024", {"context": 1024}), ("m", {}), ("m#context4096", {"context": 4096})]
    assert trials.variants("m", "context", [], 2048) == [("m", {})] and trials.unique(["b", "a", "b"]) == ["b", "a"]
    rows = spark.createDataFrame([("z", 1), ("b", 2), ("a", 1), (None, 3), ("b", 1)], "model string, seed int")
    assert [tuple(r) for r in trials.ordered(rows, {"model": ["b", "a"]}, "seed").collect()] == [("b", 1), ("b", 2), ("a", 1), ("z", 1), (None, 3)]


def test_regime_report(spark):
    draws = spark.createDataFrame(
        [("d", "scale", f"scale_{k}", s, m, "qini", b, float(v) + b / 1000) for k, shift in enumerate((1, 0, -1)) for s in (0, 1) for b in range(20) for m, v in (("ref", shift), ("ref#depth3", 1), ("other", 0))],
        "dataset string, axis string, severity_tag string, seed int, model string, metric string, b int, value double",
    )
    metrics = draws.select("dataset", "axis", "severity_tag", "seed", "model").distinct().withColumns({"severity": F.when(F.col("severity_tag") != "scale_0", -F.substring("severity_tag", 7, 1).cast("double")), "hparam_value": F.when(F.col("model").contains("#"), 3.0)})
    pairs = bootstrap.paired(draws, "ref")
    breaks = regimes.breakpoints(pairs, metrics)
    text = tables.regime_report("Sweep", regimes.regime_map(breaks, pairs), regimes.regime_verdict(breaks), {"breaks": breaks})
    assert "- d / qini / scale: scale_0 +, scale_1 =, scale_2 -*" in text and "breaks on all axes (1 of 1)" in text
    indexed, shifts, verdict = regimes.hparam_influence(draws, metrics)
    assert {(r["model"], r["breaks"], r["robustness_index"], r["hparam_value"]) for r in indexed.collect()} == {("ref", True, 2, None), ("ref#depth3", False, 3, 3.0)}
    assert shifts.first()["breakpoint_shift_steps"] == 1 and verdict.first()["verdict"] == "moderate"


def test_network_takes_each_row_once_an_epoch_and_stops_by_validation_rows(spark):
    draw = np.random.default_rng(1)
    x, t = draw.normal(size=(600, 2)), draw.integers(0, 2, 600)
    y = (draw.random(600) < 0.3 + 0.3 * t * (x[:, 0] > 0)).astype(int)
    rows = spark.createDataFrame([(i, int(t[i]), int(y[i]), *map(float, x[i])) for i in range(600)], "epk_id long, t int, y int, a double, b double")
    model = kernels.dragonnet(rows.filter("epk_id < 450"), ["a", "b"], width=16, epochs=40, batch=64, validation=rows.filter("epk_id >= 450"))
    got = model.predict(rows).toPandas()
    assert got[got["a"] > 0]["cate"].mean() > got[got["a"] <= 0]["cate"].mean() + 0.05


def test_natural_risk_and_cells(spark):
    rows = spark.createDataFrame([(i, i * 7907 % 97 % 2, int(i * 7919 % 101 < 40), "abbccc"[i % 6], float(i % 7)) for i in range(6000)], "epk_id long, t int, y int, kind string, x double")
    assert [r[0] for r in rows.select("kind", learners.natural_risk(rows, "kind").alias("r")).distinct().orderBy("kind").select("r").collect()] == [2.0, 1.0, 0.0]
    cell = runs.prepare_cell(rows, ["x"], ["kind"], 1, "conversion", 2.0, risk="kind", equal_rows=900)
    assert {r["split"]: r["count"] for r in cell.groupBy("split").count().collect()} == {"train": 900, "validation": 300, "test": 300}
    with pytest.raises(ValueError, match="fewer than"):
        runs.prepare_cell(rows, ["x"], ["kind"], 1, equal_rows=10_000)
    with pytest.raises(ValueError, match="no covariate"):
        runs.prepare_cell(rows.withColumn("x", F.lit(1.0)), ["x"], ["kind"], 1, alpha=0.05)


def test_exact_groups(spark):
    rows = spark.range(1000).select(F.col("id").alias("epk_id"), (F.col("id") % 50).alias("g"))
    got = splits.group_exact_split(rows, "g", 5).groupBy("split").agg(F.count_distinct("g").alias("n"), F.count(F.lit(1)).alias("rows"))
    assert {r["split"]: (r["n"], r["rows"]) for r in got.collect()} == {"train": (30, 600), "validation": (10, 200), "test": (10, 200)}
