import pytest
from pyspark.sql import functions as F

from liftwork.operators import bootstrap, learners, semisynth
from liftwork.plans import runs
from liftwork.sources import tables

TREES = learners.Trees(rounds=2, depth=2, step=0.3)


@pytest.fixture(scope="module")
def rows(spark):
    return semisynth.generate(tables.gaussian(spark, "gaussian:1500x2", 1), ["x0", "x1"], semisynth.Spec(0.4, 0.2, 1.0, seed=1)).cache()


def test_compare_and_analyse(spark, rows):
    models = {"t_learner": lambda d: learners.t_learner(d, TREES), "constant_ate": learners.constant_effect, "broken": lambda d: 1 / 0}
    metrics, scored = [], []
    for severity in (None, 200):
        where = {"dataset": "d", "axis": "scale", "severity_tag": "full" if severity is None else "rows200", "severity": None if severity is None else 200.0, "seed": 0}
        cell = runs.prepare_cell(rows, ["x0", "x1"], [], 0, "scale", severity)
        m, p = runs.compare(spark, cell, models, **where)
        metrics.append(m)
        scored.append(p)
    m, p = metrics[0].unionByName(metrics[1]), scored[0].unionByName(scored[1], allowMissingColumns=True).fillna("", ["severity_tag"])
    status = {(r["severity_tag"], r["model"]): r["status"] for r in m.collect()}
    assert status["full", "t_learner"] == "ok" and status["rows200", "broken"] == "error"
    assert m.filter("model = 't_learner'").agg(F.count("pehe")).first()[0] == 2
    found = runs.analyse(m, p, "t_learner", draws=20)
    assert found["paired"].filter("comparison = 'best_alternative'").count() == 2 and found["breakpoints"].count() == 1
    low = found["pooled"].filter("model = 'constant_ate'").first()
    assert low["ci_low"] == pytest.approx(0, abs=1e-9) and low["n_draws"] == 20


def test_tuning_resumes_and_is_sealed(spark, rows, tmp_path):
    cell = runs.prepare_cell(rows, ["x0", "x1"], [], 0)
    calls = []

    def build(params):
        calls.append(params)
        return lambda d: learners.t_learner(d, learners.Trees(rounds=params["rounds"], depth=2, step=0.3))

    args = (spark, cell, "t_learner", build, {"rounds": [1, 2]}, {"rounds": 1})
    assert runs.tune(*args, 1, 5, str(tmp_path)).count() == 1
    found = runs.tune(*args, 2, 5, str(tmp_path))
    assert found.count() == 2 and len(calls) == 2
    assert runs.final_test(spark, cell, found, "t_learner", build, str(tmp_path))["status"] == "ok"
    with pytest.raises(ValueError):
        runs.final_test(spark, cell, found, "t_learner", build, str(tmp_path))


def test_degenerate_cells_are_refused(rows):
    with pytest.raises(ValueError, match="degenerate_regime"):
        runs.prepare_cell(rows.withColumn("y", (F.col("epk_id") < 3).cast("int")), ["x0"], [], 0)


def test_cells_are_drawn_in_one_plan_as_each_alone(spark):
    """Cells of different sizes, one with a null tag and one with a quote in its name."""
    rows = [(d, "scale", tag, seed, m, i, i * 7907 % 97 % 2, int(i * 7919 % 101 < 40), float(i * (3 if m == "a" else 5) % 11)) for d, tag, seed, n in (("x", "rows200", 1, 90), ("it's", "full", 1, 60), ("x", None, 2, 75)) for m in "ab" for i in range(n)]
    scored = spark.createDataFrame(rows, "dataset string, axis string, severity_tag string, seed int, model string, epk_id long, t int, y int, score double").repartition(4)
    got = {(r["dataset"], r["severity_tag"], r["model"], r["metric"], r["b"]): r["value"] for r in runs.cell_draws(scored, 5, 3).collect()}
    table = {(r["dataset"], r["severity_tag"], r["model"], r["metric"]): r for r in runs.cell_table(scored, 5, 3).collect()}
    for d, tag, n in (("x", "rows200", 90), ("it's", "full", 60), ("x", None, 75)):
        own = scored.filter(F.col("dataset").eqNullSafe(F.lit(d)) & F.col("severity_tag").eqNullSafe(F.lit(tag))).select("epk_id", "model", "t", "y", "score")
        alone = bootstrap.long_draws(bootstrap.metric_draws(own, ["model"], 5, 3, tops=True), ["model"]).collect()
        for r in alone:
            have = got.pop((d, tag, r["model"], r["metric"], r["b"]))
            assert have == (None if r["value"] is None else pytest.approx(r["value"]))
        assert table[d, tag, "a", "ate"]["n_rows"] == n
    assert not got
    few = runs.with_cell(scored, 20, 3)[0]
    assert {r["n"] for r in few.groupBy("__cell").agg(F.count_distinct("epk_id").alias("n")).collect()} == {20}
    with pytest.raises(ValueError, match="different rows"):
        runs.cell_draws(scored.filter("NOT (model = 'a' AND epk_id = 5)"), 5, 3)
