import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from liftwork.functions import statistics as st
from liftwork.operators import kernels, learners, prepare, semisynth
from liftwork.sources import tables

TREES = learners.Trees(rounds=8, depth=3, step=0.3)
X = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def data(spark):
    rows = semisynth.generate(tables.gaussian(spark, "gaussian:4000x3", 3), X, semisynth.Spec(base_rate=0.35, ate=0.2, heterogeneity=1.0, seed=3))
    return VectorAssembler(inputCols=X, outputCol="features").transform(rows).repartition(4).cache()


def rank_agreement(df):
    rows = df.select("cate", "tau").toPandas()
    assert np.isfinite(rows["cate"]).all()
    return st.pearson(st.average_ranks(rows["cate"].to_numpy()), st.average_ranks(rows["tau"].to_numpy()))


def test_generator(data):
    r = data.agg(F.avg("t"), F.avg("y"), F.avg("tau"), F.min("tau"), F.max("tau")).first()
    assert r[0] == pytest.approx(0.5, abs=0.03) and r[2] == pytest.approx(0.2, abs=0.03) and r[3] < 0.1 < 0.3 < r[4]


@pytest.mark.parametrize("name", ["t_learner", "x_learner", "dr_learner", "q_learner"])
def test_meta_learners_rank_the_effect(data, name):
    more = {"folds": 2} if name == "dr_learner" else {}
    assert rank_agreement(learners.LEARNERS[name](data, TREES, **more).predict(data)) > 0.3


def test_q_learner_needs_converters(data):
    with pytest.raises(ValueError):
        learners.q_learner(data.limit(40), TREES)


def test_kernels_rank_the_effect(data):
    gp = kernels.gp_cate(data, X, 3, 300, 300).predict(data)
    assert rank_agreement(gp) > 0.4 and gp.filter("cate_low > cate OR cate_high < cate").isEmpty()
    assert rank_agreement(kernels.dragonnet(data, X, width=16, epochs=30, step=5e-3).predict(data)) > 0.3
    assert rank_agreement(kernels.neighbour_stand_in(data, X).predict(data)) > 0.3
    labels = kernels.stand_in_pseudo_labels(data, X).agg(F.min("label"), F.max("label"), F.count("label")).first()
    assert 0 <= labels[0] and labels[1] <= 1 and labels[2] == 4000


def test_correction_of_strength_zero_changes_nothing(data):
    base = lambda rows: learners.constant_effect(rows)
    got = learners.residual_correction(data, base, TREES, folds=2, strength=0.0).predict(data).select("cate").distinct().collect()
    assert len(got) == 1


def test_preprocessing(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", 1.0, "a"), (2, "train", None, "b"), (3, "train", 3.0, "b"), (4, "test", 9.0, "z"), (5, "test", None, None)], "epk_id long, split string, v double, c string")
    out, fitted = prepare.prepare(df, ["v"], ["c"], ["epk_id"])
    assert fitted.numeric["v"][:2] == (2.0, 2.0) and fitted.categories["c"] == ("b", ["a", "b"])
    rows = {r["epk_id"]: r for r in out.collect()}
    assert (rows[4]["c_a"], rows[4]["c_b"]) == (0, 0) and rows[5]["c_b"] == 1 and rows[2]["v"] == 0
    fitted.save(spark, str(tmp_path / "p"))
    assert prepare.Preprocessor.load(spark, str(tmp_path / "p")) == fitted


def test_statistics():
    assert list(st.average_ranks(np.array([3, 1, 1]))) == [3, 1.5, 1.5]
    rho, p = st.spearman(np.array([1, 2, 3, 4]), np.array([1, 2, 3, 4]))
    assert rho == pytest.approx(1) and p == pytest.approx(2 / 24)
    assert st.student_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-3)


def test_load_and_reports(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("epk_id"), (F.col("id") % 2).cast("int").alias("T"), F.col("id").cast("double").alias("v"))
    rows.write.parquet(str(tmp_path / "d/features.parquet"))
    rows.select("epk_id", (F.col("epk_id") % 3 == 0).cast("int").alias("conversion")).write.parquet(str(tmp_path / "d/outcomes.parquet"))
    got = tables.load(spark, str(tmp_path), tables.Dataset("d", "conversion"), max_rows=50)
    assert got.count() == 50 and got.columns == ["epk_id", "t", "v", "y"]
    with pytest.raises(ValueError):
        tables.align(rows, rows.filter("epk_id > 3"))
    (tmp_path / "runs/a").mkdir(parents=True)
    (tmp_path / "runs/a/metrics.csv").write_text("model,qini\nm,0.5\n")
    assert tables.metrics_scan(spark, str(tmp_path / "runs")).first()["status"] == "ok"
    tables.write_json(tmp_path / "runs/a/run_config.json", {"seed": 1})
    (tmp_path / "runs/a/predictions.parquet").mkdir()
    assert tables.find_run(str(tmp_path / "runs"), {"seed": 1}) and not tables.find_run(str(tmp_path / "runs"), {"seed": 2})
    assert "| m |" in tables.markdown("t", {"s": spark.createDataFrame([("m",)], "model string")})
