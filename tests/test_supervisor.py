"""Runs at once: limits, exclusive data sets, failures, time limits, resume; grids, gates, ledgers and surfaces."""

import json
import threading
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftwork.functions.columns import seed_of
from liftwork.operators import learners, resample, semisynth
from liftwork.plans import runs, supervisor
from liftwork.plans.supervisor import Job, Supervisor
from liftwork.sources import scratch, tables


def test_names_and_exclusive_sets():
    assert supervisor.names_of(" Alpha,alpha,BETA, ") == ["alpha", "beta"]
    assert supervisor.exclusive_of(["a", "b"], ["c"]) == set() and supervisor.exclusive_of(["a", "c"], ["c"]) == {"c"}


class Watch:
    """How many jobs run together, and whether an exclusive one is among several."""

    def __init__(self):
        self.lock, self.now, self.most, self.alone = threading.Lock(), [], 0, True

    def job(self, name, dataset="d", wait=0.3):
        def work(spark):
            with self.lock:
                self.now.append(dataset)
                self.most = max(self.most, len(self.now))
                self.alone &= "big" not in self.now or len(self.now) == 1
            spark.range(10).count()
            time.sleep(wait)
            with self.lock:
                self.now.remove(dataset)

        return Job(name, dataset, work)


def test_limit_and_exclusive(spark, tmp_path):
    watch = Watch()
    jobs = [watch.job(f"j{i}", "big" if i == 2 else "small") for i in range(6)]
    out = Supervisor(spark, 3, ["big"], path=f"{tmp_path}/status.json").run(jobs)
    assert {r["status"] for r in out.collect()} == {"ok"} and watch.alone and 2 <= watch.most <= 3
    assert [j["status"] for j in json.loads((tmp_path / "status.json").read_text())["jobs"]] == ["ok"] * 6
    assert Supervisor(spark, 1).run([]).count() == 0
    for bad in (lambda: Supervisor(spark, 0), lambda: Supervisor(spark, 1, seconds=0), lambda: Supervisor(spark, 1).run([watch.job("a"), watch.job("a")])):
        with pytest.raises(ValueError):
            bad()


def endless(spark):
    spark.range(8).repartition(8).select(F.expr("reduce(sequence(1, 60000), 0D, (a, x) -> a + sin(x + id))")).agg(F.count(F.lit(1))).collect()
    endless(spark)


def test_failure_and_time_limit_cancel(spark, tmp_path):
    watch, path = Watch(), f"{tmp_path}/status.json"
    failing = Job("bad", "d", lambda s: 1 / 0)
    out = Supervisor(spark, 2, stop_on_failure=True, path=path).run([Job("long", "d", endless), failing, watch.job("late"), watch.job("later")])
    got = {r["name"]: (r["status"], r["message"]) for r in out.collect()}
    assert got["bad"] == ("error", "division by zero") and got["long"] == ("cancelled", "another run failed") and got["later"][0] == "not started"
    out = Supervisor(spark, 2, seconds=1.0).run([Job("slow", "d", endless), watch.job("quick")])
    got = {r["name"]: r["status"] for r in out.collect()}
    assert got == {"slow": "cancelled", "quick": "ok"}


def test_resume_leaves_out_what_went_well(spark, tmp_path):
    path, calls = f"{tmp_path}/status.json", []

    def work(name, fail):
        def run(s):
            calls.append(name)
            if fail:
                raise ValueError("no")

        return Job(name, "d", run)

    Supervisor(spark, 1, path=path).run([work("a", False), work("b", True)])
    out = Supervisor(spark, 1, path=path).run([work("a", False), work("b", False)])
    assert calls == ["a", "b", "b"] and {r["status"] for r in out.collect()} == {"ok"}


def test_threads_discard_their_own_tables(spark):
    kept = scratch.settled(spark.range(5), "mine")

    def work(s):
        since = scratch.made()
        scratch.settled(s.range(3), "theirs")
        scratch.discard(s, since)
        assert since == 0

    out = Supervisor(spark, 2).run([Job("a", "d", work), Job("b", "d", work)])
    assert {r["status"] for r in out.collect()} == {"ok"} and kept.count() == 5


def test_ledger_names_what_is_left_out(spark, tmp_path):
    good = spark.createDataFrame([(1, 0, 1, 0.5, "m"), (2, 1, None, 0.5, "m")], "epk_id long, t int, y int, score double, model string")
    good.coalesce(1).write.parquet(f"{tmp_path}/p/one/predictions.parquet")
    good.drop("score", "t").coalesce(1).write.parquet(f"{tmp_path}/p/two/predictions.parquet")
    (tmp_path / "p" / "three.parquet").write_bytes(b"no parquet at all")
    rows, seen = tables.predictions_with_ledger(spark, f"{tmp_path}/p")
    assert [r["epk_id"] for r in rows.collect()] == [1]
    found = {("one" if "/one/" in r["path"] else "two" if "/two/" in r["path"] else "three"): r for r in seen.collect()}
    assert (found["one"]["rows"], found["one"]["reason"], found["one"]["rows_without_value"]) == (2, None, 1)
    assert found["two"]["reason"] == "lacks t, score" and found["three"]["reason"].startswith("cannot be read")
    none, seen = tables.predictions_with_ledger(spark, f"{tmp_path}/p/two")
    assert none.count() == 0 and seen.count() == 1


def test_reports_say_what_is_not_shown(spark):
    text = tables.markdown("t", {"s": spark.range(7)}, most_rows=5)
    assert "2 more rows are not shown" in text and "| 4 |" in text and "| 5 |" not in text
    assert "not shown" not in tables.markdown("t", {"s": spark.range(5)}, most_rows=5)


def test_grids_and_splits_to_degrade():
    scale, share = resample.AXES["scale"], resample.AXES["control_share"]
    assert resample.parse_grid(scale, None) == list(scale.grid) and resample.parse_grid(scale, "full, 2000,2000, 500,") == [None, 2000, 500]
    assert resample.parse_grid(share, "0.7,none") == [0.7, None]
    for axis, text in ((scale, ","), (share, "1.5"), (scale, "many")):
        with pytest.raises(ValueError):
            resample.parse_grid(axis, text)
    assert resample.degraded_splits(scale) == ("train", "validation") and resample.degraded_splits(scale, "TRAIN ") == ("train",)
    with pytest.raises(ValueError):
        resample.degraded_splits(scale, "test")


@pytest.fixture(scope="module")
def trial(spark):
    rows = spark.range(4000).select(F.col("id").alias("epk_id"), (F.xxhash64("id") % 1000 / 1000.0).alias("a"), F.element_at(F.array(*map(F.lit, "xyz")), (F.pmod(F.hash("id"), F.lit(3)) + 1).cast("int")).alias("kind"), F.lit(1.0).alias("same"))
    return scratch.settled(semisynth.generate(rows, ["a"], semisynth.Spec(0.3, 0.2, 1.0, seed=5), categorical=["kind"], n_signal=2), "trial")


def test_surfaces_over_encoded_columns(trial, spark):
    assert trial.columns == ["epk_id", "a", "kind", "same", "t", "y", "tau"]
    r = trial.agg(F.avg("t"), F.avg("tau"), F.stddev("tau"), F.avg(F.when(F.col("t") == 0, F.col("y")))).first()
    assert r[0] == pytest.approx(0.5, abs=0.03) and r[1] == pytest.approx(0.2, abs=0.05) and r[2] > 0.01 and r[3] == pytest.approx(0.3, abs=0.04)
    with pytest.raises(ValueError, match="do not vary"):
        semisynth.generate(trial.select("epk_id", "same"), ["same"], n_signal=1)


def test_confounding_only_on_purpose(trial):
    star = 0.3 + 0.4 * F.col("a") * F.col("a")
    with pytest.raises(ValueError, match="confounding"):
        runs.prepare_cell(trial, ["a"], ["kind"], 1, star=star)
    cell = runs.prepare_cell(trial, ["a"], ["kind"], 1, star=star, allow_confounding=True)
    assert cell.filter("NOT confounded").isEmpty() and 0 < cell.count() < trial.count()
    sizes = {r["split"]: r["count"] for r in runs.prepare_cell(trial, ["a"], ["kind"], 1, "scale", 500, splits_to="train").groupBy("split").count().collect()}
    assert sizes == {"train": 500, "validation": 800, "test": 800}


def test_a_ratio_has_no_error(spark, trial):
    trees = learners.Trees(rounds=3, leaves=4)
    cell = runs.prepare_cell(trial, ["a"], ["kind"], 1)
    metrics, _ = runs.compare(spark, cell, {"q_learner": lambda d: learners.q_learner(d, trees), "q_learner_ratio": lambda d: learners.q_learner(d, trees, ratio=True)})
    got = {r["model"]: r for r in metrics.collect()}
    assert got["q_learner"]["pehe"] > 0 and got["q_learner_ratio"]["pehe"] is None and got["q_learner_ratio"]["abs_ate_error"] is None
    assert got["q_learner_ratio"]["status"] == "ok"


def test_learners_refuse_bad_settings_and_say_what_they_used(trial):
    cell = runs.prepare_cell(trial, ["a"], ["kind"], 1).filter("split = 'train'")
    for bad in (learners.Trees(rounds=0), learners.Trees(leaves=1), learners.Trees(step=2.0), learners.Trees(bins=300), learners.Trees(l2=-1.0), learners.Trees(rounds=True)):
        with pytest.raises(ValueError):
            learners.t_learner(cell, bad)
    for f in (lambda: learners.dr_learner(cell, folds=1), lambda: learners.dr_learner(cell, low=0.5), lambda: learners.q_learner(cell, least_converters=0), lambda: learners.residual_correction(cell, learners.constant_effect, trim=0.7)):
        with pytest.raises(ValueError):
            f()
    used = learners.t_learner(cell, learners.Trees(rounds=1)).settings
    sizes = {r["t"]: r["count"] for r in cell.groupBy("t").count().collect()}
    assert (used["n_control_used"], used["n_treated_used"]) == (sizes[0], sizes[1])


def test_seeds_follow_from_their_parts(spark):
    r = spark.createDataFrame([("d", "scale", 3)], "a string, b string, c int").select(seed_of("a", F.col("b"), "c")).first()
    assert r[0] == zlib.crc32(b"d/scale/3")


def test_rank_cuts_in_large_buckets(spark, monkeypatch):
    from liftwork.operators import splits

    rows = spark.range(3000).select(F.col("id").alias("epk_id"), (F.col("id") % 2).cast("int").alias("t"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    plain = {n: sorted(r["epk_id"] for r in splits.exact_cap(rows, n, "s").collect()) for n in (1, 77, 2999)}
    split = sorted(map(tuple, splits.stratified_split(rows, 3).select("epk_id", "split").collect()))
    monkeypatch.setattr(splits, "LOOK_INTO", 2)
    monkeypatch.setattr(splits, "BUCKETS", 8)
    assert {n: sorted(r["epk_id"] for r in splits.exact_cap(rows, n, "s").collect()) for n in (1, 77, 2999)} == plain
    assert sorted(map(tuple, splits.stratified_split(rows, 3).select("epk_id", "split").collect())) == split
    assert np.array_equal(np.unique([s for _, s in split], return_counts=True)[1], [600, 1800, 600])
