import numpy as np
import pytest

from liftwork.operators import bootstrap, curves, diagnostics, regimes, resample, splits, trials, validate
from pyspark.sql import functions as F

COLUMNS = "cell string, epk_id long, score double, t int, y int"


def frame(spark, rows):
    return spark.createDataFrame([("c", i, float(s), t, y) for i, (s, t, y) in enumerate(rows)], COLUMNS)


def brute(rows, kind):
    """Vertices by walking the rows, one score at a time."""
    out = [(0, 0.0)]
    for s in sorted({r[0] for r in rows}, reverse=True):
        top = [r for r in rows if r[0] >= s]
        nt, nc = sum(r[1] for r in top), sum(1 - r[1] for r in top)
        yt, yc = sum(r[2] for r in top if r[1]), sum(r[2] for r in top if not r[1])
        q = yt - yc * nt / nc if nc else 0.0
        u = ((yt / nt if nt else 0) - (yc / nc if nc else 0)) * len(top)
        out.append((len(top), q if kind == "qini" else u))
    return out


def area(points):
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))


def brute_metrics(rows):
    perfect = [(y * t - y * (1 - t), t, y) for _, t, y in rows]
    harm = sum(1 for _, t, y in rows if y and not t) > sum(1 for _, t, y in rows if not y and t)
    best = [(2 * (y == t) + (y if harm else t), t, y) for _, t, y in rows]
    q, p, u, b = brute(rows, "qini"), brute(perfect, "qini"), brute(rows, "uplift"), brute(best, "uplift")
    line, flat = len(rows) * p[-1][1] / 2, len(rows) * b[-1][1] / 2
    return ((area(q) - line) / (area(p) - line) if abs(area(p) - line) > 1e-12 else None, (area(u) - flat) / (area(b) - flat) if abs(area(b) - flat) > 1e-12 else None, area(u) / len(rows) ** 2)


def test_hand_worked_qini(spark):
    df = frame(spark, [(3, 1, 1), (2, 0, 1), (1, 1, 0), (0, 0, 0)])
    assert [tuple(r) for r in curves.curve(df, ["cell"], "qini").select("x", "gain").orderBy("x").collect()] == [(0, 0.0), (1, 0.0), (2, 0.0), (3, -1.0), (4, 0.0)]
    assert curves.areas(df, ["cell"]).first()["qini_area"] == -1.0
    assert curves.ranking_metrics(df, ["cell"]).first()["qini_auc_normalized"] == pytest.approx(-1 / 1.5)


def test_metrics_against_brute_force(spark):
    draw = np.random.default_rng(5)
    cells, rows = [], []
    for c in range(40):
        n = int(draw.integers(2, 14))
        own = [(float(draw.integers(0, 5)), int(draw.integers(0, 2)), int(draw.integers(0, 2))) for _ in range(n)]
        own[0], own[1] = (own[0][0], 0, own[0][2]), (own[1][0], 1, own[1][2])
        cells.append(own)
        rows += [(str(c), i, s, t, y) for i, (s, t, y) in enumerate(own)]
    got = {r["cell"]: r for r in curves.ranking_metrics(spark.createDataFrame(rows, COLUMNS), ["cell"]).collect()}
    for c, own in enumerate(cells):
        r, want = got[str(c)], brute_metrics(own)
        for x, w in zip((r["qini_auc_normalized"], r["uplift_auc_normalized"], r["auuc"]), want, strict=True):
            assert (x is None) == (w is None) and (w is None or x == pytest.approx(w, abs=1e-9))


def test_constant_score_and_no_events(spark):
    r = curves.ranking_metrics(frame(spark, [(1, 1, 1), (1, 0, 0), (1, 1, 0), (1, 0, 1)]), ["cell"]).first()
    assert r["qini_auc_normalized"] == 0 and r["qini_coefficient"] == 0 and r["uplift_auc_normalized"] == 0
    assert curves.ranking_metrics(frame(spark, [(1, 1, 0), (2, 0, 0)]), ["cell"]).first()["qini_auc_normalized"] is None


def test_uplift_at_floors(spark):
    rows = [(11 - i, 1 - i % 2, int(i == 0)) for i in range(11)]
    assert curves.uplift_at(frame(spark, rows), ["cell"], 0.2).first()["uplift"] == 1.0
    with pytest.raises(ValueError):
        curves.uplift_at(frame(spark, rows), ["cell"], 0.0)


def test_average_ranks(spark):
    got = {r["score"]: r["rank"] for r in curves.average_ranks(frame(spark, [(3, 0, 0), (1, 0, 0), (1, 0, 0)]), ["cell"]).collect()}
    assert got == {3.0: 3.0, 1.0: 1.5}


def test_accept_probability_and_outcome_blindness(spark):
    df = spark.createDataFrame([(i, s, i % 2, y) for i, (s, y) in enumerate([(1.0, 0), (1.0, 1), (2.0, 0), (3.0, 1)])], "epk_id long, risk double, t int, y int")
    got = [r["accept"] for r in resample.accept_probability(df, "risk", 2.0).orderBy("epk_id").collect()]
    assert got == pytest.approx([np.exp(-1 / 3), np.exp(-1 / 3), np.exp(-4 / 3), np.exp(-2)])
    kept = [r[0] for r in resample.conversion(df, "risk", 2.0, "s").select("epk_id").orderBy("epk_id").collect()]
    flipped = [r[0] for r in resample.conversion(df.withColumn("y", 1 - F.col("y")), "risk", 2.0, "s").select("epk_id").orderBy("epk_id").collect()]
    assert kept == flipped


def test_control_share_reaches_target(spark):
    df = spark.range(20000).select(F.col("id").alias("epk_id"), (F.col("id") % 2).cast("int").alias("t"), F.lit(0).alias("y"))
    out = resample.control_share(df, 0.9, "x")
    assert out.agg(F.avg("t")).first()[0] == pytest.approx(0.9, abs=0.02) and out.filter("t = 1").count() == 10000
    with pytest.raises(ValueError):
        resample.rejection_sample(df, F.lit(1.0), "x")
    with pytest.raises(ValueError):
        resample.rejection_sample(df, F.lit(0.9), "x", envelope=1.0)


def test_axes():
    a = resample.AXES["control_share"]
    assert a.tag(0.95) == "control_share_trate0p950" and a.tag(None) == "control_share_full" and a.parse("0.7") == 0.7
    with pytest.raises(ValueError):
        a.parse("1.5")
    assert resample.AXES["scale"].order(5000) > resample.AXES["scale"].order(50000) > resample.AXES["scale"].order(None)
    assert resample.AXES["conversion"].is_anchor(0.0)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(0.001,), (0.002,), (0.9,)], "p double")
    assert [r["rejected"] for r in diagnostics.benjamini_hochberg(df).orderBy("p").collect()] == [True, True, False]


def test_point_biserial_p(spark):
    df = spark.range(200).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + F.sin("id")).alias("a"), F.lit(1.0).alias("b"))
    got = {r["name"]: r for r in diagnostics.point_biserial(df, ["a", "b"]).collect()}
    assert got["a"]["p"] < 1e-6 and got["b"]["r"] == 0 and got["b"]["p"] == 1


def test_pehe(spark):
    df = spark.createDataFrame([("m", 1.0, 0.0), ("m", -1.0, 0.0)], "model string, score double, tau double")
    r = regimes.effect_error(df, ["model"]).first()
    assert r["pehe"] == 1 and r["abs_ate_error"] == 0


def test_bootstrap_weights_equal_expanded_rows(spark):
    draw = np.random.default_rng(1)
    rows = [("m", i, float(draw.integers(0, 4)), int(draw.integers(0, 2)), int(draw.integers(0, 2))) for i in range(60)]
    df = spark.createDataFrame(rows, "model string, epk_id long, score double, t int, y int")
    got = {r["b"]: r for r in bootstrap.metric_draws(df, ["model"], 4, 3).collect()}
    picks = bootstrap.draw_weights(spark, 60, 4, 3).collect()
    for b in range(4):
        own = [(rows[p["idx"]][2:]) for p in picks if p["b"] == b for _ in range(p["w"])]
        assert len(own) == 60
        want = brute_metrics(own)
        assert got[b]["qini_auc_normalized"] == pytest.approx(want[0]) and got[b]["auuc"] == pytest.approx(want[2])


def test_splits(spark):
    df = spark.range(1000).select(F.col("id").alias("epk_id"), (F.col("id") % 2).cast("int").alias("t"), (F.col("id") % 5 == 0).cast("int").alias("y"), (F.col("id") % 100).cast("string").alias("g"))
    s = splits.stratified_split(df, 1)
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 600, "validation": 200, "test": 200}
    assert validate.check_splits(s, df) == []
    g = splits.group_safe_split(df, "g", 1)
    splits.check_no_leakage(g, "g")
    with pytest.raises(ValueError):
        splits.check_no_leakage(s, "g")
    assert splits.fold_count(df, 5) == 5 and splits.kfold(df, 5, 0).groupBy("fold").count().count() == 5
    assert splits.context_sample(df, 10, "c").select("t", "y").distinct().count() == 4


def test_gate_and_validators(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 0, 0)], "cell string, t int, y int")
    assert validate.event_gate(df, ["cell"]).first()["degenerate"]
    with pytest.raises(ValueError):
        validate.check_metric_inputs(df.withColumn("score", F.lit(float("nan"))))
    with pytest.raises(ValueError):
        validate.check_whole("n", True, 1)


def test_trial_choice_and_settings(spark):
    df = spark.createDataFrame([("m", 1, "ok", 0.5, 0.02, 1.0), ("m", 2, "ok", 0.5, 0.03, 9.0), ("m", 3, "error", 0.9, 0.9, 0.1)], "model string, trial int, status string, objective double, uplift_at_10pct double, fit_seconds double")
    assert trials.best_trials(df).first()["trial"] == 2
    space, base = {"step": (0.01, 0.3), "depth": [3, 5]}, {"step": 0.05, "depth": 5}
    assert trials.random_trial(space, base, 1, 0, 0) == base
    assert trials.random_trial(space, base, 1, 0, 3) == trials.random_trial(space, base, 1, 0, 3)
    assert trials.compatible({"a": 0.1}, {"a": 0.1 + 1e-12, "b": 3, "c": None}) and not trials.compatible({"a": 1}, {"a": 2})
    assert trials.sweep_matrix(spark, ["d"], ["scale", "conversion"], [0, 1]).count() == 24


def test_sums_in_buckets_equal_one_sort(spark):
    """The way for cells of very many scores gives what one sort does."""
    from liftwork.operators import curves

    rows = spark.range(3000).select(F.expr("id % 2").alias("cell"), (F.pmod(F.xxhash64("id"), F.lit(700)) / 7.0).alias("score"), (F.col("id") % 3).alias("nt"), (F.col("id") % 5).alias("nc"), F.lit(1).alias("yt"), F.lit(2).alias("yc"))
    counts = rows.groupBy("cell", "score").agg(*(F.sum(c).alias(c) for c in curves.COUNTS))
    one = sorted(map(tuple, curves.cumulative(counts, ["cell"]).collect()))
    was = curves.BUCKET_ROWS, curves.STEP
    try:
        curves.BUCKET_ROWS, curves.STEP = 5, 4
        many = curves.cumulative(counts, ["cell"], one_sort=10)
        got = sorted(map(tuple, many.select(*["cell", "score", *curves.COUNTS, *(f"c{c}" for c in curves.COUNTS)]).collect()))
    finally:
        curves.BUCKET_ROWS, curves.STEP = was
    assert got == one and len(one) > 600


def test_parts_of_a_cell_stay_small_as_it_grows(spark, monkeypatch):
    monkeypatch.setattr(curves, "BUCKET_ROWS", 20)
    sizes = {}
    settled = curves.settled

    def seen(df, name):
        out = settled(df, name)
        if name == "placed":
            sizes[df.count()] = [r["count"] for r in out.groupBy("__part").count().collect()]
        return out

    monkeypatch.setattr(curves, "settled", seen)
    for n in (2_000, 25_000):  # more parts than the 1,024 buckets of before would hold
        rows = spark.range(n).select(F.when(F.col("id") % 2 == 0, "a").alias("cell"), F.col("id").cast("double").alias("score"), F.lit(1).alias("nt"))
        sums = curves.cumulative(rows, ["cell"], ("nt",), one_sort=10)
        assert sums.filter("cnt <> floor((%d - 1 - score) / 2) + 1" % n).count() == 0
        assert sums.count() == n
    assert len(sizes[25_000]) > 1024 and max(sizes[25_000]) <= 3 * max(sizes[2_000])


def test_picks_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "PART", 50)
    drawn = bootstrap.draw_weights(spark, 100, 4, 1)
    assert drawn.rdd.getNumPartitions() == 8 and drawn.agg(F.sum("w")).first()[0] == 400


@pytest.mark.parametrize("picks", ["hash", "split"])
def test_effects_alone_and_tops_of_cut_scores(spark, monkeypatch, picks):
    rows = spark.range(300).select(F.explode(F.array(*map(F.lit, "ab"))).alias("model"), F.col("id").alias("epk_id"), (F.col("id") % 2).cast("int").alias("t"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    rows = rows.withColumn("score", F.when(F.col("model") == "a", F.col("epk_id").cast("double")).otherwise(F.floor(F.col("epk_id") / 100).cast("double")))
    kept, top_of = [], bootstrap.top_of
    monkeypatch.setattr(bootstrap, "top_of", lambda given, *more: top_of(lambda keep: given(lambda some: (kept.append((some.count(), keep(some).count())), keep(some))[1]), *more))
    whole = bootstrap.metric_draws(rows, ["model"], 3, 5, tops=True, picks=picks).collect()
    assert kept and kept[0][0] == 600 and kept[0][1] < 150  # the weights of all rows were made again before
    alone = {(r["model"], r["b"]): r["ate"] for r in bootstrap.ate_draws(rows, ["model"], 3, 5, picks=picks).collect()}
    assert alone == {(r["model"], r["b"]): r["ate"] for r in whole}
