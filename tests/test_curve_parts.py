"""uplift_at and curve on cells of very many scores: parts that do not grow with the cell, whole and right results."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftwork.operators import curves

N = 24_000


@pytest.fixture
def parts(monkeypatch):
    """Sizes of the parts of each large cell, with parts of about 20 scores: more of them than 1,024."""
    sizes, settled = [], curves.settled

    def seen(df, name):
        out = settled(df, name)
        if name == "placed":
            sizes.append([r["count"] for r in out.groupBy("__part").count().collect()])
        return out

    monkeypatch.setattr(curves, "BUCKET_ROWS", 20)
    monkeypatch.setattr(curves, "settled", seen)
    monkeypatch.setattr(curves, "cumulative", partial(curves.cumulative, one_sort=10))
    return sizes


def rows(spark, score):
    t, y = F.pmod(F.xxhash64("id"), F.lit(2)).cast("int"), (F.pmod(F.xxhash64("id"), F.lit(7)) < 2).cast("int")
    return spark.range(N).select(F.lit("m").alias("model"), F.col("id").alias("epk_id"), t.alias("t"), y.alias("y"), score.alias("score"))


def test_rows_of_one_score_are_cut_by_id_in_small_parts(spark, parts):
    df = rows(spark, F.lit(0.5))
    top = df.filter(f"epk_id < {N // 5}").toPandas()
    want = top[top["t"] == 1]["y"].mean() - top[top["t"] == 0]["y"].mean()
    assert curves.uplift_at(df, ["model"], 0.2).first()["uplift"] == pytest.approx(want, abs=1e-12)
    assert len(parts) == 1 and sum(parts[0]) == N and len(parts[0]) > 1024 and max(parts[0]) <= 120


def test_uplift_curve_of_distinct_scores_in_small_parts(spark, parts):
    df = rows(spark, F.col("id") / 7.0)
    got = {r["x"]: r["gain"] for r in curves.curve(df, ["model"], "uplift").collect()}
    own = df.toPandas().sort_values("score", ascending=False)
    t, y, x = own["t"].to_numpy(), own["y"].to_numpy(), np.arange(1, N + 1)
    nt, nc = t.cumsum(), (1 - t).cumsum()
    want = ((y * t).cumsum() / np.maximum(nt, 1) - (y * (1 - t)).cumsum() / np.maximum(nc, 1)) * x
    assert got.pop(0) == 0 and list(sorted(got)) == list(x) and np.allclose([got[i] for i in x], want, atol=1e-9)
    assert len(parts) == 1 and sum(parts[0]) == N and len(parts[0]) > 1024 and max(parts[0]) <= 120
