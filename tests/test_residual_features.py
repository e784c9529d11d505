"""The residual correction sees the base score and the outcome means."""

import pytest
from pyspark.sql import functions as F
from test_learners import TREES, data  # noqa: F401

from liftwork.operators import learners


def off_by_a_coin(rows):
    """A base score that is wrong by what no feature tells."""
    return learners.Fitted("coin", lambda df: df.withColumn("cate", F.when(F.xxhash64("epk_id") % 2 == 0, 1.5).otherwise(-0.5)), {})


@pytest.mark.parametrize("linear", [True, False])
def test_correction_of_a_wrong_base_score(data, linear):  # noqa: F811
    base = off_by_a_coin(data).predict(data).select("epk_id", F.col("cate").alias("base"))
    got = learners.residual_correction(data, off_by_a_coin, TREES, folds=2, linear=linear).predict(data)
    assert got.columns == [*data.columns, "cate"]
    means = {r["base"]: r["m"] for r in got.join(base, "epk_id").groupBy("base").agg(F.avg("cate").alias("m")).collect()}
    assert abs(means[1.5] - means[-0.5]) < 1.2


def test_centring_keeps_the_mean_score(data):  # noqa: F811
    plain, centred = (learners.residual_correction(data, off_by_a_coin, TREES, folds=2, trim=0.0, centre=c).predict(data).agg(F.avg("cate")).first()[0] for c in (False, True))
    before = off_by_a_coin(data).predict(data).agg(F.avg("cate")).first()[0]
    assert abs(plain - before) > 0.1 and centred == pytest.approx(before, abs=0.05)
