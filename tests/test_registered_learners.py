"""The registered learner queries fit with the operators' defaults, all models of a stage together; their scores find the known effect."""

import time

import numpy as np
import pytest

from liftwork.functions import statistics as st
from liftwork.operators import boosting, gaussian, kernels, learners, network
from liftwork.plans import queries as q

#: Tree models of each stage that a query grows.
STAGES = {"t_learner": [2], "x_learner": [2, 2], "dr_learner": [10, 1], "q_learner": [3], "q_learner_ratio": [2], "residual_correction": [8], "overlap_summary": [5], "risk_scores": [6]}


@pytest.mark.parametrize("name", STAGES)
def test_trees(spark, sf, monkeypatch, name):
    seen, real = [], boosting.grow

    def watched(rows, goals, settings, features="features"):
        seen.append((len(goals), settings))
        return real(rows, goals, settings, features)

    monkeypatch.setattr(learners.boosting, "grow", watched)
    began = time.time()
    got = q.QUERIES[name](spark, sf).toPandas()
    assert time.time() - began < 60
    assert [n for n, _ in seen] == STAGES[name] and {s for _, s in seen} == {boosting.Settings(150, 31, 0.05, 20, 1e-3, 255, None)}
    assert len(got) > 0 and got.notna().all().all()
    if name == "risk_scores":
        assert got["risk"].between(0, 1).all() and got["risk"].nunique() > 20
    elif name != "overlap_summary":
        assert np.isfinite(got["cate"]).all() and got["cate"].nunique() > 20


def test_learners_rank_a_known_effect(spark, sf):
    """Over the whole split and all learners of the difference scale, scores agree with the effect more often than not."""
    rho = {}
    for name in ("t_learner", "x_learner", "dr_learner"):
        got = q.QUERIES[name](spark, sf.replace("sf0.001", "sf0.01")).toPandas()
        rho[name] = st.pearson(st.average_ranks(got["cate"].to_numpy()), st.average_ranks(got["tau"].to_numpy()))
    assert min(rho.values()) > 0.05, rho


def test_other_learners(spark, sf, monkeypatch):
    """The defaults that queries use, over all training rows."""
    seen, nets, gps = [], network.fit, gaussian.fit
    monkeypatch.setattr(kernels.network, "fit", lambda rows, columns, net, validation: seen.append((rows.count(), net)) or nets(rows, columns, net, validation))
    monkeypatch.setattr(kernels.gaussian, "fit", lambda rows, caps, *more, **how: seen.append((rows.count(), caps, *more)) or gps(rows, caps, *more, **how))
    n = q.learner_cell(spark, sf).filter("split = 'train'").count()
    for name in ("gp_cate", "dragonnet", "neighbour_stand_in", "x_over_stand_in", "tuned_stand_in"):
        got = q.QUERIES[name](spark, sf).toPandas()
        assert len(got) > 0 and np.isfinite(got["cate"]).all() and got["cate"].nunique() > 10, name
    assert seen == [(n, {0: 2000, 1: 500}, 1, 512), (n, network.Net(128, 100, 512, 1e-3, 1e-4, 12, 42))]
