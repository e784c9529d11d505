"""The estimates of quality rules against a search over all subsets."""

import math
from itertools import combinations

import numpy as np
import pytest

from liftwork.llm import quality

COLUMNS = "__lang string, __source string, __failed boolean, " + ", ".join(f"__{c}{i} double" for c in "xv" for i in range(4)) + ", i int"


def table(spark, groups):
    """groups: name -> (x, v), arrays of rows x 4."""
    return spark.createDataFrame([(k, "s", False, *map(float, a), *map(float, b), i) for k, (x, v) in groups.items() for i, (a, b) in enumerate(zip(x, v, strict=True))], COLUMNS)


def scatter(x, v, every, factor):
    centre = x.mean(0)
    return centre, factor * (x - centre).T @ (x - centre) / len(x) + np.diag(v.mean(0) + 1e-6 * every.var(0) + 1e-12)


def squared(x, centre, cov):
    d = x - centre
    return np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d)


def beyond_f(d2, n):
    """P(F > f) by numeric integration of the density with 4 and n - 4 degrees of freedom."""
    m, f = n - 4, d2 * n * (n - 4) / (4 * (n * n - 1))
    x = np.exp(np.linspace(np.log(max(f, 1e-12)), np.log(max(f, 1e-12)) + 40, 400_001))
    log = math.lgamma((4 + m) / 2) - math.lgamma(2) - math.lgamma(m / 2) + 2 * np.log(4 / m) + np.log(x) - (4 + m) / 2 * np.log1p(4 * x / m)
    return float(np.trapezoid(np.exp(log), x))


def brute_kept(x, v, share, outlier):
    """Verdicts from the subset with the least determinant of all, with one reweighting step."""
    h = math.ceil(share * len(x))
    found = min((scatter(x[list(s)], v, x, quality.consistency(share)) for s in combinations(range(len(x)), h)), key=lambda m: np.linalg.det(m[1]))
    inner = x[squared(x, *found) <= quality.chi2_quantile(0.975, 4)]
    last = scatter(inner, v, x, quality.consistency(0.975))
    return [beyond_f(d, len(inner)) >= outlier for d in squared(x, *last)]


def test_verdicts_are_those_of_the_least_determinant(spark):
    draw, groups = np.random.default_rng(5), {}
    for k in range(5):
        shape = draw.normal(0, 1, (4, 4))
        x = draw.normal(0, 1, (14, 4)) @ shape * 0.1
        x[: k % 3 + 1] += draw.choice([-1, 1], 4) * draw.uniform(2, 4, 4)
        if k == 4:
            x[3:, 1] = 0  # no spread at all among most rows
        groups[f"g{k}"] = x, draw.uniform(0.001, 0.01, (14, 4))
    got = quality.judged(*quality.fit(table(spark, groups), least_rows=10), 1e-2).collect()
    for k, (x, v) in groups.items():
        want = brute_kept(x, v, 0.75, 1e-2)
        assert [r["__kept"] for r in sorted(got, key=lambda r: r["i"]) if r["__lang"] == k] == want
        assert not all(want)


def test_verdict_follows_the_covariance(spark):
    """The same vector is an outlier where two statistics go together and none where they are independent."""
    draw = np.random.default_rng(6)
    x = draw.normal(0, 0.1, (300, 4))
    tied = x.copy()
    tied[:, 1] = tied[:, 0] + draw.normal(0, 0.005, 300)
    x[0] = tied[0] = [0.2, -0.2, 0, 0]
    zero = np.zeros((300, 4))
    got = quality.judged(*quality.fit(table(spark, {"free": (x, zero), "tied": (tied, zero)})), 1e-4).filter("i = 0").collect()
    assert {r["__lang"]: r["__kept"] for r in got} == {"free": True, "tied": False}


def test_groups_of_their_own(spark):
    """Each language and source with twenty rows is judged by itself; fewer are pooled by language."""
    draw = np.random.default_rng(7)
    parts = [("a", "big", 0.0, 60), ("a", "far", 5.0, 60), ("a", "few", 0.0, 7), ("a", "less", 0.0, 15), ("b", None, 0.0, 3)]
    rows = [(lang, source, False, *map(float, draw.normal(at, 0.1, 4)), 0.0, 0.0, 0.0, 0.0, 0) for lang, source, at, n in parts for _ in range(n)]
    rows, model = quality.fit(spark.createDataFrame(rows, COLUMNS))
    keys = {(r["__lang"], r["__source"]): r["__key"] for r in rows.select("__lang", "__source", "__key").distinct().collect()}
    assert keys["a", "big"] != keys["a", "far"] and keys["a", "few"] == keys["a", "less"] and keys["b", None] is None
    centre = {r["__key"]: r["__c0"] for r in model.collect()}
    assert len(centre) == 3 and abs(centre[keys["a", "far"]] - 5) < 0.1 and abs(centre[keys["a", "few"]]) < 0.1


@pytest.mark.parametrize("n", [20, 200, 100_000])
def test_likelihood_is_of_an_f_distribution(spark, n):
    from pyspark.sql import functions as F

    for d2 in (0.5, 9.0, 25.0):
        got = spark.range(1).select(quality.likelihood(F.lit(d2), F.lit(float(n))).alias("p")).first()["p"]
        assert got == pytest.approx(beyond_f(d2, n), rel=1e-4)
