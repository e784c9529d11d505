"""Effect learners on boosted trees. A learner is fitted on rows (id, t, y, features) and adds cate to rows.

All models that a learner needs at once, of both arms and of every fold, grow in one stage (see `boosting`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import aipw, aipw_outcomes, clip, q_means, q_ratio
from ..sources.scratch import settled
from . import boosting
from .boosting import Forest, Goal
from .diagnostics import spreads
from .prepare import frequency_ordinal
from .quantiles import percentiles
from .splits import fold_count, kfold
from .validate import check_range, check_whole, require

Adder = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Trees:
    """Settings of the boosted trees. The seed deals folds; trees themselves draw nothing."""

    seed: int = 42
    rounds: int = 150
    leaves: int = 31
    step: float = 0.05
    least_rows: int = 20
    l2: float = 1e-3
    bins: int = 255
    depth: int | None = None

    def grow(self, rows: DataFrame, goals: list[Goal], features: str = "features") -> Forest:
        for name, least in (("rounds", 1), ("leaves", 2), ("least_rows", 1), ("bins", 2)):
            check_whole(name, getattr(self, name), least)
        check_range("bins", self.bins, 2, 255)
        check_range("step", self.step, 0, 1)
        check_range("l2", self.l2, 0, float("inf"))
        return boosting.grow(rows, goals, boosting.Settings(self.rounds, self.leaves, self.step, self.least_rows, self.l2, self.bins, self.depth), features)

    def regressor(self, rows: DataFrame, label: str, features: str = "features") -> Adder:
        """Adds the predicted label; equal labels give their value."""
        forest = self.grow(rows, [Goal(F.col(label), binary=False)], features)
        return lambda df, out: forest.add(df, {out: 0}, features)


@dataclass(frozen=True)
class Fitted:
    """A learner after fit: adds cate, and knows its settings and whether cate is a difference or a ratio."""

    name: str
    add: Callable[[DataFrame], DataFrame]
    settings: dict
    scale: str = "difference"

    def predict(self, df: DataFrame) -> DataFrame:
        return self.add(df)


def arm(df: DataFrame, t: int) -> DataFrame:
    return df.filter(F.col("t") == t)


def treated_share(df: DataFrame, low: float) -> float:
    return min(max(df.agg(F.avg(F.col("t").cast("double"))).first()[0], low), 1 - low)


def constant_effect(train: DataFrame, trees: Trees = Trees()) -> Fitted:
    y = F.col("y")
    ate = train.agg(F.avg(F.when(F.col("t") == 1, y)) - F.avg(F.when(F.col("t") == 0, y))).first()[0]
    return Fitted("constant_ate", lambda df: df.withColumn("cate", F.lit(ate)), {})


def check_clip(low: float) -> None:
    require(0 < low < 0.5, "the propensity clip lies in (0, 0.5)")


def by_arm(label: Column, where: Column | None = None) -> list[Goal]:
    """A classifier for each arm, control first."""
    return [Goal(label, (F.col("t") == a) if where is None else (F.col("t") == a) & where) for a in (0, 1)]


def used(forest: Forest) -> dict:
    """The rows that a learner's first models had, whatever was asked for."""
    return {"n_control_used": forest.rows[0], "n_treated_used": forest.rows[1]}


def t_learner(train: DataFrame, trees: Trees = Trees()) -> Fitted:
    forest = trees.grow(train, by_arm(F.col("y")))
    return Fitted("t_learner", lambda df: forest.add(df, {"__0": 0, "__1": 1}).withColumn("cate", F.col("__1") - F.col("__0")).drop("__0", "__1"), vars(trees) | used(forest))


def x_learner(train: DataFrame, trees: Trees = Trees()) -> Fitted:
    means = trees.grow(train, by_arm(F.col("y")))
    crossed = means.add(train, {"__m": 1 - F.col("t")})  # what the other arm's model expects
    gap = F.when(F.col("t") == 1, F.col("y") - F.col("__m")).otherwise(F.col("__m") - F.col("y"))
    effects = trees.grow(crossed, [Goal(gap, F.col("t") == a, binary=False) for a in (0, 1)])
    g = treated_share(train, 1e-3)
    return Fitted("x_learner", lambda df: effects.add(df, {"__0": 0, "__1": 1}).withColumn("cate", g * F.col("__0") + (1 - g) * F.col("__1")).drop("__0", "__1"), vars(trees) | used(means))


def dealt(train: DataFrame, folds: int, seed: int) -> tuple[DataFrame, int]:
    """(`train` with fold, written and reread; how many folds there are)."""
    n = fold_count(train, folds)
    return settled(kfold(train, n, seed), "folds"), n


def out_of_fold(train: DataFrame, folds: int, seed: int, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """`train` with what `fit` on the other folds adds to each fold."""
    rows, n = dealt(train, folds, seed)
    parts = [fit(rows.filter(F.col("fold") != k).drop("fold"))(rows.filter(F.col("fold") == k)) for k in range(n)]
    return reduce(DataFrame.unionByName, parts).drop("fold")


def pseudo_outcomes(train: DataFrame, trees: Trees, folds: int, low: float) -> DataFrame:
    """`train` with out-of-fold mu0, mu1 and the doubly robust pseudo-outcome."""
    check_whole("folds", folds, 2)
    check_clip(low)
    require(train.groupBy("t", "y").count().filter("count < 2").isEmpty(), "cross-fitting needs two rows in every stratum")
    e = treated_share(train, low)
    rows, n = dealt(train, folds, trees.seed)
    forest = trees.grow(rows, [goal for k in range(n) for goal in by_arm(F.col("y"), F.col("fold") != k)])
    crossed = forest.add(rows, {"mu0": 2 * F.col("fold"), "mu1": 2 * F.col("fold") + 1}).drop("fold")
    return crossed.withColumn("pseudo", aipw(F.col("mu0"), F.col("mu1"), F.lit(e), F.col("t"), F.col("y")))


def potential_outcome_labels(train: DataFrame, trees: Trees = Trees(rounds=100), folds: int = 5, low: float = 0.02) -> DataFrame:
    """`train` with label0 and label1, smoothed doubly robust labels of both potential outcomes in [0, 1].

    The signals come from out-of-fold outcome means. A second deal of folds regresses them on the features, so that no
    row's own noisy signal trains its label.
    """
    signals = pseudo_outcomes(train, trees, folds, low)
    first, second = aipw_outcomes(F.col("mu0"), F.col("mu1"), F.lit(treated_share(train, low)), F.col("t"), F.col("y"))
    rows, n = dealt(signals.withColumns({"__s0": first, "__s1": second}).select(*train.columns, "__s0", "__s1"), folds, trees.seed + 1)
    forest = trees.grow(rows, [Goal(F.col(s), F.col("fold") != k, binary=False) for k in range(n) for s in ("__s0", "__s1")])
    found = forest.add(rows, {"__l0": 2 * F.col("fold"), "__l1": 2 * F.col("fold") + 1})
    return found.select(*train.columns, *(clip(F.col(f"__l{a}"), 0.0, 1.0).alias(f"label{a}") for a in (0, 1)))


def dr_learner(train: DataFrame, trees: Trees = Trees(), folds: int = 5, low: float = 0.02) -> Fitted:
    effect = trees.regressor(pseudo_outcomes(train, trees, folds, low), "pseudo")
    return Fitted("dr_learner", lambda df: effect(df, "cate"), vars(trees) | {"folds": folds, "low": low})


def q_learner(train: DataFrame, trees: Trees = Trees(), ratio: bool = False, least_converters: int = 50, low: float = 0.01) -> Fitted:
    """By the treatment propensity among all rows and among converters; on the difference or the ratio scale."""
    check_whole("least_converters", least_converters, 1)
    check_clip(low)
    facts = train.filter("y = 1").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("arms")).first()
    require(facts["n"] >= least_converters, f"at least {least_converters} converters; there are {facts['n']}")
    require(facts["arms"] == 2, "converters in both arms")
    forest = trees.grow(train, [Goal(F.col("t")), Goal(F.col("t"), F.col("y") == 1), *([] if ratio else [Goal(F.col("y"))])])

    def add(df: DataFrame) -> DataFrame:
        df = forest.add(df, {"__e": 0, "__p": 1} | ({} if ratio else {"__m": 2}))
        a, b = clip(F.col("__e"), low, 1 - low), clip(F.col("__p"), low, 1 - low)
        if ratio:
            return df.withColumn("cate", q_ratio(a, b)).drop("__e", "__p")
        mu1, mu0 = q_means(a, b, F.col("__m"))
        return df.withColumn("cate", mu1 - mu0).drop("__e", "__p", "__m")

    return Fitted("q_learner_ratio" if ratio else "q_learner", add, vars(trees) | {"n_converters": facts["n"], "least_converters": least_converters}, "ratio" if ratio else "difference")


def residual_correction(train: DataFrame, base: Callable[[DataFrame], Fitted], trees: Trees = Trees(), folds: int = 3, low: float = 0.02, strength: float = 1.0, trim: float = 0.01, linear: bool = True, centre: bool = False) -> Fitted:
    """A base scorer plus `strength` times a learnt, winsorised doubly robust residual.

    The correction's features are the rows' own with cate and both outcome means: out of fold in training, from models
    of all training rows in scoring. `centre` takes the correction's mean over the training rows off.
    """
    check_whole("folds", folds, 2)
    check_clip(low)
    check_range("strength", strength, 0, float("inf"))
    check_range("trim", trim, 0, 0.49)
    assemble = VectorAssembler(inputCols=["features", "cate", "__m0", "__m1"], outputCol="__x").transform
    rows, n = dealt(train, folds, trees.seed)
    forest = trees.grow(rows, [goal for k in range(n + 1) for goal in by_arm(F.col("y"), F.col("fold") != k)])  # the last pair is of all rows
    scorer = base(train)
    parts = [base(rows.filter(F.col("fold") != k).drop("fold")).predict(rows.filter(F.col("fold") == k)) for k in range(n)]
    based = reduce(DataFrame.unionByName, parts)
    e = treated_share(train, low)
    rows = assemble(forest.add(based, {"__m0": 2 * F.col("fold"), "__m1": 2 * F.col("fold") + 1})).drop("fold")
    rows = settled(rows.withColumn("__r", aipw(F.col("__m0"), F.col("__m1"), F.lit(e), F.col("t"), F.col("y")) - F.col("cate")), "residuals")
    low_r, high_r = percentiles(rows, ["__r"], [trim, 1 - trim])["__r"]
    seen = spreads(rows, ["__r", "cate"]).collect()
    rows = rows.withColumn("__r", clip(F.col("__r"), low_r, high_r))
    if linear:
        model = LinearRegression(featuresCol="__x", labelCol="__r", predictionCol="__c", regParam=1.0, elasticNetParam=0.0).fit(rows.select("__x", "__r"))
        correct: Adder = lambda df, out: model.transform(df).withColumnRenamed("__c", out)
    else:
        correct = trees.regressor(rows, "__r", "__x")
    middle = correct(rows, "__c").agg(F.avg("__c")).first()[0] if centre else 0.0
    added = strength * clip(F.col("__c") - F.lit(middle), low_r, high_r)

    def add(df: DataFrame) -> DataFrame:
        inner = assemble(forest.add(scorer.predict(df), {"__m0": 2 * n, "__m1": 2 * n + 1}))
        return correct(inner, "__c").withColumn("cate", F.col("cate") + added).drop("__c", "__x", "__m0", "__m1")

    return Fitted("residual_correction", add, scorer.settings | {"strength": strength, "trim": trim, "centre": centre, "diagnostics": [r.asDict() for r in seen]})


def cross_fitted_propensity(train: DataFrame, trees: Trees = Trees(), folds: int = 5) -> DataFrame:
    """`train` with the out-of-fold propensity e."""
    rows, n = dealt(train, folds, trees.seed)
    return trees.grow(rows, [Goal(F.col("t"), F.col("fold") != k) for k in range(n)]).add(rows, {"e": F.col("fold")}).drop("fold")


def risk_scores(df: DataFrame, trees: Trees = Trees(), folds: int = 5) -> DataFrame:
    """`df` (with split) and risk, P(y = 1 | features): out of fold on train, by the full model elsewhere."""
    train = df.filter("split = 'train'")
    require(train.select("y").distinct().count() == 2, "a risk score needs both outcomes")
    rows, n = dealt(train, folds, trees.seed)
    forest = trees.grow(rows, [*(Goal(F.col("y"), F.col("fold") != k) for k in range(n)), Goal(F.col("y"))])
    every = rows.unionByName(df.filter("split <> 'train'").withColumn("fold", F.lit(n)))
    return forest.add(every, {"risk": F.col("fold")}).drop("fold")


def natural_risk(df: DataFrame, column: str, most: int = 1000) -> Column:
    """The same as a column, for at most `most` categories."""
    if dict(df.dtypes)[column] in ("string", "boolean"):
        places = frequency_ordinal(df, column).limit(most + 1).collect()
        require(len(places) <= most, f"more than {most} categories: use with_natural_risk")
        return F.create_map(*(F.lit(x) for r in places for x in (r["value"], r["ordinal"])))[F.coalesce(F.col(column).cast("string"), F.lit("__missing__"))].cast("double")
    return F.coalesce(F.col(column).cast("double"), F.lit(percentiles(df, [column], [0.5])[column][0]))


def with_natural_risk(df: DataFrame, column: str, out: str) -> DataFrame:
    """`df` with a column as risk: numbers with gaps at their median over the rows given, else the place of the value by how often it occurs."""
    if dict(df.dtypes)[column] in ("string", "boolean"):
        places = frequency_ordinal(df, column).select(F.col("value").alias("__value"), F.col("ordinal").cast("double").alias(out))
        return df.withColumn("__value", F.coalesce(F.col(column).cast("string"), F.lit("__missing__"))).join(places, "__value").drop("__value")
    median = percentiles(df, [column], [0.5])[column][0]
    return df.withColumn(out, F.coalesce(F.col(column).cast("double"), F.lit(median)))


LEARNERS: dict[str, Callable[..., Fitted]] = {
    "constant_ate": constant_effect,
    "t_learner": t_learner,
    "x_learner": x_learner,
    "dr_learner": dr_learner,
    "q_learner": q_learner,
    "q_learner_ratio": lambda train, trees=Trees(), **more: q_learner(train, trees, ratio=True, **more),
}
