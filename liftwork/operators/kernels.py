"""Learners of other kinds than trees: Gaussian processes per arm, a network with two outcome heads, and nearest
neighbours as a stand-in for pretrained in-context scorers.

All learn from every training row (see `gaussian`, `network` and `neighbours`); scoring runs over the partitions of any
table. The stand-in is no pretrained model and says so in its name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..shipping import ship
from . import gaussian, network
from .boosting import Goal
from .learners import Fitted, Trees, aipw, out_of_fold, treated_share
from .neighbours import nearest_means
from .prepare import principal_axes
from .validate import check_whole, require


def _score(df: DataFrame, columns: list[str], predict: Callable[[np.ndarray], tuple[np.ndarray, ...]], names: tuple[str, ...] = ("cate",)) -> DataFrame:
    """`df` with the columns that `predict` makes of a matrix of `columns`."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(predict)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(**dict(zip(names, shared.value(part[columns].to_numpy(float)), strict=True)))

    return df.mapInPandas(run, StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in names)]))


class Effect:
    """What a fitted model makes of a matrix, after a projection."""

    def __init__(self, how: Callable, model: dict, axes: np.ndarray | None = None, *more):
        self.how, self.model, self.axes, self.more = how, model, axes, more

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        return self.how(self.model, x if self.axes is None else x @ self.axes, *self.more)


def gp_cate(train: DataFrame, columns: list[str], components: int = 20, most_control: int = 2000, most_treated: int = 500, seed: int = 0, level: float = 0.95, restarts: int = 1, inducing: int = 512) -> Fitted:
    """Adds cate with cate_low and cate_high at the level, from one Gaussian process for each arm on the first principal components.

    The caps bound the rows on which scale, length and noise are tuned, and up to which the posterior is exact.
    """
    for name, value in (("components", components), ("most_control", most_control), ("most_treated", most_treated)):
        check_whole(name, value, 1)
    require(0 < level < 1, "the level lies between 0 and 1")
    k = min(components, len(columns))
    axes = principal_axes(train, columns, k) if k < len(columns) else np.eye(len(columns))
    x = F.array(*(sum((F.col(c).cast("double") * float(axes[i, j]) for i, c in enumerate(columns)), F.lit(0.0)) for j in range(k))).alias("x")
    arms = gaussian.fit(train.select("epk_id", "t", "y", x), {0: most_control, 1: most_treated}, restarts, inducing, seed=seed)
    settings = {"components": k, "most_control": most_control, "most_treated": most_treated, "restarts": restarts, "inducing": inducing, "level": level}
    settings |= {"n_components_used": k} | {f"n_{name}_used": len(arms[a].points) for a, name in enumerate(("control", "treated"))}
    return Fitted("gp_cate", lambda df: _score(df, columns, Effect(gaussian.effect, arms, axes, level), ("cate", "cate_low", "cate_high")), settings)


def dragonnet(train: DataFrame, columns: list[str], width: int = 128, epochs: int = 100, batch: int = 512, step: float = 1e-3, decay: float = 1e-4, patience: int = 12, seed: int = 42, validation: DataFrame | None = None) -> Fitted:
    """Trained on all rows; it stops by the loss on `validation`, or on 15 % of the rows if none is given."""
    net = network.Net(width, epochs, batch, step, decay, patience, seed)
    w = network.fit(train, columns, net, validation)
    return Fitted("dragonnet", lambda df: _score(df, columns, Effect(network.effect, w)), vars(net) | {"validation_loss": float(w["loss"][0]), "epochs_used": int(w["epochs"][0])})


def neighbour_stand_in(train: DataFrame, columns: list[str], neighbours: int = 64) -> Fitted:
    """Difference of the arms' mean outcomes among the nearest of all training rows. Adds cate, mu0 and mu1; rows are known by epk_id."""
    check_whole("neighbours", neighbours, 1)
    arms = {r["t"]: r["count"] for r in train.groupBy("t").count().collect()}
    require(len(arms) == 2, "the context lacks an arm")
    k = min(neighbours, *arms.values())
    have = train.select("epk_id", "t", "y", *columns)

    def predict(df: DataFrame) -> DataFrame:
        mu0, mu1 = (F.col(f"mean_{a}_{k}") for a in (0, 1))
        return nearest_means(df, have, columns, k, "t", [k]).select(*df.columns, (mu1 - mu0).alias("cate"), mu0.alias("mu0"), mu1.alias("mu1"))

    return Fitted("neighbour_stand_in", predict, {"neighbours": k})


def stand_in_pseudo_labels(train: DataFrame, columns: list[str], folds: int = 2, low: float = 0.02, seed: int = 0) -> DataFrame:
    """`train` with the cross-fitted doubly robust pseudo-label of the stand-in, clipped to [0, 1]."""
    e = treated_share(train, low)
    crossed = out_of_fold(train, folds, seed, lambda rows: neighbour_stand_in(rows, columns).predict)
    return crossed.withColumn("label", F.greatest(F.lit(0.0), F.least(F.lit(1.0), aipw(F.col("mu0"), F.col("mu1"), F.lit(e), F.col("t"), F.col("y")))))


def x_over_stand_in(train: DataFrame, columns: list[str], folds: int = 2, seed: int = 0, trees: Trees = Trees()) -> Fitted:
    """X-learner whose outcome means come from the stand-in, out of fold, and whose effects are boosted trees on `features`."""
    g = treated_share(train, 1e-3)
    crossed = out_of_fold(train, folds, seed, lambda rows: neighbour_stand_in(rows, columns).predict)
    d = F.when(F.col("t") == 1, F.col("y") - F.col("mu0")).otherwise(F.col("mu1") - F.col("y"))
    forest = trees.grow(crossed.withColumn("__d", d), [Goal(F.col("__d"), F.col("t") == a, binary=False) for a in (0, 1)])
    return Fitted("x_over_stand_in", lambda df: forest.add(df, {"__0": 0, "__1": 1}).withColumn("cate", g * F.col("__0") + (1 - g) * F.col("__1")).drop("__0", "__1"), {"folds": folds})
