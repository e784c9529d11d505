"""Semi-synthetic trials: real or Gaussian covariates, a known effect for each row, hash draws."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, sigmoid, uniform
from ..sources.scratch import settled
from .prepare import fit
from .validate import check_features, require


@dataclass(frozen=True)
class Spec:
    """Knobs of the generator."""

    base_rate: float = 0.1
    ate: float = 0.03
    heterogeneity: float = 0.5
    treatment_rate: float = 0.5
    seed: int = 0


def standardised(df: DataFrame, signals: dict[str, Column], refuse: bool = False) -> DataFrame:
    """`df` with the signals scaled to mean 0 and population deviation 1, by one aggregation; constants become 0, or raise with `refuse`."""
    df = settled(df.withColumns(signals), "signals")  # several passes follow
    facts = df.agg(*(F.avg(c).alias(f"m_{c}") for c in signals), *(F.stddev_pop(c).alias(f"s_{c}") for c in signals)).first()
    for c in signals if refuse else ():
        require((facts[f"s_{c}"] or 0) > 1e-12, "the chosen covariates do not vary; no signal can be built on them")
    return df.withColumns({c: (F.col(c) - facts[f"m_{c}"]) / facts[f"s_{c}"] if facts[f"s_{c}"] > 1e-12 else F.lit(0.0) for c in signals})


def intercept(df: DataFrame, signal: str, rate: float, rounds: int = 6, points: int = 33) -> float:
    """a such that the mean of sigmoid(a + signal) is `rate`: each aggregation tries a whole grid of values."""
    require(0 < rate < 1, "a rate lies between 0 and 1")
    low, high = -30.0, 30.0
    for _ in range(rounds):
        grid = [low + (high - low) * k / (points - 1) for k in range(points)]
        means = df.agg(*(F.avg(sigmoid(F.lit(a) + F.col(signal))).alias(f"g{k}") for k, a in enumerate(grid))).first()
        k = max((i for i in range(points) if means[i] <= rate), default=0)
        low, high = grid[k], grid[min(k + 1, points - 1)]
    return (low + high) / 2


def encoded(df: DataFrame, numeric: list[str], categorical: list[str]) -> tuple[DataFrame, list[str]]:
    """(`df` with the imputed, scaled and one-hot encoded columns beside its own, their names): what surfaces are built on."""
    fitted = fit(df, numeric, categorical)
    columns = fitted.columns()
    names = [f"__x{i}" for i in range(len(columns))]
    out = settled(df.select("*", *(c.cast("double").alias(n) for c, n in zip(columns, names, strict=True))), "encoded")
    check_features(out, names)
    return out, names


def sparse_index(names: list[str], most: int, salt: str) -> Column:
    """A random direction over at most `most` of the columns."""
    draw = random.Random(salt)
    chosen = draw.sample(names, min(max(1, most), len(names)))
    return sum((F.col(c) * draw.gauss(0, 1) for c in chosen), F.lit(0.0))


def generate(df: DataFrame, columns: list[str], spec: Spec = Spec(), ident: str = "epk_id", categorical: list[str] | None = None, n_signal: int | None = None) -> DataFrame:
    """`df` with t, y and tau, the exact effect on the outcome's probability.

    The two surfaces are directions over the columns as they stand; with `n_signal` (and categorical columns, if any) they
    are sparse directions over the encoded columns, at most n_signal of them each, and one without spread is refused.
    """
    names = df.columns

    def direction(name: str) -> list[float]:
        draw = random.Random(f"{spec.seed}/{name}")
        v = [draw.gauss(0, 1) for _ in columns]
        size = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / size for x in v]

    def project(name: str) -> Column:
        return sum((F.col(c) * w for c, w in zip(columns, direction(name), strict=True)), F.lit(0.0))

    if n_signal is None and not categorical:
        df = standardised(df, {"__z0": project("base"), "__z1": project("effect")})
    else:
        df, inputs = encoded(df, columns, categorical or [])
        df = standardised(df, {f"__z{i}": sparse_index(inputs, n_signal or 5, f"{spec.seed}/{name}") for i, name in enumerate(("base", "effect"))}, refuse=True).drop(*inputs)
    a = intercept(df, "__z0", spec.base_rate)
    p0 = clip(sigmoid(F.lit(a) + F.col("__z0")), 1e-3, 1 - 1e-3)
    p1 = clip(p0 + spec.ate * (1 + spec.heterogeneity * F.tanh("__z1")), 1e-3, 1 - 1e-3)
    t = (uniform(ident, f"T{spec.seed}") < spec.treatment_rate).cast("int")
    y = (uniform(ident, f"Y{spec.seed}") < F.when(F.col("t") == 1, F.col("__p1")).otherwise(F.col("__p0"))).cast("int")
    return df.withColumns({"__p0": p0, "__p1": p1, "t": t}).withColumns({"y": y, "tau": F.col("__p1") - F.col("__p0")}).select(*names, *(c for c in ("t", "y", "tau") if c not in names))
