"""Checks on what covariates tell: point-biserial correlation, false discovery control, overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fisher_z, normal_tail
from .validate import require


def point_biserial(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, r, p of each column with y; constants have r = 0 and p = 1. One aggregation for all columns."""
    n = F.count(F.lit(1))
    y = F.col("y").cast("double")

    def correlation(x):
        scale = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
        return F.when(scale > 1e-12, F.covar_pop(x, y) / scale)

    pairs = [F.struct(F.lit(c).alias("name"), correlation(F.col(c).cast("double")).alias("r"), n.alias("n")) for c in columns]
    rows = df.agg(F.array(*pairs).alias("all")).select(F.inline("all"))
    r = F.coalesce(F.when(F.col("r").isNotNull() & ~F.isnan("r"), F.greatest(F.least("r", F.lit(0.999999)), F.lit(-0.999999))), F.lit(0.0))
    p = F.when(F.col("r").isNull() | F.isnan("r"), 1.0).otherwise(F.least(F.lit(1.0), 2 * normal_tail(fisher_z(F.col("r"), F.col("n")))))
    return rows.select("name", r.alias("r"), p.alias("p"))


def benjamini_hochberg(df: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """`df` (one row for each hypothesis) with rejected."""
    nth = F.row_number().over(Window.orderBy(p))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = df.withColumns({"__nth": nth, "__n": n})
    last = F.max(F.when(F.col(p) <= alpha * F.col("__nth") / F.col("__n"), F.col("__nth"))).over(Window.partitionBy())
    return ranked.withColumn("rejected", F.coalesce(F.col("__nth") <= last, F.lit(False))).drop("__nth", "__n")


def top_covariates(correlations: DataFrame, k: int = 5) -> DataFrame:
    return correlations.orderBy(F.desc(F.abs("r")), "name").limit(k)


def precondition(df: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """Raises unless some covariate tells about the outcome; returns the tests."""
    tests = benjamini_hochberg(point_biserial(df, columns), alpha=alpha)
    require(not tests.filter("rejected").isEmpty(), "no covariate is associated with the outcome")
    return tests


def spreads(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, least, most, mean, std (population) of each column: what a learner's pseudo-outcomes look like."""
    facts = [F.struct(F.lit(c).alias("name"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")) for c in columns]
    return df.agg(F.array(*facts).alias("all")).select(F.inline("all"))


def overlap(df: DataFrame, propensity: str = "e", low: float = 0.01) -> DataFrame:
    """Range and mean of cross-fitted propensities, and the share outside [low, 1 - low]."""
    e = F.col(propensity)
    return df.agg(F.min(e).alias("e_min"), F.max(e).alias("e_max"), F.avg(e).alias("e_mean"), F.avg(((e < low) | (e > 1 - low)).cast("double")).alias("outside"))
