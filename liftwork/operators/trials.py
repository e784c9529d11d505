"""Tables of runs: seed summaries, best trials, audits, missing work, sweep matrices, reuse."""

from __future__ import annotations

import math
import random
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from .resample import AXES


def seed_summary(metrics: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """n, mean, sample std (0 for one value) and 95 % half width of each metric over seeds; NaN is dropped."""
    out = []
    for c in columns:
        good = F.when(finite(F.col(c)), F.col(c))
        n, std = F.count(good), F.coalesce(F.stddev_samp(good), F.when(F.count(good) > 0, F.lit(0.0)))
        out += [n.alias(f"{c}_n"), F.avg(good).alias(f"{c}_mean"), std.alias(f"{c}_std"), F.when(n > 0, 1.96 * std / F.sqrt(n)).alias(f"{c}_ci95")]
    return metrics.groupBy(*keys).agg(*out)


def best_trials(trials: DataFrame) -> DataFrame:
    """One trial for each model: largest objective, then uplift at 10 %, then least fit time, then number."""
    good = trials.filter("status = 'ok'").filter(finite(F.col("objective")))
    order = Window.partitionBy("model").orderBy(F.desc_nulls_last("objective"), F.desc_nulls_last("uplift_at_10pct"), F.asc_nulls_last("fit_seconds"), F.asc_nulls_last("trial"))
    return good.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def merge_trials(trials: DataFrame) -> DataFrame:
    """One row for each model and trial: those that went well first, then by the order of sources."""
    order = Window.partitionBy("model", "trial").orderBy((F.col("status") != "ok").cast("int"), "source_order")
    return trials.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def trial_audit(trials: DataFrame, target: int) -> DataFrame:
    """How many trials of each model were attempted and went well, and whether the search is complete and usable."""
    attempted, ok = F.count_distinct("trial"), F.count_distinct(F.when(F.col("status") == "ok", F.col("trial")))
    return trials.groupBy("model").agg(F.lit(target).alias("target"), attempted.alias("attempted"), ok.alias("ok"), (attempted >= target).alias("complete"), (ok > 0).alias("available"))


def missing_trials(trials: DataFrame, models: DataFrame, total: int, retry_failed: bool = True) -> DataFrame:
    """(model, trial) of 0 .. total - 1 that are not done. retry_failed: only what went well counts as done."""
    done = trials.filter("status = 'ok'") if retry_failed else trials
    wanted = models.select("model").distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    return wanted.join(done.select("model", "trial"), ["model", "trial"], "left_anti")


def sweep_matrix(spark: SparkSession, datasets: list[str], axes: list[str], seeds: list[int]) -> DataFrame:
    """dataset, axis, severity_tag, severity, seed of each cell of a sweep."""
    rows = [(d, a, AXES[a].tag(s), None if s is None else float(s), seed) for d, a, seed in product(datasets, axes, seeds) for s in AXES[a].grid]
    return spark.createDataFrame(rows, "dataset string, axis string, severity_tag string, severity double, seed int")


def variants(model: str, setting: str, values: list, default) -> list[tuple[str, dict]]:
    """(series id, settings) for each distinct value and the default, in order; the default keeps the plain id and states nothing."""
    return [(model, {}) if v == default else (f"{model}#{setting}{v}", {setting: v}) for v in sorted({default, *values})]


def unique(names: list) -> list:
    """The names in their order, each once."""
    return list(dict.fromkeys(names))


def ordered(df: DataFrame, orders: dict[str, list], *then: str) -> DataFrame:
    """`df` sorted by the places that its values have in the lists (others after them, by value), then by more columns."""
    keys = []
    for column, values in orders.items():
        keys += [F.coalesce(*(F.when(F.col(column) == v, F.lit(k)) for k, v in enumerate(values)), F.lit(len(values))), F.col(column).asc_nulls_last()]
    return df.orderBy(*keys, *(F.col(c).asc_nulls_last() for c in then))


def row_differences(a: DataFrame, b: DataFrame, ident: str = "epk_id") -> DataFrame:
    """ident, in_a, in_b of the ids that one side lacks: empty when both score the same rows."""
    left, right = a.select(ident).distinct().withColumn("in_a", F.lit(True)), b.select(ident).distinct().withColumn("in_b", F.lit(True))
    both = left.join(right, ident, "full").select(ident, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))
    return both.filter("NOT (in_a AND in_b)")


def reusable(runs: DataFrame, models: list[str], axis: str, tag: str) -> DataFrame:
    """Rows of finished runs as rows of a sweep cell, with where they are from."""
    return runs.filter(F.col("model").isin(models)).withColumns({"axis": F.lit(axis), "severity_tag": F.lit(tag), "reused_from": F.col("source")})


def compatible(have: dict, need: dict, within: float = 1e-9) -> bool:
    """Whether a run's settings meet the requirements; what a run does not state does not count against it."""
    for k, v in need.items():
        if v is None or k not in have:
            continue
        same = abs(have[k] - v) <= within if isinstance(v, float) and isinstance(have[k], int | float) else have[k] == v
        if not same:
            return False
    return True


def random_trial(space: dict, defaults: dict, seed: int, offset: int, trial: int) -> dict:
    """Settings of a trial: the defaults for trial 0, else choices and log-uniform draws that follow from the numbers."""
    if trial == 0:
        return dict(defaults)
    draw = random.Random(seed + offset + 1009 * trial)
    return {k: math.exp(draw.uniform(math.log(v[0]), math.log(v[1]))) if isinstance(v, tuple) else draw.choice(v) for k, v in space.items()}


def union(*frames: DataFrame) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("nth = 1").drop("nth")
