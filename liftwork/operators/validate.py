"""Checks as aggregates: each looks once at the data and raises on the driver, or returns the verdict as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite

MIN_EVENTS = 10


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def metric_inputs(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A row of facts on t, y and score that metrics need, for each key: n, finite and binary counts, arms."""
    y, t, s = F.col("y"), F.col("t"), F.col("score")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(finite(s.cast("double"))).alias("finite_scores"), F.count_if(y.isin(0, 1)).alias("binary_y"),
        F.count_if(t.isin(0, 1)).alias("binary_t"), F.count_distinct("t").alias("arms"), F.count_distinct("y").alias("outcomes"),
    )


def check_metric_inputs(df: DataFrame) -> None:
    x = metric_inputs(df).first()
    require(x["n"] > 0, "no rows")
    require(x["finite_scores"] == x["n"], "score holds nulls, NaN or infinities")
    require(x["binary_y"] == x["n"], "y must be 0 or 1")
    require(x["binary_t"] == x["n"], "t must be 0 or 1")
    require(x["arms"] == 2, "both arms must be present")


def check_features(df: DataFrame, columns: list[str]) -> None:
    """Numeric, finite and not empty."""
    kinds = dict(df.dtypes)
    require(bool(columns), "no feature")
    for c in columns:
        require(kinds[c] in ("float", "double", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal"), f"{c} is not numeric")
    x = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(finite(F.col(c).cast("double"))).alias(c) for c in columns)).first()
    require(x["n"] > 0, "no rows")
    for c in columns:
        require(x[c] == x["n"], f"{c} holds nulls, NaN or infinities")


def check_binary(df: DataFrame, column: str, both: bool = False) -> None:
    x = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(column).isin(0, 1)).alias("ok"), F.count_distinct(column).alias("values")).first()
    require(x["n"] > 0 and x["ok"] == x["n"], f"{column} must be 0 or 1")
    require(not both or x["values"] == 2, f"{column} must hold both 0 and 1")


def check_whole(name: str, value, least: int) -> int:
    require(isinstance(value, int) and not isinstance(value, bool) and value >= least, f"{name} must be an integer of at least {least}")
    return value


def check_range(name: str, value, low: float, high: float) -> float:
    require(not isinstance(value, bool) and low <= float(value) <= high, f"{name} must lie in [{low}, {high}]")
    return float(value)


def event_gate(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and events of each arm, and whether the cell is too thin to judge."""
    t, y = F.col("t"), F.col("y")
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(t.cast("double")).alias("treatment_rate"), F.avg(y.cast("double")).alias("outcome_rate"),
        *(F.count_if(t == a).alias(f"arm_{a}_n") for a in (0, 1)), *(F.sum(F.when(t == a, y).otherwise(0)).cast("long").alias(f"arm_{a}_events") for a in (0, 1)),
    )
    least = F.least("arm_0_events", "arm_1_events")
    both = (F.col("arm_0_n") > 0) & (F.col("arm_1_n") > 0)
    return out.withColumns({"min_events_per_arm": least, "both_arms_present": both, "degenerate": ~both | (least < MIN_EVENTS)})


def realized_severity(df: DataFrame, keys: list[str]) -> DataFrame:
    t = F.col("t").cast("double")
    return df.groupBy(*keys).agg(F.avg(t).alias("realized_treatment_rate"), F.avg(F.col("y").cast("double")).alias("realized_conversion_rate"), F.avg(1 - t).alias("realized_control_share"), F.count(F.lit(1)).alias("n_rows"))


def split_stats(df: DataFrame) -> DataFrame:
    """n, rates and events of each split and its arms."""
    return event_gate(df, ["split"]).select("split", "n", "treatment_rate", "outcome_rate", "arm_0_n", "arm_1_n", "arm_0_events", "arm_1_events")


def check_splits(df: DataFrame, all_ids: DataFrame, ident: str = "epk_id") -> list[str]:
    """Raises unless the splits are disjoint, cover all ids and hold both arms; returns warnings on thin arms."""
    require(df.groupBy(ident).count().filter("count > 1").isEmpty(), "a row is in two splits")
    require(all_ids.select(ident).join(df, ident, "left_anti").isEmpty(), "a row is in no split")
    stats = split_stats(df).collect()
    for s in stats:
        require(s["arm_0_n"] > 0 and s["arm_1_n"] > 0, f"split {s['split']} lacks an arm")
    return [f"{s['split']}: fewer than {MIN_EVENTS} events in an arm" for s in stats if min(s["arm_0_events"], s["arm_1_events"]) < MIN_EVENTS]
