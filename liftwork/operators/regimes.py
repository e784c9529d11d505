"""Tables over a sweep: breakpoints, robustness index, influence of hyper-parameters, effect error, rank agreement."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, hparam_tag
from ..functions.statistics import student_two_sided
from ..shipping import ship
from ..sources.scratch import settled
from .bootstrap import paired
from .resample import severity_order


def severities(metrics: DataFrame) -> DataFrame:
    """axis, severity_tag, severity, first come; a few rows for each axis."""
    return metrics.filter("severity_tag IS NOT NULL").groupBy("axis", "severity_tag").agg(F.min("severity").alias("severity"))


def breakpoints(paired: DataFrame, metrics: DataFrame) -> DataFrame:
    """The first severity at which the reference is significantly worse than the best alternative."""
    rows = paired.filter("comparison = 'best_alternative'").join(severities(metrics), ["axis", "severity_tag"], "left")
    rows = rows.withColumn("place", severity_order(F.col("axis"), F.col("severity")))
    losing = F.col("excludes_zero") & (F.col("mean_difference") < 0)
    facts = F.struct("severity_tag", "severity", "mean_difference", "ci_low", "ci_high")
    first = F.min_by(F.when(losing, facts), F.when(losing, F.col("place")))
    found = rows.groupBy("dataset", "axis", "metric").agg(
        F.count(F.lit(1)).alias("n_severities"), first.alias("first"), F.min("mean_difference").alias("worst_difference"),
        F.min_by("severity_tag", F.struct("mean_difference", "place")).alias("worst_severity_tag"),
    )
    f = F.col("first")
    return found.select(
        "dataset", "axis", "metric", "n_severities", f.isNotNull().alias("breaks"), f["severity_tag"].alias("breakpoint_severity_tag"), f["severity"].alias("breakpoint_severity"),
        f["mean_difference"].alias("difference_at_breakpoint"), F.when(f.isNotNull(), F.format_string("[%.4f, %.4f]", f["ci_low"], f["ci_high"])).alias("ci_at_breakpoint"),
        "worst_difference", "worst_severity_tag",
    )


def robustness_index(found: DataFrame, metrics: DataFrame) -> DataFrame:
    """`found` (breakpoints) with its place in the axis' grid, or the grid's length where nothing breaks."""
    grid = severities(metrics).withColumn("nth", F.row_number().over(Window.partitionBy("axis").orderBy(severity_order(F.col("axis"), F.col("severity")), "severity_tag")) - 1)
    size = grid.groupBy("axis").agg(F.count(F.lit(1)).alias("size"))
    place = grid.select("axis", F.col("severity_tag").alias("breakpoint_severity_tag"), "nth")
    return found.join(place, ["axis", "breakpoint_severity_tag"], "left").join(size, "axis").withColumn("robustness_index", F.coalesce("nth", "size")).drop("nth", "size")


def variant_families(metrics: DataFrame) -> DataFrame:
    """base_model, series of bases with more than one."""
    return metrics.groupBy("base_model").agg(F.sort_array(F.collect_set("model")).alias("series")).filter(F.size("series") > 1)


def breakpoint_shift(indexed: DataFrame) -> DataFrame:
    """Each variant against its base's default. indexed: dataset, axis, base_model, hparam_tag, hparam_value, breaks, breakpoint_severity_tag, robustness_index."""
    default = indexed.filter("hparam_tag = 'default'").select("dataset", "axis", "base_model", F.col("breaks").alias("default_breaks"), F.col("breakpoint_severity_tag").alias("default_breakpoint"), F.col("robustness_index").alias("__d"))
    shift = F.col("robustness_index") - F.col("__d")
    return indexed.filter("hparam_tag <> 'default'").join(default, ["dataset", "axis", "base_model"]).select(
        "dataset", "axis", "base_model", "hparam_tag", "hparam_value", F.col("breaks").alias("variant_breaks"), F.col("breakpoint_severity_tag").alias("variant_breakpoint"), "default_breaks", "default_breakpoint",
        shift.alias("breakpoint_shift_steps"), (shift > 0).alias("more_robust_than_default"), (shift < 0).alias("more_fragile_than_default"),
    )


def hparam_values(metrics: DataFrame) -> DataFrame:
    """model, hparam_value: the first value that a run of the series states, by dataset, axis, severity and seed."""
    given = metrics.filter("model IS NOT NULL AND hparam_value IS NOT NULL")
    return given.groupBy("model").agg(F.min_by("hparam_value", F.struct("dataset", "axis", "severity_tag", "seed")).alias("hparam_value"))


def hparam_influence(draws: DataFrame, metrics: DataFrame, level: float = 0.95) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(breakpoint and robustness index of each series of a family, shifts against the defaults, verdicts).

    draws: long bootstrap draws. Every series of a base that was fitted under more than one setting is compared with
    the best model of another base, as the reference is. A base without a default series has no shift.
    """
    families = {r["base_model"]: r["series"] for r in variant_families(with_series(draws.select("model").distinct())).collect()}
    each = None
    for base, members in families.items():  # a few series for each model
        for series in members:
            found = breakpoints(paired(draws, series, level), metrics).withColumn("model", F.lit(series))
            each = found if each is None else each.unionByName(found)
    if each is None:
        raise ValueError("no model was fitted under more than one setting")
    values = hparam_values(metrics) if "hparam_value" in metrics.columns else metrics.select("model").distinct().withColumn("hparam_value", F.lit(None).cast("double"))
    indexed = robustness_index(with_series(each), metrics).join(F.broadcast(values), "model", "left").withColumn("is_default", F.col("hparam_tag") == "default")
    shifts = breakpoint_shift(indexed)
    return indexed, shifts, influence_verdict(shifts)


def regime_map(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """dataset, metric, axis, severity_tag, outcome at each severity: wins, ties or loses against the best alternative, and whether it is the breakpoint. found: breakpoints."""
    best = pairs.filter("comparison = 'best_alternative'")
    outcome = F.when(F.col("excludes_zero") & (F.col("mean_difference") > 0), "wins").when(F.col("excludes_zero"), "loses").otherwise("ties")
    at = found.select("dataset", "axis", "metric", F.col("breakpoint_severity_tag").alias("at"))
    return best.join(at, ["dataset", "axis", "metric"], "left").select("dataset", "metric", "axis", "severity_tag", outcome.alias("outcome"), "mean_difference", F.coalesce(F.col("severity_tag") == F.col("at"), F.lit(False)).alias("is_breakpoint"))


def regime_verdict(found: DataFrame) -> DataFrame:
    """dataset, metric, axes, axes_that_break, verdict over the axes."""
    n, broken = F.count(F.lit(1)), F.count_if(F.col("breaks"))
    verdict = F.when(broken == 0, "robust on all axes").when(broken == n, "breaks on all axes").otherwise(F.concat(F.lit("breaks on "), F.array_join(F.sort_array(F.collect_set(F.when(F.col("breaks"), F.col("axis")))), ", ")))
    return found.groupBy("dataset", "metric").agg(n.alias("axes"), broken.alias("axes_that_break"), verdict.alias("verdict"))


def influence_verdict(shifts: DataFrame) -> DataFrame:
    """base_model, the largest shift and what it means."""
    top = F.max(F.abs("breakpoint_shift_steps"))
    return shifts.groupBy("base_model").agg(top.alias("max_abs_shift"), F.when(top == 0, "no influence").when(top == 1, "moderate").otherwise("strong").alias("verdict"))


def effect_error(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pehe, abs_ate_error over rows whose score and true effect are finite."""
    good = scores.filter(finite(F.col("score")) & finite(F.col("tau")))
    d = F.col("score") - F.col("tau")
    return good.groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("pehe"), F.abs(F.avg("score") - F.avg("tau")).alias("abs_ate_error"))


def effect_table(metrics: DataFrame) -> DataFrame:
    """Means over seeds of the runs that went well."""
    good = metrics.filter("status = 'ok'").filter(finite(F.col("pehe")))
    return good.groupBy("dataset", "axis", "severity_tag", "model").agg(F.avg("pehe").alias("pehe_mean"), F.stddev_samp("pehe").alias("pehe_std"), F.count("pehe").alias("pehe_count"), F.avg("qini").alias("qini_mean"), F.avg("abs_ate_error").alias("abs_ate_error_mean"))


EXACT = 8


def correlation(a: str, b: str) -> Column:
    """Null where one of the two does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _average_rank(value: Column, cell: list[str]) -> Column:
    """Ranks from 1 within a cell, ties sharing their mean."""
    return F.rank().over(Window.partitionBy(*cell).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*cell, value)) - 1) / 2


def permutation_p_values(ranks: DataFrame, cell: list[str]) -> DataFrame:
    """cell, p_value: how many orders of y agree with x at least as strongly as the given one. ranks: cell, n (at most EXACT), rho, x, y.

    The orders of n values are the numbers below n!, written in the factorial number system: each digit picks one of the values left.
    """

    def pick(state: Column, left_over: Column) -> Column:
        size = F.factorial(left_over - 1)
        at = F.call_function("div", state["k"], size)
        rest = F.concat(F.slice(state["rest"], 1, at.cast("int")), F.slice(state["rest"], at.cast("int") + 2, F.col("n")))
        return F.struct(rest.alias("rest"), (state["k"] % size).alias("k"), (state["dot"] + F.get("x", F.col("n") - left_over) * F.get(state["rest"], at.cast("int"))).alias("dot"))

    orders = ranks.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.factorial("n") - 1)))
    first = F.struct(F.col("y").alias("rest"), F.col("k").alias("k"), F.lit(0.0).alias("dot"))
    dot = F.reduce(F.sequence(F.col("n"), F.lit(1), F.lit(-1)), first, pick, lambda state: state["dot"])
    middle = F.col("n") * (F.col("n") + 1.0) * (F.col("n") + 1.0) / 4
    own = lambda c: F.sqrt(F.reduce(c, F.lit(0.0), lambda a, v: a + v * v) - middle)
    rho = (dot - middle) / (own("x") * own("y"))
    return orders.groupBy(*cell).agg(F.avg((F.abs(rho) >= F.abs("rho") - 1e-12).cast("double")).alias("p_value"))


def rank_agreement(table: DataFrame) -> DataFrame:
    """Whether a low error goes with a high Qini, over the methods of each cell (three at least): exact p-values up to EXACT methods, Student t beyond."""
    ship(table.sparkSession)
    cell = ["dataset", "axis", "severity_tag"]
    rows = table.filter(finite(F.col("pehe_mean")) & finite(F.col("qini_mean"))).withColumn("better", -F.col("pehe_mean"))
    rows = rows.withColumns({"x": _average_rank(F.col("better"), cell), "y": _average_rank(F.col("qini_mean"), cell)})
    listed = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    names = lambda by: F.array_join(F.transform(listed(by, F.col("model")), lambda r: r["model"]), " > ")
    found = rows.groupBy(*cell).agg(
        F.count(F.lit(1)).cast("int").alias("n"), correlation("x", "y").alias("rho"), correlation("better", "qini_mean").alias("value_correlation"), listed(F.col("model"), F.col("x"), F.col("y")).alias("all"),
        names(F.col("pehe_mean")).alias("pehe_order"), names((-F.col("qini_mean")).alias("q")).alias("qini_order"),
    )
    found = settled(found.filter("n >= 3").select("*", F.col("all.x").alias("x"), F.col("all.y").alias("y")).drop("all"), "agreement")  # one row for each cell
    exact = permutation_p_values(found.filter((F.col("n") <= EXACT) & F.col("rho").isNotNull()), cell)

    @F.pandas_udf("double")
    def student(rho: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([0.0 if abs(r) >= 1 else student_two_sided(r * ((m - 2) / (1 - r * r)) ** 0.5, m - 2) for r, m in zip(rho, n, strict=True)], dtype=float)

    many = found.filter((F.col("n") > EXACT) & F.col("rho").isNotNull()).select(*cell, student("rho", "n").alias("p_value"))
    return found.join(exact.unionByName(many), cell, "left").select(*cell, F.col("n").alias("n_methods"), F.col("rho").alias("spearman_rho"), "p_value", "value_correlation", "pehe_order", "qini_order")


def with_series(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns({"base_model": F.split("model", "#")[0], "hparam_tag": hparam_tag(F.col("model"))})
