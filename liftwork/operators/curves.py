"""Ranking curves and metrics of effect scores.

Input is long: cell keys, t, y and score. Rows of one score make one vertex, so scores are counted
first, and the cumulative counts of a cell of many scores come from a two-level prefix sum: scores are dealt by range into
parts of about BUCKET_ROWS, a window runs inside each part, and the parts' totals are summed
before it. The result does not depend on the ranges, and no cell of more than ONE_SORT scores is sorted in one task.
What is broadcast has a row for each cell (and fraction), or for each part.

Counts are written once and reread: all metrics of a cell come from one pass over its rows, and a second one over
the rows of the last score of an uplift@k.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import divide
from ..sources.scratch import discard, made, settled

COUNTS = ("nt", "nc", "yt", "yc")


def score_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each score of a cell: treated and control rows, and their outcomes."""
    t, y = F.col("t"), F.col("y")
    return df.groupBy(*keys, "score").agg(F.sum(t).alias("nt"), F.sum(1 - t).alias("nc"), F.sum(y * t).alias("yt"), F.sum(y * (1 - t)).alias("yc"))


#: Scores of a part of a large cell, and what the number of parts is a multiple of.
BUCKET_ROWS, STEP = 250_000, 4
#: Scores of a cell up to which one sort gives its sums; beyond, they fall in parts.
ONE_SORT = 250_000


def cumulative(counts: DataFrame, keys: list[str], columns: tuple[str, ...] = COUNTS, one_sort: int = ONE_SORT) -> DataFrame:
    """`counts` with c<column> for each of the columns: the sum over this and all higher scores of the cell. The number of parts grows with the scores, never the size of one."""
    spark, mark = counts.sparkSession, made()
    counts = settled(counts, "counts")
    each = counts.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    if (each[0] or 0) <= one_sort:
        inside = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
        return counts.select(*keys, "score", *columns, *(F.sum(c).over(inside).alias(f"c{c}") for c in columns))
    parts = STEP * -(-each[1] // (STEP * BUCKET_ROWS))
    placed = counts.repartitionByRange(parts, *keys, F.desc("score")).withColumn("__part", F.spark_partition_id())
    placed = settled(placed.select(*keys, "score", *columns, "__part"), "placed")
    discard(spark, mark, mark + 1)
    above = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "__part").agg(*(F.sum(c).alias(c) for c in columns))  # a row for each part and cell that meet: parts + cells at most
    totals = totals.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__p"), *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"b{c}") for c in columns))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys), F.col("__part") == F.col("__p"))
    inside = Window.partitionBy(*keys, "__part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.withColumns({f"c{c}": F.sum(c).over(inside) for c in columns}).join(F.broadcast(totals), same)
    return sums.select(*keys, "score", *columns, *((F.col(f"c{c}") + F.col(f"b{c}")).alias(f"c{c}") for c in columns))


def cumulative_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """The written cumulative counts of each score: all curves and metrics follow from them."""
    return settled(cumulative(score_counts(df, keys), keys), "cumulative")


def qini_gain(nt: Column, nc: Column, yt: Column, yc: Column) -> Column:
    """Treated outcomes minus the control outcomes scaled to as many rows; 0 while there is no control row."""
    return F.when(nc > 0, yt - yc.cast("double") * nt / nc).otherwise(F.lit(0.0))


def uplift_gain(nt: Column, nc: Column, yt: Column, yc: Column) -> Column:
    """Difference of the arms' rates times the rows; an empty arm has rate 0."""
    return (divide(yt, nt, 0.0) - divide(yc, nc, 0.0)) * (nt + nc)


def average_ranks(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score, rank (from 1, ties share their mean) and unit_rank, (rank - 1) / (n - 1), of each distinct score."""
    counts = cumulative(df.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n")), keys, ("n",))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    rank = F.col("rows") - F.col("cn") + (F.col("n") + 1) / 2
    return counts.join(F.broadcast(sizes), keys).select(*keys, "score", rank.alias("rank"), ((rank - 1) / F.greatest(F.lit(1), F.col("rows") - 1)).alias("unit_rank"))


def vertices(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score, x, qini, uplift after each score, best first, with the values before it (x0, qini0, uplift0). sums: cumulative counts."""
    now = [F.col(f"c{c}") for c in COUNTS]
    was = [F.col(f"c{c}") - F.col(c) for c in COUNTS]
    return sums.select(
        *keys, "score", (now[0] + now[1]).alias("x"), qini_gain(*now).alias("qini"), uplift_gain(*now).alias("uplift"),
        (was[0] + was[1]).alias("x0"), qini_gain(*was).alias("qini0"), uplift_gain(*was).alias("uplift0"),
    )


def curve(df: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """keys, x, gain of the Qini or uplift curve, with its origin."""
    sums = cumulative_counts(df, keys)
    points = vertices(sums, keys).select(*keys, F.col("x").cast("long").alias("x"), F.col(kind).alias("gain"))
    origin = sums.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("x"), F.lit(0.0).alias("gain"))
    return origin.unionByName(points)


def classes(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tr, tn, cr, cn: treated and control responders and non-responders; n. counts: rows with t and y, or counts of scores."""
    if "nt" not in counts.columns:
        counts = score_counts(counts.select(*keys, "t", "y", F.lit(0).alias("score")), keys)
    n = {"tr": F.col("yt"), "tn": F.col("nt") - F.col("yt"), "cr": F.col("yc"), "cn": F.col("nc") - F.col("yc"), "n": F.col("nt") + F.col("nc")}
    return counts.groupBy(*keys).agg(*(F.sum(c).cast("double").alias(k) for k, c in n.items()))


def _class_columns() -> tuple[Column, ...]:
    return tuple(F.col(c) for c in ("tr", "tn", "cr", "cn", "n"))


def endpoint() -> Column:
    """Where every Qini curve of the cell ends."""
    tr, tn, cr, cn, _ = _class_columns()
    return F.when(cr + cn > 0, tr - cr * (tr + tn) / (cr + cn)).otherwise(F.lit(0.0))


def perfect_qini_area() -> Column:
    """Area under the curve that ranks treated responders first and control responders last, from the class counts."""
    tr, tn, cr, cn, _ = _class_columns()
    middle = F.when(cn > 0, tr).otherwise(F.lit(0.0))
    return (tn + cn) * middle / 2 + cr * (middle + endpoint()) / 2


def perfect_uplift_points() -> list[tuple[Column, Column]]:
    """(x, gain) of the perfect uplift curve: treated responders, control non-responders, then the larger harm last."""
    tr, tn, cr, cn, n = _class_columns()
    more = cr > tn
    third = uplift_gain(tr + F.when(more, 0.0).otherwise(tn), cn + F.when(more, cr).otherwise(0.0), tr, F.when(more, cr).otherwise(0.0))
    zero = F.lit(0.0)
    return [(zero, zero), (tr, uplift_gain(tr, zero, tr, zero)), (tr + cn, uplift_gain(tr, cn, tr, zero)), (tr + cn + F.when(more, cr).otherwise(tn), third), (n, uplift_gain(tr + tn, cr + cn, tr, cr))]


def perfect_uplift_area() -> Column:
    points = perfect_uplift_points()
    return sum(((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:], strict=False)), F.lit(0.0))


def areas_of(sums: DataFrame, keys: list[str]) -> DataFrame:
    width = F.col("x") - F.col("x0")
    return vertices(sums, keys).groupBy(*keys).agg(F.sum(width * (F.col("qini") + F.col("qini0")) / 2).alias("qini_area"), F.sum(width * (F.col("uplift") + F.col("uplift0")) / 2).alias("uplift_area"))


def areas(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, qini_area, uplift_area by trapezoids."""
    return areas_of(cumulative_counts(df, keys), keys)


def metrics_of(sums: DataFrame, keys: list[str]) -> DataFrame:
    whole = classes(sums, keys).join(areas_of(sums, keys), keys)
    line = F.col("n") * endpoint() / 2
    flat = F.col("n") * perfect_uplift_points()[-1][1] / 2
    best_q, best_u = perfect_qini_area() - line, perfect_uplift_area() - flat
    return whole.select(
        *keys,
        F.when(F.abs(best_q) > 1e-12, (F.col("qini_area") - line) / best_q).alias("qini_auc_normalized"),
        ((F.col("qini_area") - line) / (F.col("n") * F.col("n"))).alias("qini_coefficient"),
        F.when(F.abs(best_u) > 1e-12, (F.col("uplift_area") - flat) / best_u).alias("uplift_auc_normalized"),
        (F.col("uplift_area") / (F.col("n") * F.col("n"))).alias("auuc"),
    )


def ranking_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, qini_auc_normalized, qini_coefficient, uplift_auc_normalized, auuc. Undefined values are null."""
    return metrics_of(cumulative_counts(df, keys), keys)


def top_cuts(sums: DataFrame, keys: list[str], fractions: tuple[float, ...]) -> DataFrame:
    """keys, fraction, k, cut, x: rows to take, the score of the last of them, the rows down to that score, and b<count>, the counts above it."""
    if any(not 0 < f <= 1 for f in fractions):
        raise ValueError("fraction must be in (0, 1]")
    sizes = sums.groupBy(*keys).agg(F.sum(F.col("nt") + F.col("nc")).alias("n")).withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    sizes = sizes.withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") * F.col("fraction"))))
    x, x0 = F.col("cnt") + F.col("cnc"), F.col("cnt") + F.col("cnc") - F.col("nt") - F.col("nc")
    reached = sums.join(F.broadcast(sizes), keys).filter((x >= F.col("k")) & (x0 < F.col("k")))
    return reached.select(*keys, "fraction", "k", F.col("score").alias("cut"), x.alias("x"), *((F.col(f"c{c}") - F.col(c)).alias(f"b{c}") for c in COUNTS), *COUNTS)


def top_of(rows: DataFrame | Callable[[Callable[[DataFrame], DataFrame]], DataFrame], sums: DataFrame, keys: list[str], fractions: tuple[float, ...], ident: str, weight: Column | None = None, counted: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """keys, fraction, uplift. rows: keys, ident, t, y, score, each counted `weight` times (once), or what gives them after a filter; sums: their cumulative counts, or what `top_cuts` makes of them.
    counted: another way from those rows and the cuts through a score to keys, fraction, the counts of the last row and the cumulative ones.

    Above the last score the cumulative counts are enough. The last score's rows are counted in ascending id, by the same
    prefix sums, unless all of them are taken.
    """
    found = sums if "cut" in sums.columns else settled(top_cuts(sums, keys, fractions), "cuts")  # one row for each cell and fraction
    whole = found.filter("x = k").select(*keys, "fraction", *((F.col(f"b{c}") + F.col(c)).alias(c) for c in COUNTS))
    if found.filter("x > k").isEmpty():  # no score is cut in two
        return whole.select(*keys, "fraction", (divide(F.col("yt"), F.col("nt")) - divide(F.col("yc"), F.col("nc"))).alias("uplift"))
    part = found.filter("x > k").select(*keys, "fraction", "cut", (F.col("k") - F.col("bnt") - F.col("bnc")).alias("more"), *(f"b{c}" for c in COUNTS))
    w = F.lit(1) if weight is None else weight
    if not isinstance(rows, DataFrame):  # only rows of a score that is cut are given weights
        rows = rows(lambda some: some.join(F.broadcast(part.select(*(c for c in keys if c in some.columns), F.col("cut").alias("score")).distinct()), [*(c for c in keys if c in some.columns), "score"], "left_semi"))
    by, x0 = [*keys, "fraction"], F.col("cnt") + F.col("cnc") - F.col("nt") - F.col("nc")
    if counted:
        each = counted(rows, part)
    else:
        t, y = F.col("t"), F.col("y")
        tied = rows.select(*keys, ident, "t", "y", "score", w.alias("w")).join(F.broadcast(part.select(*keys, "fraction", F.col("cut").alias("score"))), [*keys, "score"])
        each = tied.groupBy(*by, (-F.col(ident).cast("long")).alias("score")).agg(F.sum(F.col("w") * t).alias("nt"), F.sum(F.col("w") * (1 - t)).alias("nc"), F.sum(F.col("w") * y * t).alias("yt"), F.sum(F.col("w") * y * (1 - t)).alias("yc"))
        each = cumulative(each, by)
    last = each.join(F.broadcast(part), by).filter((F.col("cnt") + F.col("cnc") >= F.col("more")) & (x0 < F.col("more")))
    share = (F.col("more") - x0) / (F.col("nt") + F.col("nc"))  # of a row that is drawn several times
    last = last.select(*by, *((F.col(f"b{c}") + F.col(f"c{c}") - F.col(c) + F.col(c) * share).alias(c) for c in COUNTS))
    taken = whole.unionByName(last)
    return taken.select(*by, (divide(F.col("yt"), F.col("nt")) - divide(F.col("yc"), F.col("nc"))).alias("uplift"))


def uplift_at(df: DataFrame, keys: list[str], fraction: float, ident: str = "epk_id") -> DataFrame:
    """keys, uplift: rate difference among the best floor(n * fraction) rows (one at least); null where an arm is missing.

    Rows of the last score are taken by ascending id, a whole number.
    """
    return top_of(df, cumulative_counts(df, keys), keys, (fraction,), ident).drop("fraction")


def moments(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ate_observed, cate_mean, cate_std (population). counts: rows with t, y and score, or counts of scores."""
    if "nt" not in counts.columns:
        counts = settled(score_counts(counts, keys), "counts")
    n = F.col("nt") + F.col("nc")
    means = counts.groupBy(*keys).agg((divide(F.sum("yt"), F.sum("nt")) - divide(F.sum("yc"), F.sum("nc"))).alias("ate_observed"), (F.sum(F.col("score") * n) / F.sum(n)).alias("cate_mean"))
    far = F.pow(F.col("score") - F.col("cate_mean"), F.lit(2)) * n
    return counts.join(F.broadcast(means), keys).groupBy(*keys, "ate_observed", "cate_mean").agg(F.sqrt(F.sum(far) / F.sum(n)).alias("cate_std"))


def evaluate_uplift(df: DataFrame, keys: list[str], ident: str = "epk_id") -> DataFrame:
    """The nine metrics of each cell."""
    sums = cumulative_counts(df, keys)
    out = metrics_of(sums, keys)
    tops = top_of(df, sums, keys, (0.1, 0.2), ident).groupBy(*keys).agg(*(F.max(F.when(F.col("fraction") == f, F.col("uplift"))).alias(name) for name, f in (("uplift_at_10pct", 0.1), ("uplift_at_20pct", 0.2))))
    return out.join(tops, keys, "left").join(moments(sums, keys), keys)
