"""Paired bootstrap by count weights.

A draw with replacement is how often each row occurs, so a draw needs only the rows' weights: the same for all models,
which keeps comparisons paired. Weighted score counts then go through the curve operators as they are.

Weights come in two kinds. `hash`: the n picks of a draw are hash uniforms over the row numbers, counted by (draw, row),
which SQL can repeat. `split`: a draw's n picks are split over a binary tree of blocks of rows, a binomial number to each
left half, and spread evenly over the rows of a block, which is the same multinomial. The split of a node follows from seed,
node and draws alone, so every task walks from the root to its own blocks and weighs its own rows: what is
shuffled is the rows, once for each `DRAWS` draws, and no picks. Metrics of split weights are summed for all draws
of a row at once (see `weighted`), those of hash weights from a row for each draw.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from ..functions.columns import finite, uniform
from ..shipping import ship
from ..sources.scratch import settled
from .curves import COUNTS, cumulative, evaluate_uplift, qini_gain, top_of, uplift_gain
from .splits import in_order, numbered
from .validate import check_whole, require
from .weighted import places, swept, weighed


#: Picks that are counted in one task: their counts stay in memory.
PART = 2_000_000


def draw_weights(spark, n: int, draws: int, seed: int) -> DataFrame:
    """b, idx, w: how often row idx is in draw b. Picks are dealt by idx, which the join with the rows needs too, over so many parts as keep one at about `PART` picks."""
    pick = F.floor(uniform(F.col("id"), f"boot{seed}") * n).cast("long")
    picks = spark.range(n * draws).select(F.floor(F.col("id") / n).cast("int").alias("b"), pick.alias("idx"))
    return picks.repartition(max(1, -(-n * draws // PART)), "idx").groupBy("b", "idx").agg(F.count(F.lit(1)).alias("w"))


CHUNK = 100_000


def weights_of_cells(sizes: DataFrame, cell: list[str], draws: int, seed: int) -> DataFrame:
    """cell, b, idx, w for all cells at once, the same as `draw_weights` gives each. sizes: cell, n. Picks are made where chunks of their numbers are dealt to."""
    n = F.col("n")
    last = (n * draws).cast("long") - 1
    chunks = sizes.select(*cell, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / CHUNK).cast("long"))).alias("chunk"))
    first = F.col("chunk") * CHUNK
    picks = chunks.repartition(*cell, "chunk").select(*cell, "n", F.explode(F.sequence(first, F.least(first + CHUNK - 1, last))).alias("id"))
    pick = F.floor(uniform(F.col("id"), f"boot{seed}") * n).cast("long")
    return picks.select(*cell, F.floor(F.col("id") / n).cast("int").alias("b"), pick.alias("idx")).groupBy(*cell, "b", "idx").agg(F.count(F.lit(1)).alias("w"))


BLOCK, DRAWS = 256, 256  # rows of a leaf of the tree; draws that are split together


def block_weights(n: int, block: int, draws: int, seed: int, chunk: int = 0) -> np.ndarray:
    """How often each row of a block (BLOCK rows, fewer in the last) of n is in each of the `draws` draws of a chunk."""
    low, high, left = 0, -(-n // BLOCK), np.full(draws, n)
    while high - low > 1:
        middle = (low + high) // 2
        first = np.random.default_rng([seed, chunk, low, high]).binomial(left, (middle - low) * BLOCK / (min(high * BLOCK, n) - low * BLOCK))
        low, high, left = (low, middle, first) if block < middle else (middle, high, left - first)
    rows = min(BLOCK, n - low * BLOCK)
    return np.random.default_rng([seed, chunk, low, high]).multinomial(left, np.full(rows, 1 / rows))


def with_split_weights(placed: DataFrame, n: Column, draws: int, seed: int, cell: list[str] | None = None) -> DataFrame:
    """The rows of `placed` (idx from 0 to n - 1 in their cell, several rows to an idx if need be) once for each draw b that they are in, with w, how often."""
    check_whole("draws", draws, 1)
    check_whole("seed", seed, 0)
    ship(placed.sparkSession)

    def weigh(table: pa.Table) -> pa.Table:
        chunk, block, size = (table[c][0].as_py() for c in ("__chunk", "__block", "__n"))
        w = block_weights(size, block, min(DRAWS, draws - chunk * DRAWS), seed, chunk)[:, table["idx"].to_numpy() - block * BLOCK]
        b, row = np.nonzero(w)
        rows = table.drop(["__n", "__block", "__chunk"]).take(pa.array(row))
        return rows.append_column("b", pa.array((b + chunk * DRAWS).astype(np.int32))).append_column("w", pa.array(w[b, row]))

    chunks = F.explode(F.sequence(F.lit(0), F.lit(-(-draws // DRAWS) - 1)))
    ready = placed.withColumns({"__n": n.cast("long"), "__block": F.floor(F.col("idx") / BLOCK)}).withColumn("__chunk", chunks)
    schema = StructType([f for f in placed.schema.fields if f.name != "__n"]).add("b", IntegerType()).add("w", LongType())
    return ready.groupBy(*(cell or []), "__block", "__chunk").applyInArrow(weigh, schema)


def placed_in_cells(rows: DataFrame, cell: list[str], ident: str) -> tuple[DataFrame, DataFrame]:
    """(`rows` with idx, the place of their id in the cell from 0; cell, n ids)."""
    ids = in_order(rows.select(*cell, ident).distinct().orderBy(*cell, ident), "__nth")
    sizes = settled(ids.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.min("__nth").alias("__first")), "sizes")
    same = reduce(lambda a, b: a & b, (F.col(f"__{c}").eqNullSafe(F.col(c)) for c in cell))
    renamed = sizes.select(*(F.col(c).alias(f"__{c}") for c in cell), "__first")
    ids = ids.join(renamed, same).select(*cell, ident, (F.col("__nth") - F.col("__first")).alias("idx"))
    ids = settled(ids.select(*(F.col(c).alias(f"__{c}") for c in cell), F.col(ident).alias("__id"), "idx"), "ids")
    placed = settled(rows.join(ids, same & (F.col(ident) == F.col("__id"))).drop("__id", *(f"__{c}" for c in cell)), "rows")
    return placed, sizes.drop("__first")


TOPS = {"uplift_at_10pct": 0.1, "uplift_at_20pct": 0.2}


def _weights(rows: DataFrame, draws: int, seed: int, ident: str, cell: list[str] | None, picks: str) -> Callable[[Callable[[DataFrame], DataFrame] | None], DataFrame]:
    """What gives the rows, or those that a filter leaves of them, once for each draw b that they are in, with w."""
    require(picks in ("hash", "split"), "picks are hash or split")
    spark = rows.sparkSession
    if cell:
        placed, sizes = placed_in_cells(rows, cell, ident)
    else:
        ids = settled(numbered(rows.select(ident).distinct(), ident), "ids")
        placed, n = settled(rows.join(ids, ident), "rows"), ids.count()

    def weigh(keep: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
        some = keep(placed) if keep else placed
        if cell:
            return weights_of_cells(sizes, cell, draws, seed).join(some, [*cell, "idx"]) if picks == "hash" else with_split_weights(some.join(sizes, cell).withColumnRenamed("n", "__n"), F.col("__n"), draws, seed, cell)
        return draw_weights(spark, n, draws, seed).join(some, "idx") if picks == "hash" else with_split_weights(some, F.lit(n), draws, seed)

    return weigh


def _hash_sums(rows: DataFrame, keys: list[str], draws: int, seed: int, ident: str, cell: list[str] | None, picks: str) -> tuple[Callable, DataFrame, DataFrame]:
    """(what gives weighted rows, cumulative counts of each score and draw, the areas and counts of each draw), from a row for each draw."""
    weighted_of = _weights(rows, draws, seed, ident, cell, picks)
    weighted = weighted_of(None)
    w, t, y = F.col("w"), F.col("t"), F.col("y")
    by = [*keys, "b"]
    counts = weighted.groupBy(*by, "score").agg(F.sum(w * t).alias("nt"), F.sum(w * (1 - t)).alias("nc"), F.sum(w * t * y).alias("yt"), F.sum(w * (1 - t) * y).alias("yc"))
    totals = settled(cumulative(counts, by), "cumulative")
    now = [F.col(f"c{c}") for c in COUNTS]
    was = [F.col(f"c{c}") - F.col(c) for c in COUNTS]
    width = F.col("nt") + F.col("nc")
    sums = totals.groupBy(*by).agg(
        F.sum(width * (qini_gain(*now) + qini_gain(*was)) / 2).alias("qini_area"), F.sum(width * (uplift_gain(*now) + uplift_gain(*was)) / 2).alias("uplift_area"),
        *(F.sum(c).cast("double").alias(c) for c in COUNTS),
    )
    return weighted_of, totals, sums


def _split_sums(rows: DataFrame, keys: list[str], draws: int, seed: int, ident: str, cell: list[str], fractions: tuple[float, ...]) -> tuple[Callable, DataFrame, DataFrame, Callable]:
    """(what gives rows with their weights in all draws, the score where each fraction ends, the areas and counts of each draw, how rows of such a score are counted)."""
    check_whole("draws", draws, 1)
    check_whole("seed", seed, 0)
    placed = settled(places(rows.select(*keys, ident, "t", "y", "score"), cell, ident), "rows")
    by = [*keys, "b"]
    found = swept(weighed(placed, keys, ["score"], draws, seed), keys, "score", draws, fractions)
    sums = found.filter("fraction IS NULL").groupBy(*by).agg(F.sum("qini_area").alias("qini_area"), F.sum("uplift_area").alias("uplift_area"), *(F.sum(c).cast("double").alias(c) for c in COUNTS))
    above = [F.col(f"b{c}") for c in COUNTS]
    cuts = found.filter("fraction IS NOT NULL").select(*by, "fraction", "k", "cut", (above[0] + above[1] + F.col("nt") + F.col("nc")).alias("x"), *above, *COUNTS)

    def weighted_of(keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return weighed(keep(placed).withColumn("__down", -F.col(ident).cast("long")), keys, ["score", "__down"], draws, seed)

    def counted(tied: DataFrame, part: DataFrame) -> DataFrame:
        asked = part.select(*keys, F.col("cut").alias("score"), "b", "fraction", "more")
        last = swept(tied, [*keys, "score"], "__down", draws, fractions, asked).filter("fraction IS NOT NULL")
        return last.select(*by, "fraction", *COUNTS, *((F.col(f"b{c}") + F.col(c)).alias(f"c{c}") for c in COUNTS))

    return weighted_of, cuts, sums, counted


def metric_draws(rows: DataFrame, keys: list[str], draws: int, seed: int, ident: str = "epk_id", tops: bool = False, cell: list[str] | None = None, picks: str = "hash") -> DataFrame:
    """keys, b, qini_auc_normalized, qini_coefficient, auuc, ate, and with `tops` uplift_at_10pct and uplift_at_20pct, of each draw that holds both arms.

    rows: keys (cell and model), ident, t, y, score, the same rows for each model. In an uplift@k a row counts as often as it was
    drawn; rows of the last score are taken by ascending id. cell: those of the keys whose values have rows of their own, all
    drawn in one plan; by default all rows are one cell. picks: the kind of weights, hash or split.
    """
    by = [*keys, "b"]
    if picks == "split":
        weighted_of, totals, sums, counted = _split_sums(rows, keys, draws, seed, ident, cell or [], tuple(TOPS.values()) if tops else ())
    else:
        weighted_of, totals, sums = _hash_sums(rows, keys, draws, seed, ident, cell, picks)
        counted = None
    n = F.col("nt") + F.col("nc")
    end = F.col("yt") - F.col("yc") * F.col("nt") / F.col("nc")
    line = n * end / 2
    middle = F.when(F.col("nc") > F.col("yc"), F.col("yt")).otherwise(F.lit(0.0))
    best = (F.col("nt") - F.col("yt") + F.col("nc") - F.col("yc")) * middle / 2 + F.col("yc") * (middle + end) / 2 - line
    out = sums.filter("nt > 0 AND nc > 0").select(
        *by, F.when(F.abs(best) > 1e-12, (F.col("qini_area") - line) / best).alias("qini_auc_normalized"), ((F.col("qini_area") - line) / (n * n)).alias("qini_coefficient"),
        (F.col("uplift_area") / (n * n)).alias("auuc"), (F.col("yt") / F.col("nt") - F.col("yc") / F.col("nc")).alias("ate"),
    )
    if not tops:
        return out
    top = top_of(weighted_of, totals, by, tuple(TOPS.values()), ident, F.col("w"), counted).groupBy(*by).agg(*(F.max(F.when(F.col("fraction") == f, F.col("uplift"))).alias(name) for name, f in TOPS.items()))
    return out.join(top, by, "left")


def ate_draws(rows: DataFrame, keys: list[str], draws: int, seed: int, ident: str = "epk_id", cell: list[str] | None = None, picks: str = "hash") -> DataFrame:
    """keys, b, ate, the same as in `metric_draws`: from counts of the arms alone, without a score ranked."""
    w, t, y = F.col("w"), F.col("t"), F.col("y")
    n = {"nt": t, "nc": 1 - t, "yt": t * y, "yc": (1 - t) * y}
    sums = _weights(rows, draws, seed, ident, cell, picks)(None).groupBy(*keys, "b").agg(*(F.sum(w * v).cast("double").alias(c) for c, v in n.items()))
    return sums.filter("nt > 0 AND nc > 0").select(*keys, "b", (F.col("yt") / F.col("nt") - F.col("yc") / F.col("nc")).alias("ate"))


METRICS = ("qini_auc_normalized", "qini_coefficient", "auuc", "ate", *TOPS)


def long_draws(drawn: DataFrame, keys: list[str]) -> DataFrame:
    """keys, b, metric, value."""
    names = [m for m in METRICS if m in drawn.columns]
    return drawn.select(*keys, "b", F.explode(F.create_map(*(x for m in names for x in (F.lit(m), F.col(m))))).alias("metric", "value"))


def draw_table(rows: DataFrame, keys: list[str], draws: int, seed: int, level: float = 0.95, ident: str = "epk_id", cell: list[str] | None = None, picks: str = "hash") -> DataFrame:
    """keys, metric, point_estimate, n_rows, ci_low, ci_high, n_draws, n_failed_resamples: the metrics of the rows themselves beside those of the draws.

    A draw fails for a metric that it leaves undefined, or if it lacks an arm.
    """
    seen = evaluate_uplift(rows, keys, ident).withColumnRenamed("ate_observed", "ate")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    points = seen.select(*keys, F.explode(F.create_map(*(x for m in METRICS for x in (F.lit(m), F.col(m))))).alias("metric", "point_estimate"))
    drawn = long_draws(metric_draws(rows, keys, draws, seed, ident, True, cell, picks), keys).groupBy(*keys, "metric").agg(*interval(F.col("value"), level))
    out = points.join(sizes, keys).join(drawn, [*keys, "metric"], "left").withColumn("n_draws", F.coalesce("n_draws", F.lit(0)))
    return out.withColumn("n_failed_resamples", F.lit(draws) - F.col("n_draws"))


def interval(value: Column, level: float = 0.95) -> list[Column]:
    """ci_low, ci_high (linear interpolation, finite values only) and n_draws."""
    good = F.when(finite(value), value)
    return [F.percentile(good, (1 - level) / 2).alias("ci_low"), F.percentile(good, (1 + level) / 2).alias("ci_high"), F.count(good).alias("n_draws")]


CELL = ["dataset", "axis", "severity_tag"]


def pooled(draws: DataFrame, level: float = 0.95) -> DataFrame:
    """Mean and interval over all seeds' draws. draws: CELL, seed, model, metric, b, value."""
    good = F.when(finite(F.col("value")), F.col("value"))
    return draws.groupBy(*CELL, "model", "metric").agg(F.count_distinct("seed").alias("n_seeds"), F.avg(good).alias("mean"), *interval(F.col("value"), level))


def best_alternative(means: DataFrame, reference: str) -> DataFrame:
    """CELL, metric, best: the model of another base with the largest pooled mean (the least name of equals)."""
    other = means.filter((F.col("model") != reference) & (F.split("model", "#")[0] != reference.split("#")[0]) & F.col("mean").isNotNull())
    first = Window.partitionBy(*CELL, "metric").orderBy(F.desc("mean"), "model")
    return other.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select(*CELL, "metric", F.col("model").alias("best"))


def paired(draws: DataFrame, reference: str, level: float = 0.95) -> DataFrame:
    """Differences reference - other, paired by seed and draw, pooled; the best alternative comes a second time under that name."""
    key = [*CELL, "seed", "metric", "b"]
    ref = draws.filter(F.col("model") == reference).select(*key, F.col("value").alias("ref"))
    other = draws.filter(F.split("model", "#")[0] != reference.split("#")[0])
    diff = other.join(ref, key).select(*CELL, "metric", "model", (F.col("ref") - F.col("value")).alias("d"))
    good = F.when(finite(F.col("d")), F.col("d"))
    each = diff.groupBy(*CELL, "metric", "model").agg(F.avg(good).alias("mean_difference"), *interval(F.col("d"), level))
    named = each.withColumn("comparison", F.col("model"))
    top = each.join(best_alternative(pooled(draws, level), reference), [*CELL, "metric"]).filter(F.col("model") == F.col("best")).drop("best").withColumn("comparison", F.lit("best_alternative"))
    excludes = F.coalesce((F.col("ci_low") > 0) | (F.col("ci_high") < 0), F.lit(False))
    return named.unionByName(top).select(*CELL, "metric", F.lit(reference).alias("reference"), "comparison", F.col("model").alias("comparison_model"), "mean_difference", "ci_low", "ci_high", "n_draws", excludes.alias("excludes_zero"))


def aligned(scores: DataFrame, ident: str = "epk_id", cell: list[str] | None = None) -> DataFrame:
    """Ids (of a cell) that some model lacks, or has more than once; empty when all models score the same rows."""
    by = cell or []
    models = scores.groupBy(*by).agg(F.count_distinct("model").alias("models"))
    each = scores.groupBy(*by, ident).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("model").alias("m"))
    wrong = (F.col("m") != F.col("models")) | (F.col("n") != F.col("models"))
    if not by:
        return each.join(F.broadcast(models), wrong).select(ident)
    return each.join(models, by).filter(wrong).select(*by, ident)
