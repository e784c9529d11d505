"""Exact order statistics by narrowing brackets, for all columns and ranks at once.

A bracket is a column's range of values that holds a wanted rank. Each round is one aggregation: the rows of the brackets
are counted in cells (equal shares of the range; of its logarithm where it spans many powers of two; its sign first) with
the least and the greatest value of each, and the cells with a wanted rank are the next brackets. It ends when a
bracket is one value, or when so few rows are left that their distinct values are counted as they are. A cell holds four
numbers whatever the rows, a round at most `CELLS` cells in all (or 16 for each bracket), and a bracket loses at least
its lowest or highest value in a round, as a rule all but a share of a cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS, MOST_CELLS, WIDE = 1 << 17, 4096, 1 << 20


def clean(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _kind(low: float, high: float) -> str:
    if math.isinf(low) or math.isinf(high):
        return "end"
    if low < 0 <= high or low == 0:
        return "sign"
    small, large = sorted((abs(low), abs(high)))
    return "log" if large / small > WIDE else "line"


def _cell() -> Column:
    """The cell of x in its bracket; never falls as x grows."""
    x, low, high, k, kind = (F.col(c) for c in ("x", "low", "high", "k", "kind"))
    line = F.floor((x - low) / (high - low) * k)
    a, b, here = F.log(F.abs(low)), F.log(F.abs(high)), F.log(F.abs(x))
    log = F.floor(F.abs(here - a) / F.abs(b - a) * k)
    end = F.when(x == -math.inf, 0).when(x == math.inf, 2).otherwise(1)
    cell = F.when(kind == "line", line).when(kind == "log", log).when(kind == "sign", F.signum(x) + 1).otherwise(end)
    return F.least(cell.cast("int"), k - 1)


def sizes(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, float, float]]:
    """Values of each column (missing ones left out), the least and the greatest."""
    r = df.agg(*(f(clean(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("n", F.count), ("a", F.min), ("b", F.max)))).first()
    return {c: (r[f"n{i}"], r[f"a{i}"], r[f"b{i}"]) for i, c in enumerate(columns)}


def order_statistics(df: DataFrame, ranks: dict[str, set[int]], known: dict[str, tuple[int, float, float]] | None = None, few: int = CELLS) -> dict[tuple[str, int], float]:
    """The values of the wanted ranks (from 1) of each column; ranks beyond the column's values have none. few: rows to count by value."""
    columns = list(ranks)
    known = known or sizes(df, columns)
    rows = df.select(F.posexplode(F.array(*(clean(c) for c in columns))).alias("b", "x")).filter("x IS NOT NULL")
    found: dict[tuple[str, int], float] = {}
    live = {}  # bracket -> column, rows before it, rows in it, least, greatest, ranks in it
    for i, c in enumerate(columns):
        n, low, high = known[c]
        live[i] = c, 0, n, low, high, sorted(r for r in ranks[c] if 1 <= r <= n)

    def settle(bracket: tuple) -> bool:
        c, _, _, low, high, wanted = bracket
        if wanted and low == high:
            found.update({(c, r): low for r in wanted})
        return not wanted or low == high

    live = {i: b for i, b in live.items() if not settle(b)}
    spark = df.sparkSession
    rows = rows.filter(F.col("b").isin(list(live))) if live else rows
    while live:
        last = sum(b[2] for b in live.values()) <= few
        if last:
            cells = rows.groupBy("b", "x").agg(F.count(F.lit(1)).alias("n")).select("b", F.col("x").alias("cell"), "n", F.col("x").alias("low"), F.col("x").alias("high"))
        else:
            k = max(16, min(MOST_CELLS, CELLS // len(live)))
            shape = [(i, b[3], b[4], kind, k if kind in ("line", "log") else 3) for i, b in live.items() for kind in [_kind(b[3], b[4])]]
            rows = rows.join(F.broadcast(spark.createDataFrame(shape, "b int, low double, high double, kind string, k int")), "b").select("b", "x", _cell().alias("cell"))
            cells = rows.groupBy("b", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        counts: dict[int, list] = {}
        for r in cells.collect():  # at most CELLS rows
            counts.setdefault(r["b"], []).append((r["cell"], r["n"], r["low"], r["high"]))
        following, path = {}, []
        for i, (c, before, _, _, _, wanted) in live.items():
            for cell, n, low, high in sorted(counts[i]):
                inside = [r for r in wanted if before < r <= before + n]
                bracket = c, before, n, low, high, inside
                if not settle(bracket):
                    path.append((i, cell, len(following)))
                    following[len(following)] = bracket
                before += n
        live = following
        if live:
            rows = rows.join(F.broadcast(spark.createDataFrame(path, "b int, cell int, next int")), ["b", "cell"]).select(F.col("next").alias("b"), "x")
    return found


def percentiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], few: int = CELLS) -> dict[str, list[float | None]]:
    """The percentiles of each column, between ranks by a straight line; None where a column has no value."""
    known = sizes(df, columns)
    places = {c: [p * (known[c][0] - 1) for p in shares] for c in columns}
    got = order_statistics(df, {c: {1 + f(at) for at in places[c] for f in (math.floor, math.ceil)} for c in columns if known[c][0]}, known, few)

    def value(c: str, at: float) -> float | None:
        if not known[c][0]:
            return None
        below, above = math.floor(at), math.ceil(at)
        low, high = got[c, below + 1], got[c, above + 1]
        return low if low == high else (above - at) * low + (at - below) * high

    return {c: [value(c, at) for at in places[c]] for c in columns}


def cut_points(df: DataFrame, columns: Sequence[str], bins: int) -> list[list[float]]:
    """For each column the values, each once and without the greatest, at the ranks that part it in `bins` equal shares."""
    known = sizes(df, columns)
    ranks = {c: {-(-i * known[c][0] // bins) for i in range(1, bins)} for c in columns}
    found = order_statistics(df, ranks, known)
    return [sorted({v for (name, _), v in found.items() if name == c and v < known[c][2]}) for c in columns]
