"""Row caps, splits and folds by hash order: the same rows whatever the partitioning.

Ranks need no sort of a stratum. Rows fall in BUCKETS by their hash uniform, the buckets are counted, and only the
buckets that hold a wanted rank are looked into; what comes out is a cut (uniform, id) for each stratum, and the rows are
split by a comparison with it, where they stand. Folds, which need every rank, are numbered inside a bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import stratum, uniform
from ..sources.scratch import settled
from .validate import require

SPLITS = ("train", "validation", "test")
BUCKETS = 4096
#: Rows of a bucket that are sorted; larger buckets are counted again by buckets of their own.
LOOK_INTO = 100_000
Cut = tuple[float, object]


def _bucket(u: Column) -> Column:
    return F.floor(u * BUCKETS).cast("int")


def _same(by: list[str], key: tuple) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, key, strict=True)), F.lit(True))


def bucket_counts(df: DataFrame, u: Column, by: list[str]) -> dict[tuple, list[tuple[int, int]]]:
    """(bucket, rows) of each stratum, in order: BUCKETS numbers for each at most."""
    out: dict[tuple, list[tuple[int, int]]] = {}
    for r in df.groupBy(*by, _bucket(u).alias("bucket")).count().collect():
        out.setdefault(tuple(r[c] for c in by), []).append((r["bucket"], r["count"]))
    return {k: sorted(v) for k, v in out.items()}


def _holding(counts: dict[tuple, list[tuple[int, int]]], ranks: dict[tuple, list[int]]) -> tuple[dict[tuple, list[tuple[int, int]]], dict[tuple, int]]:
    """((stratum, bucket) -> (rank, rank inside), rows of those buckets) for the buckets that hold a rank."""
    wanted: dict[tuple, list[tuple[int, int]]] = {}
    sizes: dict[tuple, int] = {}
    for key, many in ranks.items():
        for rank in set(many):
            below = 0
            for bucket, n in counts.get(key, []):
                if below < rank <= below + n:
                    wanted.setdefault((*key, bucket), []).append((rank, rank - below))
                    sizes[(*key, bucket)] = n
                    break
                below += n
    return wanted, sizes


def cuts(df: DataFrame, u: Column, ident: str, by: list[str], counts: dict[tuple, list[tuple[int, int]]], ranks: dict[tuple, list[int]]) -> dict[tuple[tuple, int], Cut]:
    """(uniform, id) of the rows with the wanted ranks (from 1) in each stratum; ranks beyond its rows have none."""
    wanted, sizes = _holding(counts, ranks)
    if not wanted:
        return {}
    bucket, scale = _bucket(u), BUCKETS
    while max(sizes.values()) > LOOK_INTO and scale < BUCKETS**3:  # a bucket is counted again by its own buckets
        here = reduce(lambda a, b: a | b, (_same(by, k[:-1]) & (bucket == k[-1]) for k in wanted))
        scale, before = scale * BUCKETS, wanted
        bucket = F.floor(u * scale).cast("long")
        inner: dict[tuple, list[tuple[int, int]]] = {}
        for r in df.filter(here).groupBy(*by, bucket.alias("bucket")).count().collect():  # BUCKETS for each wanted rank
            inner.setdefault((*(r[c] for c in by), r["bucket"] // BUCKETS), []).append((r["bucket"], r["count"]))
        finer, sizes = _holding({k: sorted(v) for k, v in inner.items()}, {k: [n for _, n in v] for k, v in before.items()})
        outer = {k: dict((n, rank) for rank, n in v) for k, v in before.items()}
        wanted = {(*k[:-2], k[-1]): [(outer[k[:-1]][n], inside) for n, inside in v] for k, v in finer.items()}
        sizes = {(*k[:-2], k[-1]): n for k, n in sizes.items()}
    here = {k: _same([*by, "bucket"], k) for k in wanted}
    rows = df.select(*by, F.col(ident).alias("id"), u.alias("u"), bucket.alias("bucket")).filter(reduce(lambda a, b: a | b, here.values()))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("u", "id")))
    hit = reduce(lambda a, b: a | b, (here[k] & F.col("nth").isin([n for _, n in v]) for k, v in wanted.items()))
    out = {}
    for r in ranked.filter(hit).collect():  # one row for each rank
        key = tuple(r[c] for c in by)
        out |= {(key, rank): (r["u"], r["id"]) for rank, n in wanted[(*key, r["bucket"])] if n == r["nth"]}
    return out


def upto(u: Column, ident: str, cut: Cut) -> Column:
    """Whether a row ranks at the cut or before."""
    return (u < cut[0]) | ((u == cut[0]) & (F.col(ident) <= F.lit(cut[1])))


def exact_cap(df: DataFrame, n: int | None, salt: str, ident: str = "epk_id") -> DataFrame:
    """The n rows of least hash, all of them for 0 or None."""
    if not n:
        return df
    u = uniform(ident, salt)
    found = cuts(df, u, ident, [], bucket_counts(df, u, []), {(): [n]})
    return df.filter(upto(u, ident, found[(), n])) if found else df


def _split_by(df: DataFrame, u: Column, ident: str, by: list[str], counts: dict, test: float, validation: float) -> Column:
    """train, validation or test: round(n * share) rows of each stratum, by rank."""
    sizes = {k: sum(n for _, n in v) for k, v in counts.items()}
    ranks = {k: [int(n * test + 0.5), int(n * test + 0.5) + int(n * validation + 0.5)] for k, n in sizes.items()}
    found, split = cuts(df, u, ident, by, counts, ranks), F.lit("train")
    for key, (first, second) in ranks.items():
        for name, rank in (("validation", second), ("test", first)):
            if (key, rank) in found:
                split = F.when(_same(by, key) & upto(u, ident, found[key, rank]), name).otherwise(split)
    return split


def stratified_split(df: DataFrame, seed: int, test: float = 0.2, validation: float = 0.2, ident: str = "epk_id") -> DataFrame:
    """`df` with split: by treatment and outcome, or by treatment alone if a stratum has fewer than two rows."""
    u, by = uniform(ident, f"split{seed}"), ["t", "y"]
    counts = bucket_counts(df, u, by)
    if any(sum(n for _, n in v) < 2 for v in counts.values()):
        by, counts = ["t"], bucket_counts(df, u, ["t"])
    return df.withColumn("split", _split_by(df, u, ident, by, counts, test, validation))


def group_key(*columns: str) -> Column:
    """One hash for each distinct feature vector."""
    return F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns)).cast("binary"))


def group_safe_split(df: DataFrame, group: str, seed: int, test: float = 0.2, validation: float = 0.2) -> DataFrame:
    """`df` with split; all rows of a group share it, as it follows from the group alone. The fractions hold for groups, so row counts drift."""
    u = uniform(group, f"group{seed}")
    return df.withColumn("split", F.when(u < test, "test").when(u < test + validation, "validation").otherwise("train"))


def group_exact_split(df: DataFrame, group: str, seed: int, test: float = 0.2, validation: float = 0.2) -> DataFrame:
    """`df` with split; round(share * groups) groups go to test and to validation, by least hash of the group."""
    u, groups = uniform(group, f"group{seed}"), df.select(group).distinct()
    return df.withColumn("split", _split_by(groups, u, group, [], bucket_counts(groups, u, []), test, validation))


def leakage(df: DataFrame, group: str) -> DataFrame:
    """Groups that are in more than one split."""
    return df.groupBy(group).agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def check_no_leakage(df: DataFrame, group: str) -> None:
    require(leakage(df, group).isEmpty(), "a feature vector is in two splits")


def stratum_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(stratum("t", "y").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def fold_count(df: DataFrame, k: int) -> int:
    """At most the least stratum, at least two."""
    least = stratum_counts(df).agg(F.min("n")).first()[0] or 0
    return max(2, min(k, least))


def kfold(df: DataFrame, k: int, seed: int, ident: str = "epk_id") -> DataFrame:
    """`df` with fold, dealt round within each treatment and outcome stratum in hash order."""
    u, columns = uniform(ident, f"fold{seed}"), df.columns
    counts = df.groupBy("t", "y", _bucket(u).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("t", "y").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("t", "y", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # BUCKETS rows for each stratum
    nth = F.row_number().over(Window.partitionBy("t", "y", "bucket").orderBy("u", ident))
    rows = df.withColumns({"u": u, "bucket": _bucket(u)}).withColumn("nth", nth).join(F.broadcast(bases), ["t", "y", "bucket"])
    return rows.withColumn("fold", (F.col("base") + F.col("nth") - 1) % k).select(*columns, "fold")


def capped(df: DataFrame, most: dict[str, int], u: Column, ident: str = "epk_id") -> DataFrame:
    """The rows of least u for each value of a column, {column: how many}: positions within sorted range partitions, less the value's first."""
    (column, n), columns = next(iter(most.items())), df.columns
    placed = in_order(df.withColumn("__u", u).orderBy(column, "__u", ident), "__nth")
    first = placed.groupBy(F.col(column).alias("__of")).agg(F.min("__nth").alias("__first"))
    return placed.join(first, F.col(column).eqNullSafe(F.col("__of"))).filter(F.col("__nth") < F.col("__first") + n).select(*columns)


def per_arm_cap(df: DataFrame, caps: dict[int, int], salt: str, ident: str = "epk_id") -> DataFrame:
    """At most caps[arm] rows of each arm, by least hash; arms without a cap are left out."""
    u = uniform(ident, salt)
    found = cuts(df, u, ident, ["t"], bucket_counts(df, u, ["t"]), {(arm,): [most] for arm, most in caps.items()})
    keep = F.lit(False)
    for arm, most in caps.items():
        if most > 0:
            keep |= (F.col("t") == arm) & (upto(u, ident, found[(arm,), most]) if ((arm,), most) in found else F.lit(True))
    return df.filter(keep)


def context_sample(df: DataFrame, n: int, salt: str, ident: str = "epk_id") -> DataFrame:
    """n rows: one of each stratum first, then the least hashes of the rest."""
    u, by = uniform(ident, salt), ["t", "y"]
    counts = bucket_counts(df, u, by)
    first = sorted(cuts(df, u, ident, by, counts, {k: [1] for k in counts}).values())[:n]
    chosen, more = F.col(ident).isin([i for _, i in first]), n - len(first)
    if more:
        rest = df.filter(~chosen)
        found = cuts(rest, u, ident, [], bucket_counts(rest, u, []), {(): [more]})
        chosen = chosen | upto(u, ident, found[(), more]) if found else F.lit(True)
    return df.filter(chosen)


def numbered(rows: DataFrame, ident: str = "epk_id") -> DataFrame:
    """`rows` with idx from 0 in the order of `ident`: positions within range partitions, plus the partitions before."""
    placed = settled(rows.repartitionByRange(ident).withColumn("__p", F.spark_partition_id()), "placed")
    local = placed.withColumn("__k", F.row_number().over(Window.partitionBy("__p").orderBy(ident)))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    bases = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return local.join(F.broadcast(bases), "__p").withColumn("idx", F.col("base") + F.col("__k") - 1).drop("__p", "__k", "base")


def strided(df: DataFrame, order: str, n: int) -> DataFrame:
    """`df` with slot: every n-th row in order to the same slot."""
    return numbered(df, order).withColumn("slot", F.col("idx") % n).drop("idx")


def taken(df: DataFrame, positions: DataFrame, ident: str = "epk_id") -> DataFrame:
    """The rows of `df` at the positions (a column idx, from 0 in the order of `ident`), as often as a position occurs."""
    return numbered(df, ident).join(positions.select("idx"), "idx").drop("idx")


def in_order(df: DataFrame, name: str) -> DataFrame:
    """A sorted `df` with its rows numbered from 1: positions within the sort's range partitions, plus the partitions before."""
    placed = settled(df.select("*", F.monotonically_increasing_id().alias("__at")), "sorted")
    part = F.shiftrightunsigned("__at", 33)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    bases = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("n")).select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.withColumn("__p", part).join(F.broadcast(bases), "__p").withColumn(name, F.col("base") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__p", "__at", "base")
