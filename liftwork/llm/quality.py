"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Each document gets four transformed statistics: log mean word length, and the square roots of symbols per
word, of the share of repeated lines and of the share of words in repeated 3-word windows. For each language and
source the covariance with the least determinant is sought by concentration steps from three deterministic starts
(scaled medians, correlations of tanh scores, spatial signs): the `h` rows nearest by Mahalanobis distance give new
moments, until the determinants settle, and the start with the least determinant wins. One reweighting step
follows. A row is rejected when its distance is less likely than `outlier` under the F distribution of distances
from an estimate on so many rows.

All of it is additive: moments are sums, and the h-th distance comes from a histogram of
logarithmic distance bins, so every step is one partial aggregation per group, however large a
group is. Most documents have no symbols and no repeated lines at all, so the nearest rows may have no spread in a
direction. Each covariance is therefore the scatter of its rows plus the mean sampling variance that the
group's own counts have (of Poisson counts), which vanishes as texts grow; no spread is fixed beforehand.

Groups under `least_rows` rows (five for each statistic) are pooled by language, and what is left of those over all
languages; a pool that is still smaller passes no verdict. Rows that fail a base rule take no part
in the estimates.

Defined cases: null text has no words and fails the base rules; null language and null source are
values of their own; an empty table gives an empty result; repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bundled, documents, scratch, ship, slices, unbundled, widened

SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
P, STARTS = 4, 3
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[twice + k] = True
    return int(covered.sum())


def statistics(text: bytes) -> tuple[int, ...]:
    words = text.split()
    letters = text.translate(None, SPACE)
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    chars = len(letters) - len(letters.translate(None, bytes(range(0x80, 0xC0)))) if not letters.isascii() else 0
    return (len(words), len(letters) - chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines))


def _add_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch):
            found = np.array([statistics(t) for t in texts], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, found.T)], [*part.schema.names, *(f"__{s}" for s in STATS)])


def with_statistics(df: DataFrame) -> DataFrame:
    """`df` with the columns __n_words ... __n_lines; it needs a column text."""
    ship(df.sparkSession)
    return df.mapInArrow(_add_statistics, widened(df, {f"__{s}": "long" for s in STATS}))


def _drop_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _add_statistics(batches):
        yield batch.drop_columns(["text"])


def base_failed() -> Column:
    return (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))


def transformed() -> list[Column]:
    words, lines = F.greatest(F.col("__n_words"), F.lit(1)).cast("double"), F.greatest(F.col("__n_lines"), F.lit(1)).cast("double")
    return [F.log(F.greatest(F.col("__word_chars"), F.lit(1)) / words), F.sqrt(F.col("__n_symbols") / words), F.sqrt(F.col("__n_dup_lines") / lines), F.sqrt(F.col("__n_repeat_words") / words)]


def sampling() -> list[Column]:
    """The variance that each transformed statistic has from its count alone; repeated windows are three words each, letters after a word's first are counted."""
    words, lines = F.greatest(F.col("__n_words"), F.lit(1)).cast("double"), F.greatest(F.col("__n_lines"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("__word_chars"), F.lit(1)).cast("double")
    return [F.greatest(1 - words / chars, F.lit(0.0)) / chars, 1 / (4 * words), 1 / (4 * lines), 3 / (4 * words)]


def chi2_cdf(x: float, p: int) -> float:
    """Of an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return high


def consistency(share: float) -> float:
    """What the covariance of the nearest `share` of normal rows is multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2) if share < 1 else 1.0


def quantile(df: DataFrame, keys: list[str], bins: Column, share: float, out: str) -> DataFrame:
    """For each of `keys`, the least bin up to which at least `share` of the rows lie.

    Rows are counted by bin first. Sums of 64 bins each show which 64 hold the quantile, and only these are looked at
    one by one, so that no window holds more than a few hundred numbers of a key.
    """
    counts = df.groupBy(*keys, bins.cast("long").alias("__bin")).count().withColumn("__wide", F.floor(F.col("__bin") / 64).cast("long"))
    wide = counts.groupBy(*keys, "__wide").agg(F.sum("count").alias("__sum"))
    w = Window.partitionBy(*keys)
    upto = F.sum("__sum").over(w.orderBy("__wide"))
    place = wide.select(*keys, "__wide", F.ceil(F.lit(share) * F.sum("__sum").over(w)).alias("__need"), upto.alias("__upto"), (upto - F.col("__sum")).alias("__base"))
    place = place.filter("__upto >= __need AND __base < __need").drop("__upto")
    inside = counts.join(place, [*keys, "__wide"])
    reached = F.col("__base") + F.sum("count").over(Window.partitionBy(*keys).orderBy("__bin")) >= F.col("__need")
    return inside.select(*keys, "__bin", reached.alias("__ok")).filter("__ok").groupBy(*keys).agg(F.min("__bin").alias(out))


def distance() -> Column:
    """Squared Mahalanobis distance by the columns c* (centre) and q* (inverse covariance)."""
    d = [F.col(f"__x{i}") - F.col(f"__c{i}") for i in range(P)]
    return sum(((1 if i == j else 2) * d[i] * d[j] * F.col(f"__q{i}{j}") for i, j in PAIRS), F.lit(0.0))


def distance_bin() -> Column:
    return F.floor(F.log2(F.greatest(distance(), F.lit(1e-9))) * 512)


def likelihood(d2: Column, n: Column) -> Column:
    """The probability of a squared distance of `d2` or more from the moments of `n` normal rows: of an F distribution with P = 4 and n - 4 degrees of freedom."""
    m = n - P
    w = 1 / (1 + P * d2 * n / ((n * n - 1) * P))
    return F.exp(m / 2 * F.log(w)) * (1 + m / 2 * (1 - w))


MODEL = "__key string, __start int, __n long, __det double, " + ", ".join(f"__c{i} double" for i in range(P)) + ", " + ", ".join(f"__q{i}{j} double" for i, j in PAIRS)


def second_moments(x: list[Column], name: str) -> list[Column]:
    return [F.sum(x[i] * x[j]).alias(f"{name}{i}{j}") for i, j in PAIRS]


def matrices(part: pd.DataFrame, name: str) -> np.ndarray:
    out = np.zeros((len(part), P, P))
    for i, j in PAIRS:
        out[:, i, j] = out[:, j, i] = part[f"{name}{i}{j}"]
    return out


def vectors(part: pd.DataFrame, name: str) -> np.ndarray:
    return part[[f"{name}{i}" for i in range(P)]].to_numpy(float)


def model_rows(keys: pd.Series, start: np.ndarray | int, n: np.ndarray, centre: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    inverse = np.linalg.inv(cov)
    return pd.DataFrame({"__key": keys.to_numpy(), "__start": start, "__n": n, "__det": np.linalg.det(cov)} | {f"__c{i}": centre[:, i] for i in range(P)} | {f"__q{i}{j}": inverse[:, i, j] for i, j in PAIRS})


def floors(part: pd.DataFrame) -> np.ndarray:
    """What is added to a scatter matrix: mean sampling variances, and a millionth of the spread against constant columns."""
    return np.eye(P) * (vectors(part, "v") + 1e-6 * vectors(part, "a") + 1e-12)[:, None, :]


def groups(rows: DataFrame) -> DataFrame:
    """For each __key: rows, median m, scale s, sampling variance v and variance a of each statistic."""
    each = rows.select("__key", F.posexplode(F.array(*(f"__x{i}" for i in range(P)))).alias("__of", "__x"))
    median = quantile(each, ["__key", "__of"], F.floor(F.col("__x") * 4096), 0.5, "__m")
    median = scratch(median.select("__key", "__of", ((F.col("__m") + 0.5) / 4096).alias("__m")), "medians")
    mad = quantile(each.join(median, ["__key", "__of"]), ["__key", "__of"], F.floor(F.abs(F.col("__x") - F.col("__m")) * 4096), 0.5, "__d")
    found = median.join(mad, ["__key", "__of"]).groupBy("__key").agg(*(F.max(F.when(F.col("__of") == i, F.col(f"__{c}"))).alias(f"{c}{i}") for i in range(P) for c in "md"))
    sums = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"__v{i}").alias(f"v{i}") for i in range(P)), *(F.var_pop(f"__x{i}").alias(f"a{i}") for i in range(P)))
    scale = [F.coalesce(*(F.when(c > 1e-9, c) for c in (1.4826 * F.col(f"d{i}") / 4096, F.sqrt(f"v{i}"), F.sqrt(f"a{i}"))), F.lit(1.0)).alias(f"s{i}") for i in range(P)]
    return scratch(sums.join(found, "__key").select("*", *scale), "scales")


def first_models(rows: DataFrame, group: DataFrame) -> DataFrame:
    """STARTS models for each __key: medians with scales alone, with correlations of tanh scores, with spatial signs."""
    near = rows.join(group.select("__key", *(f"{c}{i}" for c in "ms" for i in range(P))), "__key")
    z = [(F.col(f"__x{i}") - F.col(f"m{i}")) / F.col(f"s{i}") for i in range(P)]
    length = F.greatest(F.sqrt(sum((x * x for x in z), F.lit(0.0))), F.lit(1e-9))
    tanh, sign = [F.tanh(x) for x in z], [x / length for x in z]
    sums = near.groupBy("__key").agg(*(F.sum(tanh[i]).alias(f"t{i}") for i in range(P)), *second_moments(tanh, "t"), *second_moments(sign, "u"))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n, centre, scale = part["n"].to_numpy(float)[:, None, None], vectors(part, "m"), vectors(part, "s")
            mean = vectors(part, "t")[:, :, None] / n
            shapes = [np.broadcast_to(np.eye(P), (len(part), P, P)), matrices(part, "t") / n - mean @ mean.transpose(0, 2, 1), P * matrices(part, "u") / n]
            for k, shape in enumerate(shapes):
                spread = np.sqrt(np.maximum(np.einsum("kii->ki", shape), 1e-9))
                correlation = shape / (spread[:, :, None] * spread[:, None, :])
                cov = (0.99 * correlation + 0.01 * np.eye(P)) * scale[:, :, None] * scale[:, None, :]
                yield model_rows(part["__key"], k, part["n"].to_numpy(), centre, cov + floors(part))

    return sums.join(group, "__key").mapInPandas(solve, MODEL)


def moments(df: DataFrame, group: DataFrame, factor: float) -> DataFrame:
    """Centre and inverse covariance for each __key and __start of the rows given."""
    x = [F.col(f"__x{i}") for i in range(P)]
    sums = df.groupBy("__key", "__start").agg(F.count(F.lit(1)).alias("rows"), *(F.sum(x[i]).alias(f"x{i}") for i in range(P)), *second_moments(x, "x"))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n = part["rows"].to_numpy(float)[:, None, None]
            centre = vectors(part, "x")[:, :, None] / n
            cov = factor * (matrices(part, "x") / n - centre @ centre.transpose(0, 2, 1)) + floors(part)
            yield model_rows(part["__key"], part["__start"].to_numpy(), part["rows"].to_numpy(), centre[:, :, 0], cov)

    return sums.join(group, "__key").mapInPandas(solve, MODEL)


def grouped(rows: DataFrame, least_rows: int) -> DataFrame:
    """`rows` (__lang, __source, __failed) with the __key of the group that judges each row, or null."""
    counts = scratch(rows.groupBy("__lang", "__source").agg(F.count_if(~F.col("__failed")).alias("n")), "groups")
    alone = F.col("n") >= least_rows
    by_lang = F.sum(F.when(~alone, F.col("n"))).over(Window.partitionBy("__lang"))
    name = F.when(alone, F.to_json(F.struct("__lang", "__source"))).when(by_lang >= least_rows, F.to_json(F.struct("__lang")))
    pooled = counts.select("__lang", "__source", "n", name.alias("__key"))
    rest = pooled.filter("__key IS NULL").agg(F.sum("n").alias("rest"))
    keys = pooled.join(rest, how="left").select("__lang", "__source", F.coalesce("__key", F.when(F.col("rest") >= least_rows, F.lit("all"))).alias("__key"))
    return with_keys(rows, scratch(keys, "keys"))


def with_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """`rows` (__lang, __source) with the __key that `keys` has for them."""
    keys = keys.select(F.col("__lang").alias("__of_lang"), F.col("__source").alias("__of_source"), "__key")
    return rows.join(keys, F.col("__lang").eqNullSafe(F.col("__of_lang")) & F.col("__source").eqNullSafe(F.col("__of_source")), "left").drop("__of_lang", "__of_source")


def fit(rows: DataFrame, share: float = 0.75, least_rows: int = 5 * P, most_steps: int = 12) -> tuple[DataFrame, DataFrame]:
    """(`rows` with __key, the model for each __key); warns if `most_steps` concentration steps do not settle it. rows: __lang, __source, __failed, __x0 ... and, unless counts are no matter, __v0 ..."""
    rows = rows.withColumns({f"__v{i}": F.lit(0.0) for i in range(P) if f"__v{i}" not in rows.columns})
    rows = scratch(grouped(rows, least_rows), "rows")
    clean = rows.filter(~F.col("__failed") & F.col("__key").isNotNull()).select("__key", *(f"__{c}{i}" for c in "xv" for i in range(P)))
    group = groups(clean)
    clean = clean.drop(*(f"__v{i}" for i in range(P)))
    model = scratch(first_models(clean, group), "model0")
    for step in range(most_steps):
        near = clean.join(model, "__key")
        limit = quantile(near, ["__key", "__start"], distance_bin(), share, "__limit")
        chosen = near.join(limit, ["__key", "__start"]).filter(distance_bin() <= F.col("__limit"))
        old, model = model, scratch(moments(chosen, group, consistency(share)), f"model{step + 1}")
        was = old.select("__key", "__start", F.col("__det").alias("was"))
        if step and model.join(was, ["__key", "__start"]).filter(F.abs(F.col("__det") - F.col("was")) > 1e-6 * F.col("was")).isEmpty():
            break
    else:
        warnings.warn(f"some determinants still fell after {most_steps} concentration steps; the last estimates are taken", stacklevel=2)
    best = model.groupBy("__key").agg(F.min(F.struct("__det", "__start")).getField("__start").alias("__start"))
    inner = clean.join(model.join(best, ["__key", "__start"]), "__key").filter(distance() <= chi2_quantile(0.975, P))
    return rows, scratch(moments(inner, group, consistency(0.975)), "model")


def features(stats: DataFrame) -> DataFrame:
    x, v = transformed(), sampling()
    return stats.select("*", base_failed().alias("__failed"), *(x[i].alias(f"__x{i}") for i in range(P)), *(v[i].alias(f"__v{i}") for i in range(P)))


def judged(rows: DataFrame, model: DataFrame, outlier: float) -> DataFrame:
    """`rows` (with __key) and __d2, __kept. outlier: the probability that a normal row is rejected."""
    likely = likelihood(F.col("__d2"), F.col("__n").cast("double")) >= outlier
    return rows.join(model.drop("__det", "__start"), "__key", "left").withColumn("__d2", distance()).withColumn("__kept", ~F.col("__failed") & F.coalesce(likely, F.lit(True)))


def statistics_of(docs: DataFrame) -> DataFrame:
    """__lang, __source and the statistics of `docs` (lang, source, text and others, which stay), without the text."""
    ship(docs.sparkSession)
    plain = docs.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *(c for c in docs.columns if c not in ("lang", "source")))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema if f.name != "text"]
    return scratch(plain.mapInArrow(_drop_text, ", ".join([*fields, *(f"__{s} long" for s in STATS)])), "stats")


def op1(spark: SparkSession, sf_dir: str, outlier: float = 1e-4) -> DataFrame:
    stats = statistics_of(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    out = judged(*fit(features(stats)), outlier)
    return out.select("doc_id", *(F.col(f"__{s}").alias(s) for s in STATS[:5]), F.col("__failed").alias("base_failed"), F.col("__d2").alias("distance2"), F.col("__kept").alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, outlier: float = 1e-4) -> DataFrame:
    """The documents kept. The statistics are taken twice, once for the estimates and once beside the texts: that moves no text."""
    rows, model = fit(features(statistics_of(docs.select("lang", "source", "text"))))
    keys = scratch(rows.groupBy("__lang", "__source").agg(F.first("__key").alias("__key")), "keys")
    again = features(with_statistics(bundled(docs))).withColumns({"__lang": F.col("doc.lang"), "__source": F.col("doc.source")})
    return unbundled(judged(with_keys(again, keys), model, outlier).filter("__kept"), docs.columns)
