"""Train-only preprocessing: impute, scale, one-hot; exact statistics, fitted once and applied as literals.

The statistics of all numeric columns come from one aggregation over the training rows, the modes
and categories of all categorical columns from one count of (column, value) pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quantiles import percentiles
from .splits import in_order
from .validate import check_features, require


@dataclass
class Preprocessor:
    """What was learnt on the training rows. save() and load() keep it as JSON."""

    numeric: dict[str, tuple[float, float, float]] = field(default_factory=dict)  # median, mean, scale
    categories: dict[str, tuple[str, list[str]]] = field(default_factory=dict)  # mode, values in order

    def names(self) -> list[str]:
        return [*self.numeric, *(f"{c}_{v}" for c, (_, values) in self.categories.items() for v in values)]

    def columns(self) -> list[Column]:
        """Numeric columns first, then one column for each category; unseen values have none."""
        out = [((numeric(c, median) - mean) / scale).cast("float").alias(c) for c, (median, mean, scale) in self.numeric.items()]
        for c, (mode, values) in self.categories.items():
            have = F.coalesce(F.col(c).cast("string"), F.lit(mode))
            out += [(have == v).cast("float").alias(f"{c}_{v}") for v in values]
        return out

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return df.select(*keep, *self.columns())

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(c, "numeric", [repr(x) for x in v]) for c, v in self.numeric.items()] + [(c, "category", [m, *v]) for c, (m, v) in self.categories.items()]
        spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "nth int, name string, kind string, learnt array<string>").coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preprocessor:
        out = cls()
        for r in spark.read.schema("nth int, name string, kind string, learnt array<string>").json(path).orderBy("nth").collect():
            if r["kind"] == "numeric":
                out.numeric[r["name"]] = tuple(map(float, r["learnt"]))
            else:
                out.categories[r["name"]] = (r["learnt"][0], r["learnt"][1:])
        return out


def numeric(c: str, otherwise: float | None = None) -> Column:
    x = F.col(c).cast("double")
    x = F.when(~F.isnan(x), x)
    return x if otherwise is None else F.coalesce(x, F.lit(otherwise))


def numeric_statistics(train: DataFrame, columns: list[str]) -> DataFrame:
    """name, median, mean, scale; mean and population scale after imputation with the exact median (see `quantiles`)."""
    medians = {c: m for c, (m,) in percentiles(train, columns, [0.5]).items()}
    filled = {c: F.coalesce(numeric(c), F.lit(medians[c])) for c in columns}
    facts = [F.struct(F.lit(c).alias("name"), F.lit(medians[c]).cast("double").alias("median"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("scale")) for c, x in filled.items()]
    return train.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def category_counts(train: DataFrame, columns: list[str]) -> DataFrame:
    """name, value, n of each value that occurs."""
    long = train.select(F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("string"))))).alias("name", "value"))
    return long.filter("value IS NOT NULL").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


def fit(train: DataFrame, numeric_columns: list[str], categorical_columns: list[str], most_categories: int = 10_000) -> Preprocessor:
    """The most frequent value (the least of equals) fills categorical gaps; constant columns get scale 1."""
    out = Preprocessor()
    if numeric_columns:
        found = {r["name"]: r for r in numeric_statistics(train, numeric_columns).collect()}
        for c in numeric_columns:
            require(found[c]["median"] is not None, f"{c} has no value to learn from")
            out.numeric[c] = (found[c]["median"], found[c]["mean"], found[c]["scale"] or 1.0)
    if categorical_columns:
        counts = category_counts(train, categorical_columns).limit(most_categories + 1).collect()
        require(len(counts) <= most_categories, f"more than {most_categories} categories")
        for c in categorical_columns:
            own = sorted(((-r["n"], r["value"]) for r in counts if r["name"] == c))
            require(bool(own), f"{c} has no value to learn from")
            out.categories[c] = (own[0][1], sorted(v for _, v in own))
    return out


def prepare(df: DataFrame, numeric_columns: list[str], categorical_columns: list[str], keep: list[str]) -> tuple[DataFrame, Preprocessor]:
    """Fits on split = 'train' and transforms all rows; what comes out must be finite."""
    fitted = fit(df.filter("split = 'train'"), numeric_columns, categorical_columns)
    out = fitted.transform(df, keep)
    check_features(out, fitted.names())
    return out, fitted


def frequency_ordinal(df: DataFrame, column: str) -> DataFrame:
    """value, n, ordinal: values by falling frequency, then by name; missing is a value of its own."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("__missing__")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return in_order(counts.orderBy(F.desc("n"), "value"), "__nth").select("value", "n", (F.col("__nth") - 1).cast("int").alias("ordinal"))


def principal_axes(df: DataFrame, columns: list[str], k: int) -> np.ndarray:
    """The directions of the first k principal components, one in each column."""
    rows = VectorAssembler(inputCols=columns, outputCol="__features").transform(df)
    return PCA(k=k, inputCol="__features", outputCol="__pc").fit(rows.select("__features")).pc.toArray()


def principal_components(df: DataFrame, columns: list[str], k: int, keep: list[str]) -> DataFrame:
    """`keep` and pc, the first k principal components of the columns as an array."""
    axes = principal_axes(df, columns, k)
    return df.select(*keep, F.array(*(sum((F.col(c).cast("double") * float(axes[i, j]) for i, c in enumerate(columns)), F.lit(0.0)) for j in range(k))).alias("pc"))
