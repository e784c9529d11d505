"""Exact deduplication by content sort (native: DataFrame functions only).

Range partitioning with sampled splitters sends equal normalised texts to the same place, the
external sort inside each partition makes them neighbours, and the window walks the sorted rows
comparing each whole text with its neighbour's. The splitters are heads of texts with a hash of
the whole, so that the sample stays small however long the texts are.

Hot texts: a text whose copies exceed a quarter of an average partition would fill one task. At
most four times as many such texts exist as there are partitions, so the table of their hashes
is bounded and broadcast; their rows are counted by partial aggregation before the shuffle and
never gathered.

Defined cases: null text counts as empty; rows with a null id rank last; of several rows with the
kept id, exactly one is kept; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bundled, documents, partitions, scratch, unbundled

NORMALISERS = {
    "none": lambda c: c,
    "lower": F.lower,
    "collapse_space": lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")),
}


def content_sort(df: DataFrame, text: str = "text", ident: str = "doc_id", keep: str = "max", normalise: str = "none", hot_share: float = 0.25) -> DataFrame:
    """`df` with __keep_id, __group_size, __kept and __sha256 for each row."""
    spark = df.sparkSession
    p = partitions(spark)
    best, order = (F.max, F.desc_nulls_last) if keep == "max" else (F.min, F.asc_nulls_last)
    if normalise == "none":  # the text is carried once
        rows = df.select(*(c for c in df.columns if c != text), F.col(text).isNull().alias("__none"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
        was = F.when(~F.col("__none"), F.col("__text")).alias(text)
    else:
        rows, was = df.withColumn("__text", F.coalesce(NORMALISERS[normalise](F.col(text)), F.lit(""))), F.col(text)
    limit = max(64, int(hot_share * df.select(ident).count() / p))

    hashed = rows.select(F.xxhash64("__text").alias("__hash"))
    hot = scratch(hashed.groupBy("__hash").count().filter(F.col("count") > limit).select("__hash"), "hot")  # at most p / hot_share rows
    key: Column = F.xxhash64("__text") == F.col("__hash")

    w = Window.partitionBy("__head", "__hash", "__text")
    ranked = w.orderBy(order(ident))
    rest = (
        rows.join(F.broadcast(hot), key, "left_anti")
        .withColumns({"__head": F.left("__text", F.lit(64)), "__hash": F.xxhash64("__text")})
        .repartitionByRange(p, "__head", "__hash")
        .withColumns({
            "__keep_id": F.first(ident).over(ranked),
            "__group_size": F.count(F.lit(1)).over(w),
            "__kept": F.row_number().over(ranked) == 1,
        })
        .withColumn("__sha256", F.sha2("__text", 256))
    )

    copies = rows.join(F.broadcast(hot), key, "left_semi").withColumn("__sha256", F.sha2("__text", 256))
    totals = copies.groupBy("__text").agg(best(ident).alias("__keep_id"), F.count(F.lit(1)).alias("__group_size")).select(F.sha2("__text", 256).alias("__of"), "__keep_id", "__group_size")
    totals = scratch(totals, "totals")  # hardly more rows than `hot`
    copies = copies.join(F.broadcast(totals), F.col("__sha256").eqNullSafe(F.col("__of"))).drop("__of")
    first = F.col(ident).eqNullSafe(F.col("__keep_id"))
    top = copies.filter(first).withColumn("__kept", F.row_number().over(Window.partitionBy("__sha256").orderBy(F.col("__sha256"))) == 1)
    copies = top.unionByName(copies.filter(~first).withColumn("__kept", F.lit(False))).withColumns({"__head": F.lit(""), "__hash": F.lit(0)})
    return rest.unionByName(copies.select(rest.columns)).select(*(was if c == text else F.col(c) for c in df.columns), "__keep_id", "__group_size", "__kept", "__sha256")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = content_sort(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.col("__keep_id").alias("keep_id"), F.col("__group_size").alias("group_size"), F.col("__kept").alias("kept"), F.col("__sha256").alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text; null and empty texts are one group."""
    rows = bundled(docs).withColumn("id", F.col("doc").getField("doc_id"))
    return unbundled(content_sort(rows, ident="id").filter("__kept"), docs.columns)


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
