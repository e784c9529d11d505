"""The tables as randomised trials: the same derived roles as DataFrames and as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clip, sigmoid, uniform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_u(ident: str, salt: str) -> str:
    return f"(CAST('0x' || substr(md5(CAST({ident} AS VARCHAR) || '|{salt}'), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE)"


def trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers; some balances and segments are blanked by hash."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    blank = uniform("o_orderkey", "miss") < 0.05
    return rows.select(
        F.col("o_orderkey").alias("epk_id"), (uniform("o_orderkey", "T") < 0.5).cast("int").alias("t"), (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.month("o_orderdate").alias("order_month"),
        F.when(~blank, F.col("c_acctbal")).alias("balance"), F.when(~blank, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"),
    )


TRIAL = f"""trial AS (
  SELECT o_orderkey AS epk_id, CAST({sql_u("o_orderkey", "T")} < 0.5 AS INT) AS t, CAST(o_orderstatus = 'F' AS INT) AS y,
         o_totalprice AS price, o_orderpriority AS priority, month(o_orderdate) AS order_month,
         CASE WHEN NOT {sql_u("o_orderkey", "miss")} < 0.05 THEN c_acctbal END AS balance,
         CASE WHEN NOT {sql_u("o_orderkey", "miss")} < 0.05 THEN c_mktsegment END AS segment, c_nationkey AS nation
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epk_id, t, y, model, score: a scorer with many ties, one with none, and a constant."""
    scores = F.map_from_arrays(F.array(*map(F.lit, ("coarse", "fine", "constant"))), F.array(F.floor(F.col("price") / 20000).cast("double"), uniform("epk_id", "fine") + F.col("price") / 1e6, F.lit(0.5)))
    return trial(spark, sf_dir).select("epk_id", "t", "y", F.explode(scores).alias("model", "score"))


SCORED = f"""scored AS (
  SELECT epk_id, t, y, 'coarse' AS model, floor(price / 20000)::DOUBLE AS score FROM trial
  UNION ALL SELECT epk_id, t, y, 'fine', {sql_u("epk_id", "fine")} + price / 1e6 FROM trial
  UNION ALL SELECT epk_id, t, y, 'constant', 0.5::DOUBLE FROM trial)"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with a known effect tau for each row."""
    z = F.col("price") / 100000 - 2
    p0 = clip(sigmoid(-1 + 0.3 * z), 0.001, 0.999)
    p1 = clip(p0 + 0.1 * (1 + 0.8 * F.tanh(uniform("epk_id", "z1") * 4 - 2)), 0.001, 0.999)
    tau = trial(spark, sf_dir).select(F.col("epk_id"), (p1 - p0).alias("tau"))
    return scored(spark, sf_dir).join(tau, "epk_id")


TRUTH = f"""truth AS (
  SELECT s.*, tau FROM scored s JOIN (
    SELECT epk_id, greatest(least(p0 + 0.1 * (1 + 0.8 * tanh({sql_u("epk_id", "z1")} * 4 - 2)), 0.999), 0.001) - p0 AS tau
    FROM (SELECT epk_id, greatest(least(1 / (1 + exp(-(-1 + 0.3 * (price / 100000 - 2)))), 0.999), 0.001) AS p0 FROM trial)) USING (epk_id))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of metrics over seeds, axes and severities, one row for each part of the orders by hash."""
    seed = F.floor(uniform("epk_id", "seed") * 5).cast("int")
    place = F.floor(uniform("epk_id", "place") * 6).cast("int")
    axis = F.when(F.col("epk_id") % 2 == 0, "scale").otherwise("conversion")
    severity = F.when(axis == "scale", F.element_at(F.array(*map(F.lit, (None, 200000.0, 50000.0, 20000.0, 5000.0, 2000.0))), place + 1)).otherwise(F.element_at(F.array(*map(F.lit, (0.0, 2.0, 4.0, 6.0, 9.0, 12.0))), place + 1))
    rows = trial(spark, sf_dir).select(seed.alias("seed"), axis.alias("axis"), place.alias("place"), severity.alias("severity"), "price", "balance", "y")
    names = ["dr_learner", "dr_learner#depth3", "t_learner", "x_learner"]
    series = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), F.lit(float(i)).alias("shift")) for i, n in enumerate(names))))
    rows = rows.select("*", series.alias("s")).select("*", "s.model", "s.shift")
    value = F.avg(F.sin(F.col("price") / 1000 * (F.col("shift") + 1)))
    return rows.groupBy("seed", "axis", "place", "severity", "model").agg(F.round(value, 9).alias("qini"), F.round(F.abs(F.avg("balance")) / 1000, 9).alias("pehe"), F.round(F.avg("y"), 9).alias("abs_ate_error"), F.count(F.lit(1)).alias("n_rows")).select(
        F.lit("orders").alias("dataset"), "axis", F.concat("axis", F.lit("_"), F.col("place").cast("string")).alias("severity_tag"), "severity", "seed", "model", "qini", "pehe", "abs_ate_error",
        F.when(F.col("seed") == 4, "error").otherwise("ok").alias("status"), "n_rows",
    )


RUNS = f"""runs AS (
  SELECT 'orders' AS dataset, axis, axis || '_' || CAST(place AS VARCHAR) AS severity_tag, severity, seed, model,
         round(avg(sin(price / 1000 * (shift + 1))), 9) AS qini, round(abs(avg(balance)) / 1000, 9) AS pehe, round(avg(y), 9) AS abs_ate_error,
         CASE WHEN seed = 4 THEN 'error' ELSE 'ok' END AS status, count(*) AS n_rows
  FROM (SELECT *, CASE WHEN axis = 'scale' THEN ([NULL, 200000.0, 50000.0, 20000.0, 5000.0, 2000.0]::DOUBLE[])[place + 1] ELSE ([0.0, 2.0, 4.0, 6.0, 9.0, 12.0]::DOUBLE[])[place + 1] END AS severity
        FROM (SELECT *, CAST(floor({sql_u("epk_id", "seed")} * 5) AS INT) AS seed, CAST(floor({sql_u("epk_id", "place")} * 6) AS INT) AS place,
                     CASE WHEN epk_id % 2 = 0 THEN 'scale' ELSE 'conversion' END AS axis FROM trial)),
       (VALUES ('dr_learner', 0.0), ('dr_learner#depth3', 1.0), ('t_learner', 2.0), ('x_learner', 3.0)) AS s(model, shift)
  GROUP BY seed, axis, place, severity, model)"""


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long bootstrap draws: a value for each cell, seed, model and draw."""
    many = F.explode(F.sequence(F.lit(0), F.lit(19))).alias("b")
    rows = runs(spark, sf_dir).select("dataset", "axis", "severity_tag", "seed", "model", "qini", many)
    name = F.concat_ws("/", "axis", "severity_tag", F.col("seed").cast("string"), "model", F.col("b").cast("string"))
    return rows.select("dataset", "axis", "severity_tag", "seed", "model", F.lit("qini_auc_normalized").alias("metric"), "b", F.round(F.col("qini") + uniform(name, "draw") / 10, 9).alias("value"))


DRAWS = f"""draws AS (
  SELECT dataset, axis, severity_tag, seed, model, 'qini_auc_normalized' AS metric, b,
         round(qini + {sql_u("axis || '/' || severity_tag || '/' || CAST(seed AS VARCHAR) || '/' || model || '/' || CAST(b AS VARCHAR)", "draw")} / 10, 9) AS value
  FROM runs, range(20) AS r(b))"""

PARTS = {"trial": (TRIAL, ()), "scored": (SCORED, ("trial",)), "truth": (TRUTH, ("scored",)), "runs": (RUNS, ("trial",)), "draws": (DRAWS, ("runs",))}


def sql(query: str, *parts: str) -> str:
    """`query` with the views it needs in front."""

    def needed(name: str) -> list[str]:
        return [*(x for n in PARTS[name][1] for x in needed(n)), name]

    names = dict.fromkeys(x for p in parts for x in needed(p))
    body = query.lstrip()
    recursive = body.startswith("+ RECURSIVE ")
    query = body.replace("+ RECURSIVE ", "+ ", 1)
    return ("WITH RECURSIVE " if recursive else "WITH ") + reduce(lambda a, b: f"{a},\n{b}", (PARTS[n][0] for n in names)) + (",\n" if query.lstrip().startswith("+") else "\n") + query.lstrip().removeprefix("+")
