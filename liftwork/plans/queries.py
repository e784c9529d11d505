"""One query for each operator over the whole tables, with the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import bootstrap, curves, diagnostics, heads, kernels, learners, neighbours, prepare, regimes, resample, semisynth, splits, trials, validate
from ..sources import tables
from ..sources.scratch import settled
from . import runs as runs_of
from .views import draws, runs, scored, sql, sql_u, table, trial, truth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CUMULATIVE = """+ counts AS (SELECT model, score, sum(t) AS nt, sum(1 - t) AS nc, sum(y * t) AS yt, sum(y * (1 - t)) AS yc FROM scored GROUP BY model, score),
sums AS (SELECT model, score, nt, nc, yt, yc, sum(nt) OVER w AS cnt, sum(nc) OVER w AS cnc, sum(yt) OVER w AS cyt, sum(yc) OVER w AS cyc
  FROM counts WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
points AS (SELECT model, score, cnt + cnc AS x, CASE WHEN cnc > 0 THEN cyt - cyc::DOUBLE * cnt / cnc ELSE 0.0 END AS qini,
    (CASE WHEN cnt > 0 THEN cyt::DOUBLE / cnt ELSE 0 END - CASE WHEN cnc > 0 THEN cyc::DOUBLE / cnc ELSE 0 END) * (cnt + cnc) AS uplift FROM sums
  UNION ALL SELECT DISTINCT model, CAST('inf' AS DOUBLE), 0, 0.0, 0.0 FROM scored),
steps AS (SELECT *, lag(x) OVER w AS x0, lag(qini) OVER w AS q0, lag(uplift) OVER w AS u0 FROM points WINDOW w AS (PARTITION BY model ORDER BY x)),
area AS (SELECT model, sum((x - x0) * (qini + q0) / 2) AS qa, sum((x - x0) * (uplift + u0) / 2) AS ua FROM steps GROUP BY model),
cls AS (SELECT model, sum(t * y)::DOUBLE AS tr, sum(t * (1 - y))::DOUBLE AS tn, sum((1 - t) * y)::DOUBLE AS cr, sum((1 - t) * (1 - y))::DOUBLE AS cn, count(*)::DOUBLE AS n FROM scored GROUP BY model),
perfect AS (SELECT scored.model, CASE WHEN y * t - y * (1 - t) = 1 THEN 1 WHEN y * t - y * (1 - t) = 0 THEN 0 ELSE -1 END AS ps,
    2 * (CASE WHEN y = t THEN 1 ELSE 0 END) + CASE WHEN cr > tn THEN y ELSE t END AS pu, t, y FROM scored JOIN cls ON cls.model = scored.model),
"""


def curve_area(name: str, score: str) -> str:
    """CTEs that rank the rows by `score` of perfect and give {name}(model, qa, ua)."""
    return f"""{name}s AS (SELECT model, s, sum(nt) OVER w AS cnt, sum(nc) OVER w AS cnc, sum(yt) OVER w AS cyt, sum(yc) OVER w AS cyc
  FROM (SELECT model, {score} AS s, sum(t) AS nt, sum(1 - t) AS nc, sum(y * t) AS yt, sum(y * (1 - t)) AS yc FROM perfect GROUP BY model, {score}) WINDOW w AS (PARTITION BY model ORDER BY s DESC)),
{name}p AS (SELECT model, cnt + cnc AS x, CASE WHEN cnc > 0 THEN cyt - cyc::DOUBLE * cnt / cnc ELSE 0.0 END AS qini,
    (CASE WHEN cnt > 0 THEN cyt::DOUBLE / cnt ELSE 0 END - CASE WHEN cnc > 0 THEN cyc::DOUBLE / cnc ELSE 0 END) * (cnt + cnc) AS uplift FROM {name}s
  UNION ALL SELECT DISTINCT model, 0, 0.0, 0.0 FROM perfect),
{name} AS (SELECT model, sum((x - x0) * (qini + q0) / 2) AS qa, sum((x - x0) * (uplift + u0) / 2) AS ua, max_by(qini, x) AS qe, max_by(uplift, x) AS ue
  FROM (SELECT *, lag(x) OVER w AS x0, lag(qini) OVER w AS q0, lag(uplift) OVER w AS u0 FROM {name}p WINDOW w AS (PARTITION BY model ORDER BY x)) GROUP BY model)"""


METRICS = CUMULATIVE + curve_area("pq", "ps") + ",\n" + curve_area("pu", "pu") + """,
metrics AS (SELECT model, round(CASE WHEN abs(pq.qa - n * pq.qe / 2) > 1e-12 THEN (area.qa - n * pq.qe / 2) / (pq.qa - n * pq.qe / 2) END, 8) AS qini_auc_normalized,
  round((area.qa - n * pq.qe / 2) / (n * n), 8) AS qini_coefficient,
  round(CASE WHEN abs(pu.ua - n * pu.ue / 2) > 1e-12 THEN (area.ua - n * pu.ue / 2) / (pu.ua - n * pu.ue / 2) END, 8) AS uplift_auc_normalized,
  round(area.ua / (n * n), 8) AS auuc
FROM area JOIN pq USING (model) JOIN pu USING (model) JOIN cls USING (model)),
ranked AS (SELECT model, t, y, row_number() OVER (PARTITION BY model ORDER BY score DESC, epk_id) AS k, count(*) OVER (PARTITION BY model) AS n FROM scored),
at10 AS (SELECT model, round(avg(y) FILTER (WHERE t = 1) - avg(y) FILTER (WHERE t = 0), 8) AS uplift_at_10pct FROM ranked WHERE k <= greatest(1, floor(n * 0.1::DOUBLE)) GROUP BY model),
at20 AS (SELECT model, round(avg(y) FILTER (WHERE t = 1) - avg(y) FILTER (WHERE t = 0), 8) AS uplift_at_20pct FROM ranked WHERE k <= greatest(1, floor(n * 0.2::DOUBLE)) GROUP BY model),
moments AS (SELECT model, round(avg(y) FILTER (WHERE t = 1) - avg(y) FILTER (WHERE t = 0), 8) AS ate_observed, round(avg(score), 8) AS cate_mean, round(stddev_pop(score), 8) AS cate_std FROM scored GROUP BY model)
"""


def rounded(df: DataFrame, digits: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


def query(name: str, text: str | None = None, *parts: str):
    """Registers a query; `parts` are the views that its SQL needs."""

    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = sql(text, *parts) if parts else text
        return f

    return add


# ---- sources and validation

@query("align_xy", "SELECT count(*) AS n, count(DISTINCT epk_id) AS n_ids, CAST(sum(t) AS BIGINT) AS treated, CAST(sum(y) AS BIGINT) AS events FROM trial", "trial")
def align_xy(spark, d):
    rows = trial(spark, d)
    out = tables.align(rows.select("epk_id", "t", "price", "priority"), rows.select("epk_id", "y"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("epk_id").alias("n_ids"), F.sum("t").alias("treated"), F.sum("y").alias("events"))


@query("validate_inputs", """SELECT model, count(*) AS n, count(*) FILTER (WHERE isfinite(score)) AS finite_scores, count(*) FILTER (WHERE y IN (0, 1)) AS binary_y,
  count(*) FILTER (WHERE t IN (0, 1)) AS binary_t, count(DISTINCT t) AS arms, count(DISTINCT y) AS outcomes FROM scored WHERE model = 'fine' GROUP BY model""", "scored")
def validate_inputs(spark, d):
    return validate.metric_inputs(scored(spark, d).filter("model = 'fine'")).select(F.lit("fine").alias("model"), "*")


@query("feature_projection", "SELECT epk_id, price, priority, order_month, balance, segment, nation FROM trial", "trial")
def feature_projection(spark, d):
    return trial(spark, d).select("epk_id", *tables.feature_columns(trial(spark, d)))


@query("finite_filter", "SELECT count(*) AS n, round(avg(balance), 6) AS mean FROM trial WHERE balance IS NOT NULL", "trial")
def finite_filter(spark, d):
    return trial(spark, d).filter(fn.finite(F.col("balance"))).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("balance"), 6).alias("mean"))


@query("event_gate", """SELECT segment, count(*) AS n, round(avg(t), 8) AS treatment_rate, round(avg(y), 8) AS outcome_rate, count(*) FILTER (WHERE t = 0) AS arm_0_n, count(*) FILTER (WHERE t = 1) AS arm_1_n,
  CAST(coalesce(sum(y) FILTER (WHERE t = 0), 0) AS BIGINT) AS arm_0_events, CAST(coalesce(sum(y) FILTER (WHERE t = 1), 0) AS BIGINT) AS arm_1_events,
  CAST(least(arm_0_events, arm_1_events) AS BIGINT) AS min_events_per_arm, arm_0_n > 0 AND arm_1_n > 0 AS both_arms_present, NOT both_arms_present OR least(arm_0_events, arm_1_events) < 10 AS degenerate FROM trial GROUP BY segment""", "trial")
def event_gate(spark, d):
    return rounded(validate.event_gate(trial(spark, d), ["segment"]))


@query("realized_severity", "SELECT priority, round(avg(t), 8) AS realized_treatment_rate, round(avg(y), 8) AS realized_conversion_rate, round(avg(1 - t), 8) AS realized_control_share, count(*) AS n_rows FROM trial GROUP BY priority", "trial")
def realized_severity(spark, d):
    return rounded(validate.realized_severity(trial(spark, d), ["priority"]))


# ---- caps, splits, folds

SPLIT = f"""split AS (SELECT *, CASE WHEN nth <= round(n * 0.2) THEN 'test' WHEN nth <= round(n * 0.2) + round(n * 0.2) THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY t, y ORDER BY {sql_u("epk_id", "split7")}, epk_id) AS nth, count(*) OVER (PARTITION BY t, y) AS n FROM trial))"""


@query("row_cap", f"SELECT epk_id FROM trial ORDER BY {sql_u('epk_id', 'cap')}, epk_id LIMIT 5000", "trial")
def row_cap(spark, d):
    return splits.exact_cap(trial(spark, d), 5000, "cap").select("epk_id")


@query("split_stratified", f"+{SPLIT} SELECT epk_id, split FROM split", "trial")
def split_stratified(spark, d):
    return splits.stratified_split(trial(spark, d), 7).select("epk_id", "split")


@query("split_stats", f"""+{SPLIT} SELECT split, count(*) AS n, round(avg(t), 8) AS treatment_rate, round(avg(y), 8) AS outcome_rate, count(*) FILTER (WHERE t = 0) AS arm_0_n, count(*) FILTER (WHERE t = 1) AS arm_1_n,
  CAST(sum(y) FILTER (WHERE t = 0) AS BIGINT) AS arm_0_events, CAST(sum(y) FILTER (WHERE t = 1) AS BIGINT) AS arm_1_events FROM split GROUP BY split""", "trial")
def split_stats(spark, d):
    return rounded(validate.split_stats(splits.stratified_split(trial(spark, d), 7)))


GROUPS = "grp AS (SELECT *, md5(concat_ws('|', coalesce(priority, '<null>'), coalesce(segment, '<null>'), coalesce(CAST(nation AS VARCHAR), '<null>'), coalesce(CAST(order_month AS VARCHAR), '<null>'))) AS g FROM trial)"


@query("split_group_safe", f"+{GROUPS} SELECT epk_id, CASE WHEN {sql_u('g', 'group7')} < 0.2 THEN 'test' WHEN {sql_u('g', 'group7')} < 0.4 THEN 'validation' ELSE 'train' END AS split FROM grp", "trial")
def split_group_safe(spark, d):
    rows = trial(spark, d).withColumn("g", splits.group_key("priority", "segment", "nation", "order_month"))
    return splits.group_safe_split(rows, "g", 7).select("epk_id", "split")


@query("split_leakage", f"+{SPLIT} SELECT nation, count(DISTINCT split) AS splits FROM split GROUP BY nation HAVING count(DISTINCT split) > 1", "trial")
def split_leakage(spark, d):
    return splits.leakage(splits.stratified_split(trial(spark, d), 7), "nation")


@query("kfold_assign", f"SELECT epk_id, CAST((row_number() OVER (PARTITION BY t, y ORDER BY {sql_u('epk_id', 'fold3')}, epk_id) - 1) % 5 AS INT) AS fold FROM trial", "trial")
def kfold_assign(spark, d):
    return splits.kfold(trial(spark, d), 5, 3).select("epk_id", F.col("fold").cast("int").alias("fold"))


@query("stratum_counts", "SELECT CAST(t AS VARCHAR) || '_' || CAST(y AS VARCHAR) AS stratum, count(*) AS n FROM trial GROUP BY 1", "trial")
def stratum_counts(spark, d):
    return splits.stratum_counts(trial(spark, d))


@query("per_arm_cap", f"SELECT epk_id, t FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY {sql_u('epk_id', 'arm')}, epk_id) AS nth FROM trial) WHERE nth <= CASE t WHEN 0 THEN 2000 ELSE 500 END", "trial")
def per_arm_cap(spark, d):
    return splits.per_arm_cap(trial(spark, d), {0: 2000, 1: 500}, "arm").select("epk_id", "t")


# ---- preprocessing

NUMBERS = "(SELECT split, 'balance' AS name, balance AS v FROM split UNION ALL SELECT split, 'price', price FROM split)"


@query("impute_median_mode", f"""+{SPLIT}, med AS (SELECT name, median(v) AS median FROM {NUMBERS} WHERE split = 'train' GROUP BY name)
SELECT name, round(median, 8) AS median, round(avg(coalesce(v, median)), 6) AS mean, round(stddev_pop(coalesce(v, median)), 6) AS scale FROM {NUMBERS} JOIN med USING (name) WHERE split = 'train' GROUP BY name, median""", "trial")
def impute_median_mode(spark, d):
    train = splits.stratified_split(trial(spark, d), 7).filter("split = 'train'")
    return rounded(rounded(prepare.numeric_statistics(train, ["balance", "price"]), 8, ("mean", "scale")), 6, ("median",))


@query("category_counts", f"+{SPLIT} SELECT 'segment' AS name, segment AS value, count(*) AS n FROM split WHERE split = 'train' AND segment IS NOT NULL GROUP BY segment UNION ALL SELECT 'priority', priority, count(*) FROM split WHERE split = 'train' GROUP BY priority", "trial")
def category_counts(spark, d):
    return prepare.category_counts(splits.stratified_split(trial(spark, d), 7).filter("split = 'train'"), ["segment", "priority"])


@query("standardize", f"""+{SPLIT}, med AS (SELECT median(balance) AS m FROM split WHERE split = 'train'), st AS (SELECT avg(coalesce(balance, m)) AS mean, stddev_pop(coalesce(balance, m)) AS scale FROM split, med WHERE split = 'train')
SELECT split, count(*) AS n, round(avg((coalesce(balance, m) - mean) / scale), 5) + 0.0 AS mean, round(stddev_pop((coalesce(balance, m) - mean) / scale), 5) AS std FROM split, med, st GROUP BY split""", "trial")
def standardize(spark, d):
    rows, _ = prepare.prepare(splits.stratified_split(trial(spark, d), 7), ["balance"], [], ["epk_id", "split"])
    x = F.col("balance").cast("double")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg(x), 5) + 0.0).alias("mean"), F.round(F.stddev_pop(x), 5).alias("std"))


@query("one_hot", f"""+{SPLIT}, mo AS (SELECT segment AS mode FROM split WHERE split = 'train' AND segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)
SELECT coalesce(segment, mode) AS value, split, count(*) AS n FROM split, mo GROUP BY 1, 2""", "trial")
def one_hot(spark, d):
    fitted_on = splits.stratified_split(trial(spark, d), 7)
    rows, fitted = prepare.prepare(fitted_on, [], ["segment"], ["epk_id", "split"])
    values = fitted.categories["segment"][1]
    long = rows.select("split", F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(f"segment_{v}").alias("on")) for v in values))).alias("x"))
    return long.filter(F.col("x.on") == 1).groupBy(F.col("x.value").alias("value"), "split").agg(F.count(F.lit(1)).alias("n"))


@query("freq_ordinal", "SELECT value, n, CAST(row_number() OVER (ORDER BY n DESC, value) - 1 AS INT) AS ordinal FROM (SELECT coalesce(segment, '__missing__') AS value, count(*) AS n FROM trial GROUP BY 1)", "trial")
def freq_ordinal(spark, d):
    return prepare.frequency_ordinal(trial(spark, d), "segment")


# ---- curves and metrics

@query("qini_curve", CUMULATIVE.rstrip().rstrip(",") + " SELECT model, CAST(x AS BIGINT) AS x, round(qini, 6) AS gain FROM points", "scored")
def qini_curve(spark, d):
    return rounded(curves.curve(scored(spark, d), ["model"], "qini"), 6)


@query("uplift_curve", CUMULATIVE.rstrip().rstrip(",") + " SELECT model, CAST(x AS BIGINT) AS x, round(uplift, 6) AS gain FROM points", "scored")
def uplift_curve(spark, d):
    return rounded(curves.curve(scored(spark, d), ["model"], "uplift"), 6)


@query("qini_area", CUMULATIVE.rstrip().rstrip(",") + " SELECT model, round(qa, 3) AS qini_area, round(ua, 3) AS uplift_area FROM area", "scored")
def qini_area(spark, d):
    return rounded(curves.areas(scored(spark, d), ["model"]), 3)


@query("perfect_qini_area", METRICS + " SELECT model, round(pq.qa, 3) AS perfect_qini, round(pu.ua, 3) AS perfect_uplift FROM pq JOIN pu USING (model)", "scored")
def perfect_qini_area(spark, d):
    return curves.classes(scored(spark, d), ["model"]).select("model", F.round(curves.perfect_qini_area(), 3).alias("perfect_qini"), F.round(curves.perfect_uplift_area(), 3).alias("perfect_uplift"))


def _metric(name: str) -> None:
    @query(name, METRICS + f" SELECT model, {name} FROM metrics", "scored")
    def run(spark, d):
        return rounded(curves.ranking_metrics(scored(spark, d), ["model"])).select("model", name)


for _name in ("qini_auc_normalized", "qini_coefficient", "uplift_auc_normalized", "auuc"):
    _metric(_name)


@query("uplift_at_10", METRICS + " SELECT model, uplift_at_10pct AS uplift FROM at10", "scored")
def uplift_at_10(spark, d):
    return rounded(curves.uplift_at(scored(spark, d), ["model"], 0.1))


@query("uplift_at_20", METRICS + " SELECT model, uplift_at_20pct AS uplift FROM at20", "scored")
def uplift_at_20(spark, d):
    return rounded(curves.uplift_at(scored(spark, d), ["model"], 0.2))


@query("cate_moments", METRICS + " SELECT * FROM moments", "scored")
def cate_moments(spark, d):
    return rounded(curves.moments(scored(spark, d), ["model"]))


@query("evaluate_uplift", METRICS + " SELECT * FROM metrics JOIN at10 USING (model) JOIN at20 USING (model) JOIN moments USING (model)", "scored")
def evaluate_uplift(spark, d):
    return rounded(curves.evaluate_uplift(scored(spark, d), ["model"]))


@query("average_rank", """SELECT model, round(score, 8) AS score, round(min(r) + (count(*) - 1) / 2.0, 4) AS rank, round((min(r) + (count(*) - 1) / 2.0 - 1) / greatest(1, max(n) - 1), 8) AS unit_rank
FROM (SELECT model, score, rank() OVER (PARTITION BY model ORDER BY score) AS r, count(*) OVER (PARTITION BY model) AS n FROM scored) GROUP BY model, score""", "scored")
def average_rank(spark, d):
    return rounded(curves.average_ranks(scored(spark, d), ["model"]))


# ---- resampling and diagnostics

RISK = "risk AS (SELECT *, floor(price / 5000)::DOUBLE AS risk FROM trial)"
ACCEPT = RISK + ", acc AS (SELECT *, exp(-4.0::DOUBLE * (r + (c - 1) / 2.0 - 1) / (n - 1)) AS accept FROM (SELECT *, rank() OVER (ORDER BY risk) AS r, count(*) OVER (PARTITION BY risk) AS c, count(*) OVER () AS n FROM risk))"


def risky(spark, d):
    return trial(spark, d).withColumn("risk", F.floor(F.col("price") / 5000).cast("double"))


@query("accept_prob_conversion", f"+{ACCEPT} SELECT epk_id, round(accept, 8) AS accept FROM acc", "trial")
def accept_prob_conversion(spark, d):
    return resample.accept_probability(risky(spark, d), "risk", 4.0).select("epk_id", F.round("accept", 8).alias("accept"))


@query("covariate_selection", f"+{ACCEPT} SELECT epk_id FROM acc WHERE {sql_u('epk_id', 'conv')} < accept", "trial")
def covariate_selection(spark, d):
    return resample.conversion(risky(spark, d), "risk", 4.0, "conv").select("epk_id")


@query("rejection_sample", f"""+ star AS (SELECT *, 0.3 + 0.4 * (nation % 5) / 5.0 AS s FROM trial), ratio AS (SELECT *, CASE WHEN t = 1 THEN s / p ELSE (1 - s) / (1 - p) END AS r FROM star, (SELECT avg(t) AS p FROM trial))
SELECT epk_id FROM ratio WHERE {sql_u("epk_id", "rej")} < r / (SELECT max(r) FROM ratio)""", "trial")
def rejection_sample(spark, d):
    return resample.rejection_sample(trial(spark, d), 0.3 + 0.4 * (F.col("nation") % 5) / 5.0, "rej").select("epk_id")


@query("control_share", f"""+ ratio AS (SELECT *, CASE WHEN t = 1 THEN 0.9::DOUBLE / p ELSE (1 - 0.9::DOUBLE) / (1 - p) END AS r FROM trial, (SELECT avg(t) AS p FROM trial))
SELECT epk_id, t FROM ratio WHERE {sql_u("epk_id", "share")} < r / (SELECT max(r) FROM ratio)""", "trial")
def control_share(spark, d):
    return resample.control_share(trial(spark, d), 0.9, "share").select("epk_id", "t")


@query("uniform_subsample", f"SELECT epk_id FROM trial ORDER BY {sql_u('epk_id', 'sub')}, epk_id LIMIT 2000", "trial")
def uniform_subsample(spark, d):
    return resample.subsample(trial(spark, d), 2000, "sub").select("epk_id")


@query("equalize_rows", f"""+{SPLIT} SELECT split, epk_id FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY CASE split WHEN 'train' THEN {sql_u("epk_id", "eq/train")} WHEN 'test' THEN {sql_u("epk_id", "eq/test")} ELSE {sql_u("epk_id", "eq/validation")} END, epk_id) AS k FROM split)
WHERE k <= CASE split WHEN 'train' THEN 1500 ELSE 500 END""", "trial")
def equalize_rows(spark, d):
    return resample.equalize(splits.stratified_split(trial(spark, d), 7), 1500, "eq")[0].select("split", "epk_id")


@query("resample_audit", f"""+{ACCEPT}, kept AS (SELECT * FROM acc WHERE {sql_u("epk_id", "conv")} < accept)
SELECT 'conversion' AS rule, b.n AS n_before, round(b.t, 8) AS treatment_rate_before, round(b.y, 8) AS outcome_rate_before, a.n AS n_after, round(a.t, 8) AS treatment_rate_after, round(a.y, 8) AS outcome_rate_after, round(a.n / b.n, 8) AS acceptance_rate
FROM (SELECT count(*) AS n, avg(t) AS t, avg(y) AS y FROM acc) b, (SELECT count(*) AS n, avg(t) AS t, avg(y) AS y FROM kept) a""", "trial")
def resample_audit(spark, d):
    rows = risky(spark, d)
    return rounded(resample.audit(rows, resample.conversion(rows, "risk", 4.0, "conv"), "conversion"))


COVARIATES = ["price", "balance", "nation", "order_month"]
CORR = "+ c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, corr({c}, y) AS r, count(*) AS n FROM trial" for c in COVARIATES) + ")"


@query("point_biserial", CORR + " SELECT name, round(coalesce(r, 0), 8) AS r FROM c", "trial")
def point_biserial(spark, d):
    return rounded(diagnostics.point_biserial(trial(spark, d), COVARIATES)).select("name", "r")


@query("top_covariates", CORR + " SELECT name, round(r, 8) AS r FROM c ORDER BY abs(r) DESC, name LIMIT 2", "trial")
def top_covariates(spark, d):
    return rounded(diagnostics.top_covariates(diagnostics.point_biserial(trial(spark, d), COVARIATES), 2)).select("name", "r")


@query("benjamini_hochberg", f"""+ h AS (SELECT nation, power({sql_u("nation", "bh")}, 6) AS p FROM (SELECT DISTINCT nation FROM trial)), k AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM h)
SELECT nation, round(p, 9) AS p, i <= coalesce((SELECT max(i) FROM k WHERE p <= 0.05 * i / n), 0) AS rejected FROM k""", "trial")
def benjamini_hochberg(spark, d):
    tests = trial(spark, d).select("nation").distinct().withColumn("p", F.pow(fn.uniform("nation", "bh"), F.lit(6)))
    return rounded(diagnostics.benjamini_hochberg(tests), 9)


# ---- bootstrap and comparison tables

@query("bootstrap_draw_weights", f"""+ n AS (SELECT count(*) AS n FROM trial) SELECT CAST(i // n AS INT) AS b, CAST(floor({sql_u("i", "boot11")} * n) AS BIGINT) AS idx, count(*) AS w FROM n, range((SELECT 20 * count(*) FROM trial)) AS r(i) GROUP BY 1, 2""", "trial")
def bootstrap_draw_weights(spark, d):
    return bootstrap.draw_weights(spark, trial(spark, d).count(), 20, 11)


@query("bootstrap_ate", f"""+ ids AS (SELECT *, row_number() OVER (ORDER BY epk_id) - 1 AS idx FROM trial), n AS (SELECT count(*) AS n FROM trial),
w AS (SELECT CAST(i // n AS INT) AS b, CAST(floor({sql_u("i", "boot11")} * n) AS BIGINT) AS idx, count(*) AS w FROM n, range((SELECT 10 * count(*) FROM trial)) AS r(i) GROUP BY 1, 2)
SELECT model, b, round(sum(w * s.t * s.y)::DOUBLE / sum(w * s.t) - sum(w * (1 - s.t) * s.y)::DOUBLE / sum(w * (1 - s.t)), 8) AS ate FROM w JOIN ids USING (idx) JOIN scored s USING (epk_id) GROUP BY model, b""", "scored")
def bootstrap_ate(spark, d):
    return rounded(bootstrap.ate_draws(scored(spark, d), ["model"], 10, 11))


DRAWN = f"""+ ids AS (SELECT epk_id, row_number() OVER (ORDER BY epk_id) - 1 AS idx FROM trial), n AS (SELECT count(*) AS n FROM trial),
w AS (SELECT CAST(i // n AS INT) AS b, CAST(floor({sql_u("i", "boot11")} * n) AS BIGINT) AS idx, count(*) AS w FROM n, range((SELECT DRAWS * count(*) FROM trial)) AS r(i) GROUP BY 1, 2),
rows AS (SELECT b, model, epk_id, t, y, score, w FROM w JOIN ids USING (idx) JOIN scored USING (epk_id)),
counts AS (SELECT model, b, score, sum(w * t) AS nt, sum(w * (1 - t)) AS nc, sum(w * y * t) AS yt, sum(w * y * (1 - t)) AS yc FROM rows GROUP BY model, b, score),
sums AS (SELECT *, sum(nt) OVER k AS cnt, sum(nc) OVER k AS cnc, sum(yt) OVER k AS cyt, sum(yc) OVER k AS cyc FROM counts WINDOW k AS (PARTITION BY model, b ORDER BY score DESC)),
points AS (SELECT model, b, cnt + cnc AS x, CASE WHEN cnc > 0 THEN cyt - cyc::DOUBLE * cnt / cnc ELSE 0.0 END AS q,
    (CASE WHEN cnt > 0 THEN cyt::DOUBLE / cnt ELSE 0 END - CASE WHEN cnc > 0 THEN cyc::DOUBLE / cnc ELSE 0 END) * (cnt + cnc) AS u FROM sums UNION ALL SELECT DISTINCT model, b, 0, 0.0, 0.0 FROM counts),
area AS (SELECT model, b, sum((x - x0) * (q + q0) / 2) AS qa, sum((x - x0) * (u + u0) / 2) AS ua FROM (SELECT *, lag(x) OVER k AS x0, lag(q) OVER k AS q0, lag(u) OVER k AS u0 FROM points WINDOW k AS (PARTITION BY model, b ORDER BY x)) GROUP BY model, b),
cls AS (SELECT model, b, sum(yt)::DOUBLE AS tr, sum(nt - yt)::DOUBLE AS tn, sum(yc)::DOUBLE AS cr, sum(nc - yc)::DOUBLE AS cn, sum(nt + nc)::DOUBLE AS n FROM counts GROUP BY model, b),
ends AS (SELECT *, tr - cr * (tr + tn) / (cr + cn) AS e, CASE WHEN cn > 0 THEN tr ELSE 0.0 END AS m FROM cls)"""


@query("bootstrap_qini", DRAWN.replace("DRAWS", "20") + """
SELECT model, b, round((qa - n * e / 2) / ((tn + cn) * m / 2 + cr * (m + e) / 2 - n * e / 2), 8) AS qini_auc_normalized, round((qa - n * e / 2) / (n * n), 8) AS qini_coefficient,
  round(ua / (n * n), 8) AS auuc, round(tr / (tr + tn) - cr / (cr + cn), 8) AS ate FROM area JOIN ends USING (model, b)""", "scored")
def bootstrap_qini(spark, d):
    return rounded(bootstrap.metric_draws(scored(spark, d), ["model"], 20, 11))


@query("bootstrap_qini_split")
def bootstrap_qini_split(spark, d):
    return rounded(bootstrap.metric_draws(scored(spark, d), ["model"], 20, 11, tops=True, picks="split"))


@query("split_draw_totals", "SELECT b, CAST(count(*) AS BIGINT) AS total FROM trial, (SELECT CAST(unnest(range(20)) AS INT) AS b) GROUP BY b", "trial")
def split_draw_totals(spark, d):
    rows = splits.numbered(trial(spark, d).select("epk_id"))
    return bootstrap.with_split_weights(rows, F.lit(rows.count()), 20, 11).groupBy("b").agg(F.sum("w").alias("total"))


@query("bootstrap_uplift_at_k", DRAWN.replace("DRAWS", "5") + """, one AS (SELECT *, row_number() OVER (PARTITION BY model, b ORDER BY score DESC, epk_id, i) AS k, count(*) OVER (PARTITION BY model, b) AS size FROM (SELECT *, unnest(range(w)) AS i FROM rows))
SELECT model, b, round(avg(y) FILTER (WHERE t = 1 AND k <= greatest(1, floor(size * 0.1::DOUBLE))) - avg(y) FILTER (WHERE t = 0 AND k <= greatest(1, floor(size * 0.1::DOUBLE))), 8) AS uplift_at_10pct,
  round(avg(y) FILTER (WHERE t = 1 AND k <= greatest(1, floor(size * 0.2::DOUBLE))) - avg(y) FILTER (WHERE t = 0 AND k <= greatest(1, floor(size * 0.2::DOUBLE))), 8) AS uplift_at_20pct FROM one GROUP BY model, b""", "scored")
def bootstrap_uplift_at_k(spark, d):
    return rounded(bootstrap.metric_draws(scored(spark, d), ["model"], 5, 11, tops=True)).select("model", "b", *bootstrap.TOPS)


@query("percentile_interval", "SELECT axis, model, round(quantile_cont(value, 0.025), 8) AS ci_low, round(quantile_cont(value, 0.975), 8) AS ci_high, count(value) AS n_draws FROM draws GROUP BY axis, model", "draws")
def percentile_interval(spark, d):
    return rounded(draws(spark, d).groupBy("axis", "model").agg(*bootstrap.interval(F.col("value"))))


POOLED = "pooled AS (SELECT dataset, axis, severity_tag, model, metric, count(DISTINCT seed) AS n_seeds, avg(value) AS mean, quantile_cont(value, 0.025) AS ci_low, quantile_cont(value, 0.975) AS ci_high, count(value) AS n_draws FROM draws GROUP BY ALL)"
BEST = POOLED + ", best AS (SELECT dataset, axis, severity_tag, metric, model AS best FROM (SELECT *, row_number() OVER (PARTITION BY dataset, axis, severity_tag, metric ORDER BY mean DESC, model) AS k FROM pooled WHERE split_part(model, '#', 1) <> 'dr_learner') WHERE k = 1)"
PAIRED = BEST + """, diff AS (SELECT o.dataset, o.axis, o.severity_tag, o.metric, o.model, r.value - o.value AS v FROM draws o JOIN draws r USING (dataset, axis, severity_tag, seed, metric, b) WHERE r.model = 'dr_learner' AND split_part(o.model, '#', 1) <> 'dr_learner'),
each AS (SELECT dataset, axis, severity_tag, metric, model, avg(v) AS mean_difference, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high, count(v) AS n_draws FROM diff GROUP BY ALL),
paired AS (SELECT dataset, axis, severity_tag, metric, 'dr_learner' AS reference, comparison, model AS comparison_model, mean_difference, ci_low, ci_high, n_draws, ci_low > 0 OR ci_high < 0 AS excludes_zero
  FROM (SELECT *, model AS comparison FROM each UNION ALL SELECT each.*, 'best_alternative' FROM each JOIN best USING (dataset, axis, severity_tag, metric) WHERE model = best))"""


@query("pool_draws", f"+{POOLED} SELECT dataset, axis, severity_tag, model, metric, n_seeds, round(mean, 7) AS mean, round(ci_low, 7) AS ci_low, round(ci_high, 7) AS ci_high, n_draws FROM pooled", "draws")
def pool_draws(spark, d):
    return rounded(bootstrap.pooled(draws(spark, d)), 7)


@query("best_alternative", f"+{BEST} SELECT * FROM best", "draws")
def best_alternative(spark, d):
    return bootstrap.best_alternative(bootstrap.pooled(draws(spark, d)), "dr_learner")


@query("paired_difference", f"+{PAIRED} SELECT dataset, axis, severity_tag, metric, reference, comparison, comparison_model, round(mean_difference, 7) AS mean_difference, round(ci_low, 7) AS ci_low, round(ci_high, 7) AS ci_high, n_draws, excludes_zero FROM paired", "draws")
def paired_difference(spark, d):
    return rounded(bootstrap.paired(draws(spark, d), "dr_learner"), 7)


@query("model_alignment", "SELECT epk_id FROM scored WHERE NOT (model = 'fine' AND epk_id % 7 = 0) GROUP BY epk_id HAVING count(*) <> 3", "scored")
def model_alignment(spark, d):
    return bootstrap.aligned(scored(spark, d).filter("NOT (model = 'fine' AND epk_id % 7 = 0)"))


# ---- regimes

BREAKS = PAIRED + """, sev AS (SELECT axis, severity_tag, min(severity) AS severity FROM runs GROUP BY ALL),
placed AS (SELECT paired.*, severity, CASE WHEN severity IS NULL THEN CAST('-inf' AS DOUBLE) WHEN axis = 'scale' THEN -severity ELSE severity END AS place FROM paired LEFT JOIN sev USING (axis, severity_tag) WHERE comparison = 'best_alternative'),
losing AS (SELECT *, row_number() OVER (PARTITION BY dataset, axis, metric ORDER BY place) AS k FROM placed WHERE excludes_zero AND mean_difference < 0),
worst AS (SELECT dataset, axis, metric, count(*) AS n_severities, min(mean_difference) AS worst_difference, min_by(severity_tag, mean_difference) AS worst_severity_tag FROM placed GROUP BY ALL),
breaks AS (SELECT w.dataset, w.axis, w.metric, n_severities, l.k IS NOT NULL AS breaks, l.severity_tag AS breakpoint_severity_tag, l.severity AS breakpoint_severity, l.mean_difference AS difference_at_breakpoint, worst_difference, worst_severity_tag
  FROM worst w LEFT JOIN losing l ON l.dataset = w.dataset AND l.axis = w.axis AND l.metric = w.metric AND l.k = 1)"""


def found_breaks(spark, d):
    return regimes.breakpoints(bootstrap.paired(draws(spark, d), "dr_learner"), runs(spark, d))


@query("breakpoints", f"+{BREAKS} SELECT dataset, axis, metric, n_severities, breaks, breakpoint_severity_tag, breakpoint_severity, round(difference_at_breakpoint, 7) AS difference_at_breakpoint, round(worst_difference, 7) AS worst_difference, worst_severity_tag FROM breaks", "draws")
def breakpoints(spark, d):
    return rounded(found_breaks(spark, d).drop("ci_at_breakpoint"), 7)


@query("robustness_index", f"""+{BREAKS}, grid AS (SELECT axis, severity_tag, CAST(row_number() OVER (PARTITION BY axis ORDER BY CASE WHEN severity IS NULL THEN CAST('-inf' AS DOUBLE) WHEN axis = 'scale' THEN -severity ELSE severity END, severity_tag) - 1 AS BIGINT) AS nth, count(*) OVER (PARTITION BY axis) AS size FROM sev)
SELECT b.dataset, b.axis, b.breaks, coalesce(g.nth, (SELECT max(size) FROM grid WHERE grid.axis = b.axis)) AS robustness_index FROM breaks b LEFT JOIN grid g ON g.axis = b.axis AND g.severity_tag = b.breakpoint_severity_tag""", "draws")
def robustness_index(spark, d):
    return regimes.robustness_index(found_breaks(spark, d), runs(spark, d)).select("dataset", "axis", "breaks", F.col("robustness_index").cast("long").alias("robustness_index"))


@query("severity_order", "SELECT DISTINCT axis, severity_tag, CASE WHEN severity IS NULL THEN CAST('-inf' AS DOUBLE) WHEN axis = 'scale' THEN -severity ELSE severity END AS place FROM runs", "runs")
def severity_order(spark, d):
    return runs(spark, d).select("axis", "severity_tag", resample.severity_order(F.col("axis"), F.col("severity")).alias("place")).distinct()


@query("series_split", "SELECT model, split_part(model, '#', 1) AS base_model, CASE WHEN contains(model, '#') THEN split_part(model, '#', 2) ELSE 'default' END AS hparam_tag, count(*) AS n FROM runs GROUP BY 1, 2, 3", "runs")
def series_split(spark, d):
    return regimes.with_series(runs(spark, d)).groupBy("model", "base_model", "hparam_tag").agg(F.count(F.lit(1)).alias("n"))


@query("variant_families", "SELECT split_part(model, '#', 1) AS base_model, count(DISTINCT model) AS members FROM runs GROUP BY 1 HAVING count(DISTINCT model) > 1", "runs")
def variant_families(spark, d):
    return regimes.variant_families(regimes.with_series(runs(spark, d))).select("base_model", F.size("series").cast("long").alias("members"))


@query("breakpoint_shift", """+ idx AS (SELECT dataset, axis, split_part(model, '#', 1) AS base_model, CASE WHEN contains(model, '#') THEN split_part(model, '#', 2) ELSE 'default' END AS tag, CAST(count(*) FILTER (WHERE qini > 0) AS BIGINT) AS i FROM runs WHERE status = 'ok' GROUP BY ALL)
SELECT v.dataset, v.axis, v.base_model, v.tag AS hparam_tag, v.i - d.i AS breakpoint_shift_steps, v.i > d.i AS more_robust_than_default, v.i < d.i AS more_fragile_than_default FROM idx v JOIN idx d ON d.dataset = v.dataset AND d.axis = v.axis AND d.base_model = v.base_model AND d.tag = 'default' WHERE v.tag <> 'default'""", "runs")
def breakpoint_shift(spark, d):
    rows = regimes.with_series(runs(spark, d).filter("status = 'ok'"))
    n = F.count_if(F.col("qini") > 0)
    indexed = rows.groupBy("dataset", "axis", "base_model", "hparam_tag").agg(n.alias("robustness_index"), (n > 0).alias("breaks"), F.lit(None).cast("string").alias("breakpoint_severity_tag"), F.lit(None).cast("double").alias("hparam_value"))
    return regimes.breakpoint_shift(indexed).select("dataset", "axis", "base_model", "hparam_tag", "breakpoint_shift_steps", "more_robust_than_default", "more_fragile_than_default")


@query("pehe", "SELECT model, round(sqrt(avg((score - tau) * (score - tau))), 7) AS pehe, round(abs(avg(score) - avg(tau)), 7) AS abs_ate_error FROM truth GROUP BY model", "truth")
def pehe(spark, d):
    return rounded(regimes.effect_error(truth(spark, d), ["model"]), 7)


@query("pehe_table", """SELECT dataset, axis, severity_tag, model, round(avg(pehe), 7) AS pehe_mean, round(stddev_samp(pehe), 7) AS pehe_std, count(pehe) AS pehe_count, round(avg(qini), 7) AS qini_mean, round(avg(abs_ate_error), 7) AS abs_ate_error_mean
FROM runs WHERE status = 'ok' AND isfinite(pehe) GROUP BY ALL""", "runs")
def pehe_table(spark, d):
    return rounded(regimes.effect_table(runs(spark, d)), 7)


@query("spearman_rank", """+ RECURSIVE et AS (SELECT dataset, axis, severity_tag, model, avg(abs(qini - 0.01)) AS p, avg(qini) AS q FROM runs WHERE status = 'ok' AND isfinite(qini) GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY dataset, axis, severity_tag ORDER BY -p) + (count(*) OVER (PARTITION BY dataset, axis, severity_tag, p) - 1) / 2.0::DOUBLE AS rp, rank() OVER (PARTITION BY dataset, axis, severity_tag ORDER BY q) + (count(*) OVER (PARTITION BY dataset, axis, severity_tag, q) - 1) / 2.0::DOUBLE AS rq FROM et),
cells AS (SELECT dataset, axis, severity_tag, CAST(count(*) AS INT) AS n, corr(rp, rq) AS rho, corr(-p, q) AS v, list(rp ORDER BY model) AS x, list(rq ORDER BY model) AS y,
  string_agg(model, ' > ' ORDER BY p, model) AS pehe_order, string_agg(model, ' > ' ORDER BY -q, model) AS qini_order FROM r GROUP BY ALL HAVING count(*) >= 3),
orders AS (SELECT dataset, axis, severity_tag, n, []::INT[] AS o FROM cells UNION ALL
  SELECT dataset, axis, severity_tag, n, list_append(o, i) FROM orders, range(1, 9) AS s(i) WHERE len(o) < n AND i <= n AND NOT list_contains(o, i)),
picked AS (SELECT o.dataset, o.axis, o.severity_tag, row_number() OVER () AS k, rho, x, list_transform(o.o, lambda i: y[i]) AS y FROM orders o JOIN cells c ON c.dataset = o.dataset AND c.axis = o.axis AND c.severity_tag = o.severity_tag WHERE len(o.o) = o.n),
flat AS (SELECT dataset, axis, severity_tag, k, rho, unnest(x) AS a, unnest(y) AS b FROM picked), each AS (SELECT dataset, axis, severity_tag, k, abs(corr(a, b)) >= abs(any_value(rho)) - 1e-12 AS hit FROM flat GROUP BY ALL),
ps AS (SELECT dataset, axis, severity_tag, avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END) AS p_value FROM each GROUP BY ALL)
SELECT c.dataset, c.axis, c.severity_tag, n AS n_methods, round(rho, 6) + 0.0 AS spearman_rho, round(p_value, 6) AS p_value, round(v, 6) + 0.0 AS value_correlation, pehe_order, qini_order FROM cells c LEFT JOIN ps USING (dataset, axis, severity_tag)""", "runs")
def spearman_rank(spark, d):
    scored_runs = runs(spark, d).withColumn("pehe", F.abs(F.col("qini") - 0.01))
    found = regimes.rank_agreement(regimes.effect_table(scored_runs))
    return found.select("dataset", "axis", "severity_tag", "n_methods", (F.round("spearman_rho", 6) + 0.0).alias("spearman_rho"), F.round("p_value", 6).alias("p_value"), (F.round("value_correlation", 6) + 0.0).alias("value_correlation"), "pehe_order", "qini_order")


# ---- trials and sweeps

@query("seed_summary", """SELECT dataset, axis, model, count(qini) AS qini_n, round(avg(qini), 7) AS qini_mean, round(coalesce(stddev_samp(qini), 0), 7) AS qini_std, round(1.96 * coalesce(stddev_samp(qini), 0) / sqrt(count(qini)), 7) AS qini_ci95
FROM runs GROUP BY dataset, axis, model""", "runs")
def seed_summary(spark, d):
    return rounded(trials.seed_summary(runs(spark, d), ["dataset", "axis", "model"], ["qini"]), 7)


def trial_rows(spark, d):
    return runs(spark, d).select("model", (F.col("seed") * 10 + F.length("severity_tag")).alias("trial"), "status", F.round("qini", 2).alias("objective"), F.col("pehe").alias("uplift_at_10pct"), F.col("n_rows").cast("double").alias("fit_seconds"), "severity_tag", F.when(F.col("axis") == "scale", 0).otherwise(1).alias("source_order"))


TRIALS = "tr AS (SELECT model, seed * 10 + length(severity_tag) AS trial, status, round(qini, 2) AS objective, pehe AS uplift_at_10pct, n_rows::DOUBLE AS fit_seconds, severity_tag, CASE WHEN axis = 'scale' THEN 0 ELSE 1 END AS source_order FROM runs)"


@query("best_trial", f"+{TRIALS} SELECT model, objective, uplift_at_10pct FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY objective DESC, uplift_at_10pct DESC, fit_seconds, trial) AS k FROM tr WHERE status = 'ok') WHERE k = 1", "runs")
def best_trial(spark, d):
    return trials.best_trials(trial_rows(spark, d)).select("model", "objective", "uplift_at_10pct")


@query("priority_dedupe", f"+{TRIALS} SELECT model, CAST(trial AS INT) AS trial, status, source_order FROM (SELECT *, row_number() OVER (PARTITION BY model, trial ORDER BY CASE WHEN status = 'ok' THEN 0 ELSE 1 END, source_order) AS k FROM tr) WHERE k = 1", "runs")
def priority_dedupe(spark, d):
    return trials.merge_trials(trial_rows(spark, d)).select("model", F.col("trial").cast("int").alias("trial"), "status", "source_order")


@query("trial_audit", f"+{TRIALS} SELECT model, 20 AS target, count(DISTINCT trial) AS attempted, count(DISTINCT CASE WHEN status = 'ok' THEN trial END) AS ok, count(DISTINCT trial) >= 20 AS complete, count(*) FILTER (WHERE status = 'ok') > 0 AS available FROM tr GROUP BY model", "runs")
def trial_audit(spark, d):
    return trials.trial_audit(trial_rows(spark, d), 20)


@query("missing_trials", f"+{TRIALS} SELECT m.model, CAST(i AS INT) AS trial FROM (SELECT DISTINCT model FROM tr) m, range(60) AS r(i) WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.model = m.model AND tr.trial = i AND status = 'ok')", "runs")
def missing_trials(spark, d):
    rows = trial_rows(spark, d)
    return trials.missing_trials(rows, rows, 60)


@query("reuse_filter", "SELECT model, 'scale' AS axis, 'scale_full' AS severity_tag, seed, qini, severity_tag AS reused_from FROM runs WHERE model IN ('t_learner', 'x_learner')", "runs")
def reuse_filter(spark, d):
    return trials.reusable(runs(spark, d).withColumn("source", F.col("severity_tag")), ["t_learner", "x_learner"], "scale", "scale_full").select("model", "axis", "severity_tag", "seed", "qini", "reused_from")


@query("metrics_union", "SELECT model, seed, qini, NULL::DOUBLE AS pehe FROM runs UNION ALL SELECT model, seed, NULL, pehe FROM runs", "runs")
def metrics_union(spark, d):
    rows = runs(spark, d)
    return trials.union(rows.select("model", "seed", "qini"), rows.select("model", "seed", "pehe"))


@query("keep_first", "SELECT axis, severity_tag, severity FROM (SELECT *, row_number() OVER (PARTITION BY axis, severity_tag ORDER BY seed, model) AS k FROM runs) WHERE k = 1", "runs")
def keep_first(spark, d):
    return trials.first_of(runs(spark, d), ["axis", "severity_tag"], ["seed", "model"]).select("axis", "severity_tag", "severity")


@query("take_positions", "SELECT epk_id, t, y FROM (SELECT *, row_number() OVER (ORDER BY epk_id) - 1 AS idx FROM trial) WHERE idx % 7 = 3", "trial")
def take_positions(spark, d):
    rows = trial(spark, d)
    return splits.taken(rows.select("epk_id", "t", "y"), spark.range(3, rows.count(), 7).withColumnRenamed("id", "idx"))


@query("strided_partition", "SELECT epk_id, CAST((row_number() OVER (ORDER BY epk_id) - 1) % 4 AS BIGINT) AS slot FROM trial", "trial")
def strided_partition(spark, d):
    return splits.strided(trial(spark, d).select("epk_id"), "epk_id", 4).select("epk_id", F.col("slot").cast("long").alias("slot"))


@query("group_exact_split", f"""+{GROUPS}, gs AS (SELECT g, row_number() OVER (ORDER BY {sql_u('g', 'group7')}, g) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM grp))
SELECT epk_id, CASE WHEN k <= floor(n * 0.2::DOUBLE + 0.5) THEN 'test' WHEN k <= floor(n * 0.2::DOUBLE + 0.5) + floor(n * 0.2::DOUBLE + 0.5) THEN 'validation' ELSE 'train' END AS split FROM grp JOIN gs USING (g)""", "trial")
def group_exact_split(spark, d):
    rows = trial(spark, d).withColumn("g", splits.group_key("priority", "segment", "nation", "order_month"))
    return splits.group_exact_split(rows, "g", 7).select("epk_id", "split")


@query("row_differences", "SELECT coalesce(a.epk_id, b.epk_id) AS epk_id, a.epk_id IS NOT NULL AS in_a, b.epk_id IS NOT NULL AS in_b FROM (SELECT epk_id FROM trial WHERE epk_id % 3 <> 0) a FULL JOIN (SELECT epk_id FROM trial WHERE epk_id % 5 <> 0) b ON a.epk_id = b.epk_id WHERE a.epk_id IS NULL OR b.epk_id IS NULL", "trial")
def row_differences(spark, d):
    rows = trial(spark, d)
    return trials.row_differences(rows.filter("epk_id % 3 <> 0"), rows.filter("epk_id % 5 <> 0"))


VALUED = "valued AS (SELECT *, CASE WHEN contains(model, '#') AND seed > 0 THEN length(severity_tag) * 10.0 + seed END AS hparam_value FROM runs)"


@query("hparam_values", f"+{VALUED} SELECT model, hparam_value FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY dataset, axis, severity_tag, seed) AS k FROM valued WHERE hparam_value IS NOT NULL) WHERE k = 1", "runs")
def hparam_values(spark, d):
    value = F.when(F.col("model").contains("#") & (F.col("seed") > 0), F.length("severity_tag") * 10.0 + F.col("seed"))
    return regimes.hparam_values(runs(spark, d).withColumn("hparam_value", value))


def _of_series(series: str, k: int) -> str:
    """The CTEs of BREAKS for another reference series, their names numbered."""
    text = BREAKS.replace("'dr_learner'", f"'{series}'").replace(f"split_part(model, '#', 1) <> '{series}'", "split_part(model, '#', 1) <> 'dr_learner'").replace(f"split_part(o.model, '#', 1) <> '{series}'", "split_part(o.model, '#', 1) <> 'dr_learner'")
    for name in ("pooled", "best", "diff", "each", "paired", "sev", "placed", "losing", "worst", "breaks"):
        text = re.sub(rf"(?<![\w'.]){name}(?= AS \()|(?<=FROM ){name}\b|(?<=JOIN ){name}\b", f"{name}{k}", text)
    return text.replace("each.*", f"each{k}.*").replace("paired.*", f"paired{k}.*")


INFLUENCE = _of_series("dr_learner", 1) + ", " + _of_series("dr_learner#depth3", 2) + """, grid AS (SELECT axis, severity_tag, CAST(row_number() OVER (PARTITION BY axis ORDER BY CASE WHEN severity IS NULL THEN CAST('-inf' AS DOUBLE) WHEN axis = 'scale' THEN -severity ELSE severity END, severity_tag) - 1 AS BIGINT) AS nth, count(*) OVER (PARTITION BY axis) AS size FROM sev1),
ix AS (SELECT b.*, coalesce(g.nth, (SELECT max(size) FROM grid WHERE grid.axis = b.axis)) AS i FROM (SELECT 1 AS s, * FROM breaks1 UNION ALL SELECT 2, * FROM breaks2) b LEFT JOIN grid g ON g.axis = b.axis AND g.severity_tag = b.breakpoint_severity_tag)"""


@query("hparam_influence", f"+{INFLUENCE} SELECT v.dataset, v.axis, 'dr_learner' AS base_model, 'depth3' AS hparam_tag, v.breaks AS variant_breaks, v.breakpoint_severity_tag AS variant_breakpoint, d.breaks AS default_breaks, d.breakpoint_severity_tag AS default_breakpoint, v.i - d.i AS breakpoint_shift_steps FROM ix v JOIN ix d ON d.dataset = v.dataset AND d.axis = v.axis AND d.metric = v.metric AND d.s = 1 WHERE v.s = 2", "draws")
def hparam_influence(spark, d):
    shifts = regimes.hparam_influence(draws(spark, d), runs(spark, d))[1]
    return shifts.select("dataset", "axis", "base_model", "hparam_tag", "variant_breaks", "variant_breakpoint", "default_breaks", "default_breakpoint", F.col("breakpoint_shift_steps").cast("long").alias("breakpoint_shift_steps"))


@query("regime_map", f"+{BREAKS} SELECT p.dataset, p.metric, p.axis, p.severity_tag, CASE WHEN excludes_zero AND p.mean_difference > 0 THEN 'wins' WHEN excludes_zero THEN 'loses' ELSE 'ties' END AS outcome, round(p.mean_difference, 7) AS mean_difference, coalesce(b.breakpoint_severity_tag = p.severity_tag, false) AS is_breakpoint FROM paired p LEFT JOIN breaks b USING (dataset, axis, metric) WHERE comparison = 'best_alternative'", "draws")
def regime_map(spark, d):
    return rounded(regimes.regime_map(found_breaks(spark, d), bootstrap.paired(draws(spark, d), "dr_learner")), 7)


@query("pseudo_spreads", "SELECT 'pseudo' AS name, round(min(p), 8) AS least, round(max(p), 8) AS most, round(avg(p), 7) AS mean, round(stddev_pop(p), 7) AS std FROM (SELECT (0.35 - 0.3) + t * (y - 0.35) / 0.5 - (1 - t) * (y - 0.3) / 0.5 AS p FROM trial)", "trial")
def pseudo_spreads(spark, d):
    rows = trial(spark, d).select(fn.aipw(F.lit(0.3), F.lit(0.35), F.lit(0.5), F.col("t"), F.col("y")).alias("pseudo"))
    return rounded(rounded(diagnostics.spreads(rows, ["pseudo"]), 8, ("mean", "std")), 7, ("least", "most"))


@query("natural_risk", "SELECT epk_id, CAST(o.k AS DOUBLE) AS risk FROM trial JOIN (SELECT value, row_number() OVER (ORDER BY n DESC, value) - 1 AS k FROM (SELECT coalesce(segment, '__missing__') AS value, count(*) AS n FROM trial GROUP BY 1)) o ON o.value = coalesce(segment, '__missing__')", "trial")
def natural_risk(spark, d):
    rows = trial(spark, d)
    return learners.with_natural_risk(rows, "segment", "risk").select("epk_id", "risk")


@query("ordered_runs", "SELECT model, seed, axis, row_number() OVER (ORDER BY CASE model WHEN 'x_learner' THEN 0 WHEN 't_learner' THEN 1 ELSE 2 END, model, seed, axis, severity_tag) AS place FROM runs", "runs")
def ordered_runs(spark, d):
    return splits.in_order(trials.ordered(runs(spark, d), {"model": ["x_learner", "t_learner"]}, "seed", "axis", "severity_tag"), "place").select("model", "seed", "axis", "place")


# ---- effect arithmetic

@query("dr_pseudo_outcome", "SELECT epk_id, round((0.35 - 0.3) + t * (y - 0.35) / 0.5 - (1 - t) * (y - 0.3) / 0.5, 8) AS pseudo FROM trial", "trial")
def dr_pseudo_outcome(spark, d):
    return trial(spark, d).select("epk_id", F.round(fn.aipw(F.lit(0.3), F.lit(0.35), F.lit(0.5), F.col("t"), F.col("y")), 8).alias("pseudo"))


@query("dr_outcome_signals", "SELECT epk_id, round(0.3 + (1 - t) * (y - 0.3) / 0.4, 8) AS signal0, round(0.35 + t * (y - 0.35) / 0.6, 8) AS signal1 FROM trial", "trial")
def dr_outcome_signals(spark, d):
    first, second = fn.aipw_outcomes(F.lit(0.3), F.lit(0.35), F.lit(0.6), F.col("t"), F.col("y"))
    return trial(spark, d).select("epk_id", F.round(first, 8).alias("signal0"), F.round(second, 8).alias("signal1"))


@query("lineitem_qini", f"""+ li AS (SELECT CAST({sql_u("l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber", "T")} < 0.5 AS INT) AS t, CAST(l_returnflag = 'R' AS INT) AS y, floor(l_extendedprice / 100)::DOUBLE AS score FROM lineitem),
s AS (SELECT *, sum(nt) OVER w AS cnt, sum(nc) OVER w AS cnc, sum(yt) OVER w AS cyt, sum(yc) OVER w AS cyc FROM (SELECT score, sum(t) AS nt, sum(1 - t) AS nc, sum(y * t) AS yt, sum(y * (1 - t)) AS yc FROM li GROUP BY score) WINDOW w AS (ORDER BY score DESC)),
p AS (SELECT cnt + cnc AS x, CASE WHEN cnc > 0 THEN cyt - cyc::DOUBLE * cnt / cnc ELSE 0.0 END AS g FROM s UNION ALL SELECT 0, 0.0)
SELECT 'lineitem' AS cell, round(sum((x - x0) * (g + g0) / 2), 2) AS qini_area FROM (SELECT *, lag(x) OVER (ORDER BY x) AS x0, lag(g) OVER (ORDER BY x) AS g0 FROM p)""", "trial")
def lineitem_qini(spark, d):
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    rows = table(spark, d, "lineitem").select(F.lit("lineitem").alias("cell"), (fn.uniform(key, "T") < 0.5).cast("int").alias("t"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.floor(F.col("l_extendedprice") / 100).cast("double").alias("score"))
    return curves.areas(rows, ["cell"]).select("cell", F.round("qini_area", 2).alias("qini_area"))


# ---- learners, on orders with a known effect; scores of the test split

def learner_cell(spark, d):
    rows = trial(spark, d).withColumn("balance", F.coalesce("balance", F.lit(0.0))).select("epk_id", (F.col("price") / 1e5).alias("price"), (F.col("balance") / 1e4).alias("balance"), F.col("order_month").cast("double").alias("order_month"))
    known = semisynth.generate(rows, ["price", "balance", "order_month"], semisynth.Spec(0.3, 0.15, 0.8, seed=2))
    return runs_of.prepare_cell(known, ["price", "balance", "order_month"], [], 2)


FEATURES = ["price", "balance", "order_month"]


def _learner(name: str, fit) -> None:
    @query(name)
    def run(spark, d):
        cell = learner_cell(spark, d)
        model = fit(cell.filter("split = 'train'"))
        return model.predict(cell.filter("split = 'test'")).select("epk_id", F.lit(model.name).alias("model"), F.round("cate", 6).alias("cate"), F.round("tau", 6).alias("tau"))


for _name, _fit in {
    "constant_ate": learners.constant_effect,
    "t_learner": learners.t_learner,
    "x_learner": learners.x_learner,
    "dr_learner": learners.dr_learner,
    "q_learner": learners.q_learner,
    "q_learner_ratio": lambda rows: learners.q_learner(rows, ratio=True),
    "residual_correction": lambda rows: learners.residual_correction(rows, lambda some: kernels.neighbour_stand_in(some, FEATURES)),
    "gp_cate": lambda rows: kernels.gp_cate(rows, FEATURES),
    "dragonnet": lambda rows: kernels.dragonnet(rows, FEATURES),
    "x_over_stand_in": lambda rows: kernels.x_over_stand_in(rows, FEATURES),
    "neighbour_stand_in": lambda rows: kernels.neighbour_stand_in(rows, FEATURES),
    "tuned_stand_in": lambda rows: heads.tuned_stand_in(rows, FEATURES),
}.items():
    _learner(_name, _fit)


@query("overlap_summary")
def overlap_summary(spark, d):
    return rounded(diagnostics.overlap(learners.cross_fitted_propensity(learner_cell(spark, d).filter("split = 'train'"))), 4)


@query("potential_outcome_labels")
def potential_outcome_labels(spark, d):
    found = learners.potential_outcome_labels(learner_cell(spark, d).filter("split = 'train'"))
    return found.select("epk_id", F.round("label0", 6).alias("label0"), F.round("label1", 6).alias("label1"))


@query("risk_scores")
def risk_scores(spark, d):
    return learners.risk_scores(learner_cell(spark, d)).select("epk_id", "split", F.round("risk", 6).alias("risk"))


# ---- nearest rows of each arm

NEAR = ["price", "balance", "order_month"]
NEAR_SQL = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in NEAR)


@query("nearest_means", f"""+{SPLIT}, z AS (SELECT epk_id, t, y, split, price / 1e5 AS price, coalesce(balance, 0.0::DOUBLE) / 1e4 AS balance, order_month / 12.0::DOUBLE AS order_month FROM split),
d AS (SELECT a.epk_id, b.t, b.y, row_number() OVER (PARTITION BY a.epk_id, b.t ORDER BY {NEAR_SQL}, b.epk_id) AS k FROM z a JOIN z b ON a.split = 'test' AND b.split = 'train')
SELECT epk_id, round(avg(y) FILTER (WHERE t = 0), 8) AS mu0, round(avg(y) FILTER (WHERE t = 1), 8) AS mu1 FROM d WHERE k <= 64 GROUP BY epk_id""", "trial")
def nearest_means(spark, d):
    price, balance, month = F.col("price") / 1e5, F.coalesce("balance", F.lit(0.0)) / 1e4, F.col("order_month") / 12.0
    rows = splits.stratified_split(settled(trial(spark, d), "trial"), 7).select("epk_id", "t", "y", "split", price.alias("price"), balance.alias("balance"), month.alias("order_month"))
    near = neighbours.nearest_means(rows.filter("split = 'test'"), rows.filter("split = 'train'"), NEAR, 64, "t", [64])
    return near.select("epk_id", *(F.round(f"mean_{a}_64", 8).alias(f"mu{a}") for a in (0, 1)))


@query("validate_all_scorers", """SELECT model, count(*) AS n, count(*) FILTER (WHERE isfinite(score)) AS finite_scores, count(*) FILTER (WHERE y IN (0, 1)) AS binary_y,
  count(*) FILTER (WHERE t IN (0, 1)) AS binary_t, count(DISTINCT t) AS arms, count(DISTINCT y) AS outcomes FROM scored GROUP BY model""", "scored")
def validate_all_scorers(spark, d):
    return validate.metric_inputs(scored(spark, d), ["model"])


# ---- row by row what other queries only sum up

@query("context_sample", f"SELECT epk_id FROM (SELECT epk_id, u, row_number() OVER (PARTITION BY t, y ORDER BY u, epk_id) AS k FROM (SELECT *, {sql_u('epk_id', 'context')} AS u FROM trial)) ORDER BY k > 1, u, epk_id LIMIT 400", "trial")
def context_sample(spark, d):
    return splits.context_sample(trial(spark, d), 400, "context").select("epk_id")


@query("standardize_rows", f"""+{SPLIT}, med AS (SELECT median(balance) AS m FROM split WHERE split = 'train'), st AS (SELECT avg(coalesce(balance, m)) AS mean, stddev_pop(coalesce(balance, m)) AS scale FROM split, med WHERE split = 'train')
SELECT epk_id, CAST(CAST((coalesce(balance, m) - mean) / scale AS FLOAT) AS DOUBLE) AS balance FROM split, med, st""", "trial")
def standardize_rows(spark, d):
    rows, _ = prepare.prepare(splits.stratified_split(trial(spark, d), 7), ["balance"], [], ["epk_id", "split"])
    return rows.select("epk_id", F.col("balance").cast("double").alias("balance"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("one_hot_rows", f"""+{SPLIT}, mo AS (SELECT segment AS mode FROM split WHERE split = 'train' AND segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)
SELECT epk_id, {", ".join(f"CAST(coalesce(segment, mode) = '{v}' AS DOUBLE) AS segment_{v}" for v in SEGMENTS)} FROM split, mo""", "trial")
def one_hot_rows(spark, d):
    rows, _ = prepare.prepare(splits.stratified_split(trial(spark, d), 7), [], ["segment"], ["epk_id", "split"])
    return rows.select("epk_id", *(F.col(f"segment_{v}").cast("double").alias(f"segment_{v}") for v in SEGMENTS))


@query("equalize_facts", f"+{SPLIT} SELECT split, CASE split WHEN 'train' THEN 1500 ELSE 500 END AS target, count(*) >= CASE split WHEN 'train' THEN 1500 ELSE 500 END AS reached FROM split GROUP BY split", "trial")
def equalize_facts(spark, d):
    return resample.equalize(splits.stratified_split(trial(spark, d), 7), 1500, "eq")[1]


@query("breakpoint_intervals", f"+{BREAKS} SELECT b.dataset, b.axis, b.metric, CASE WHEN l.k IS NOT NULL THEN printf('[%.4f, %.4f]', l.ci_low, l.ci_high) END AS ci_at_breakpoint FROM breaks b LEFT JOIN losing l ON l.dataset = b.dataset AND l.axis = b.axis AND l.metric = b.metric AND l.k = 1", "draws")
def breakpoint_intervals(spark, d):
    return found_breaks(spark, d).select("dataset", "axis", "metric", "ci_at_breakpoint")


SUMMED = ("qini", "pehe", "abs_ate_error")


@query("seed_summary_all", "SELECT dataset, axis, model, " + ", ".join(f"count({m}) AS {m}_n, round(avg({m}), 7) AS {m}_mean, round(coalesce(stddev_samp({m}), 0), 7) AS {m}_std, round(1.96 * coalesce(stddev_samp({m}), 0) / sqrt(count({m})), 7) AS {m}_ci95" for m in SUMMED) + " FROM runs GROUP BY dataset, axis, model", "runs")
def seed_summary_all(spark, d):
    return rounded(trials.seed_summary(runs(spark, d), ["dataset", "axis", "model"], list(SUMMED)), 7)


@query("rank_agreement", """+ et AS (SELECT dataset, axis, severity_tag, model, avg(abs(qini - 0.01)) AS p, avg(qini) AS q FROM runs WHERE status = 'ok' AND isfinite(qini) GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY dataset, axis, severity_tag ORDER BY -p) + (count(*) OVER (PARTITION BY dataset, axis, severity_tag, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY dataset, axis, severity_tag ORDER BY q) + (count(*) OVER (PARTITION BY dataset, axis, severity_tag, q) - 1) / 2.0 AS rq FROM et)
SELECT dataset, axis, severity_tag, CAST(count(*) AS INT) AS n_methods, round(corr(rp, rq), 6) + 0.0 AS spearman_rho, round(corr(-p, q), 6) + 0.0 AS value_correlation FROM r GROUP BY ALL HAVING count(*) >= 3""", "runs")
def rank_agreement(spark, d):
    rows = runs(spark, d).withColumn("pehe", F.abs(F.col("qini") - 0.01))
    return regimes.rank_agreement(regimes.effect_table(rows)).select("dataset", "axis", "severity_tag", "n_methods", *((F.round(c, 6) + 0.0).alias(c) for c in ("spearman_rho", "value_correlation")))


PARTS_OF_Q = f"q AS (SELECT epk_id, 0.2 + 0.6 * {sql_u('epk_id', 'e')} AS e, 0.05 + 0.9 * {sql_u('epk_id', 'p')} AS p, {sql_u('epk_id', 'm')} AS m FROM trial)"


@query("q_arithmetic", f"+{PARTS_OF_Q} SELECT epk_id, round(greatest(least(m * p / e, 1.0), 0.0), 8) AS mu1, round(greatest(least(m * (1 - p) / (1 - e), 1.0), 0.0), 8) AS mu0, round(greatest(least(p / (1 - p) * (1 - e) / e, 100.0), 0.01), 7) AS ratio FROM q", "trial")
def q_arithmetic(spark, d):
    e, p, m = 0.2 + 0.6 * fn.uniform("epk_id", "e"), 0.05 + 0.9 * fn.uniform("epk_id", "p"), fn.uniform("epk_id", "m")
    mu1, mu0 = fn.q_means(e, p, m)
    return trial(spark, d).select("epk_id", F.round(mu1, 8).alias("mu1"), F.round(mu0, 8).alias("mu0"), F.round(fn.q_ratio(e, p), 7).alias("ratio"))


@query("normal_tails", """+ z AS (SELECT nation, count(*) AS n, atanh(abs(greatest(least(corr(price, y), 0.999999), -0.999999))) * sqrt(count(*) - 3) AS z FROM trial GROUP BY nation), k AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * z) AS k FROM z)
SELECT nation, round(z, 8) AS z, round(exp(-z * z / 2) / sqrt(2 * pi()) * k * (0.319381530::DOUBLE + k * (-0.356563782::DOUBLE + k * (1.781477937::DOUBLE + k * (-1.821255978::DOUBLE + k * 1.330274429::DOUBLE)))), 8) AS tail FROM k""", "trial")
def normal_tails(spark, d):
    rows = trial(spark, d).groupBy("nation").agg(F.corr("price", "y").alias("r"), F.count(F.lit(1)).alias("n")).withColumn("z", fn.fisher_z(F.col("r"), F.col("n")))
    return rows.select("nation", F.round("z", 8).alias("z"), F.round(fn.normal_tail(F.col("z")), 8).alias("tail"))


@query("standardised_signal", "SELECT epk_id, round((s - avg(s) OVER ()) / stddev_pop(s) OVER (), 7) AS signal FROM (SELECT epk_id, 0.6::DOUBLE * price / 1e5 + 0.8::DOUBLE * order_month AS s FROM trial)", "trial")
def standardised_signal(spark, d):
    rows = semisynth.standardised(trial(spark, d), {"signal": 0.6 * F.col("price") / 1e5 + 0.8 * F.col("order_month")})
    return rows.select("epk_id", F.round("signal", 7).alias("signal"))
