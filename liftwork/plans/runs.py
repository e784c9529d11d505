"""Runs that put the operators together: one comparison, a sweep over severities, tuning with resume, the analysis.

The driver only decides what to run; the rows stay in DataFrames, and every result is a table.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import seed_of
from ..operators import bootstrap, curves, diagnostics, learners, prepare, regimes, resample, splits, trials, validate
from ..sources import tables
from ..sources.scratch import settled

METRICS = ("qini_auc_normalized", "qini_coefficient", "uplift_auc_normalized", "auuc", "uplift_at_10pct", "uplift_at_20pct", "ate_observed", "cate_mean", "cate_std")
ROW = "dataset string, axis string, severity_tag string, severity double, seed int, model string, status string, message string, fit_seconds double, predict_seconds double, " + ", ".join(f"{m} double" for m in METRICS) + ", pehe double, abs_ate_error double"


def degrade(rows: DataFrame, axis: str, severity, seed: int, risk: str | None = None, splits_to: str | None = None) -> DataFrame:
    """`rows` (with split) with the axis' splits (or those of `splits_to`) resampled at the severity; the anchor changes nothing."""
    spec = resample.AXES[axis]
    if spec.is_anchor(severity):
        return rows
    targets = resample.degraded_splits(spec, splits_to)
    out = rows.filter(~F.col("split").isin(*targets))
    for name in targets:
        part, salt = rows.filter(F.col("split") == name), f"{spec.tag(severity)}/{name}/{seed}"
        if spec.kind == "rows":
            part = resample.subsample(part, int(severity), salt)
        elif spec.kind == "share":
            part = resample.control_share(part, float(severity), salt)
        else:
            validate.require(risk is not None, "the conversion axis needs a risk column")
            part = resample.conversion(part, risk, float(severity), salt)
        out = out.unionByName(part.select(rows.columns))
    return out


def with_risk(rows: DataFrame, numeric: list[str], categorical: list[str], risk: str) -> tuple[DataFrame, str]:
    """(`rows` with the risk that a conversion axis selects by, its name): "fitted" learns P(y | features) out of fold, another name is a column as it stands."""
    if risk != "fitted":
        return learners.with_natural_risk(rows, risk, "row_risk"), "row_risk"
    keep = ["epk_id", "split", "t", "y"]
    ready, fitted = prepare.prepare(rows, numeric, categorical, keep)
    scored = learners.risk_scores(VectorAssembler(inputCols=fitted.names(), outputCol="features").transform(ready))
    return rows.join(scored.select("epk_id", F.col("risk").alias("row_risk")), "epk_id"), "row_risk"


def prepare_cell(rows: DataFrame, numeric: list[str], categorical: list[str], seed: int, axis: str = "scale", severity=None, group: str | None = None, risk: str | None = None, equal_rows: int | None = None, alpha: float | None = None, splits_to: str | None = None, star: Column | None = None, allow_confounding: bool = False) -> DataFrame:
    """epk_id, split, t, y, (tau, confounded,) features: split, check that covariates tell about the outcome (`alpha`), resample by the
    axis (its splits, or those of `splits_to`) or towards a treatment probability of covariates (`star`, by `allow_confounding` alone), cap the splits alike (`equal_rows`), check the events, preprocess by the resampled train split."""
    rows = splits.group_exact_split(rows, group, seed) if group else splits.stratified_split(rows, seed)
    if alpha is not None:
        diagnostics.precondition(rows.filter("split = 'train'"), numeric, alpha)
    if risk is not None and not resample.AXES[axis].is_anchor(severity) and resample.AXES[axis].kind == "lambda":
        rows, risk = with_risk(rows, numeric, categorical, risk)
    if star is not None:
        rows = resample.confounded(rows, star, f"confounded{seed}", allow_confounding)
    rows = settled(degrade(rows, axis, severity, seed, risk, splits_to), "cell")  # every check and statistic reads it
    if equal_rows:
        rows, reached = resample.equalize(rows, equal_rows, f"equal{seed}")
        short = [r["split"] for r in reached.filter("NOT reached").collect()]
        validate.require(not short, f"degenerate_regime: fewer than {equal_rows} rows in {short}")
    gate = validate.event_gate(rows, ["split"]).filter("degenerate").select("split").collect()
    validate.require(not gate, f"degenerate_regime: too few events in {[r['split'] for r in gate]}")
    keep = ["epk_id", "split", "t", "y", *(c for c in ("tau", "confounded") if c in rows.columns)]
    ready, fitted = prepare.prepare(rows, numeric, categorical, keep)
    return settled(VectorAssembler(inputCols=fitted.names(), outputCol="features").transform(ready), "prepared")


def predictions(cell: DataFrame, model: learners.Fitted, split: str) -> DataFrame:
    keep = ["epk_id", "t", "y", *(["tau"] if "tau" in cell.columns else [])]
    return model.predict(cell.filter(F.col("split") == split)).select(*keep, F.lit(model.name).alias("model"), F.col("cate").alias("score"))


def score_row(cell: DataFrame, name: str, fit: Callable[[DataFrame], learners.Fitted], split: str) -> tuple[dict, DataFrame | None]:
    """Metrics of one model on one cell; a failure is a row too."""
    began = time.time()
    try:
        model = fit(cell.filter("split = 'train'"))
        fitted = time.time()
        scored = predictions(cell, model, split).withColumn("model", F.lit(name))
        scored = settled(scored, "scored")
        found = curves.evaluate_uplift(scored, ["model"]).first().asDict()
        if "tau" in scored.columns and model.scale == "difference":  # a ratio has no error against a difference
            found |= regimes.effect_error(scored, ["model"]).first().asDict()
        return found | {"status": "ok", "fit_seconds": fitted - began, "predict_seconds": time.time() - fitted}, scored
    except Exception as e:
        return {"model": name, "status": "degenerate_regime" if "degenerate_regime" in str(e) else "error", "message": str(e)[:500]}, None


def compare(spark: SparkSession, cell: DataFrame, models: dict[str, Callable[[DataFrame], learners.Fitted]], split: str = "test", **where) -> tuple[DataFrame, DataFrame | None]:
    """(metrics, predictions) of several models on one prepared cell."""
    names = [f.split()[0] for f in ROW.split(", ")]
    rows, scored = [], []
    for name, fit in models.items():
        row, out = score_row(cell, name, fit, split)
        rows.append(tuple((where | row).get(n) for n in names))
        if out is not None:
            scored.append(out.select("*", *(F.lit(v).alias(k) for k, v in where.items())))
    return spark.createDataFrame(rows, ROW), trials.union(*scored) if scored else None


def sweep(spark: SparkSession, load: Callable[[str], DataFrame], datasets: Iterable[str], axes: Iterable[str], seeds: Iterable[int], models: dict, numeric: list[str], categorical: list[str], out: str, risk: str | None = None) -> None:
    """Every cell of the matrix to `out`, one folder each; cells that are there already are skipped."""
    for c in trials.sweep_matrix(spark, list(datasets), list(axes), list(seeds)).withColumn("cell_seed", seed_of("dataset", "axis", "severity_tag", "seed")).orderBy("dataset", "axis", "severity_tag", "seed").collect():
        folder = f"{out}/{c['dataset']}/{c['axis']}/{c['severity_tag']}/seed_{c['seed']}"
        if os.path.exists(f"{folder}/done.json"):
            continue
        where = {k: v for k, v in c.asDict().items() if k != "cell_seed"}
        try:
            cell = prepare_cell(load(c["dataset"]), numeric, categorical, c["seed"], c["axis"], c["severity"], risk=risk)
            metrics, scored = compare(spark, cell, models, **where)
        except ValueError as e:
            names = [f.split()[0] for f in ROW.split(", ")]
            bad = where | {"status": "degenerate_regime" if "degenerate_regime" in str(e) else "error", "message": str(e)[:500]}
            metrics, scored = spark.createDataFrame([tuple((bad | {"model": m}).get(n) for n in names) for m in models], ROW), None
        metrics.write.mode("overwrite").parquet(f"{folder}/metrics")
        if scored is not None:
            scored.write.mode("overwrite").parquet(f"{folder}/predictions")
        tables.write_json(f"{folder}/run_config.json", where | {"cell_seed": c["cell_seed"], "models": sorted(models), "numeric": numeric, "categorical": categorical, "risk": risk, "status": {r["model"]: r["status"] for r in metrics.select("model", "status").collect()}, "made": tables.stamp()})
        tables.write_json(f"{folder}/done.json", where)


def with_cell(scored: DataFrame, most_rows: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """(__cell, epk_id, model, t, y, score of a predictions table; __cell and what it stands for). Nulls and quotes are values like others."""
    keys = [*bootstrap.CELL, "seed"]
    rows = settled(scored.select(*keys, "epk_id", "model", "t", "y", "score").withColumn("__cell", F.to_json(F.struct(*keys))), "cells")
    cells = rows.select("__cell", *keys).distinct()
    validate.require(bootstrap.aligned(rows, "epk_id", ["__cell"]).isEmpty(), "models score different rows")
    rows = rows.drop(*keys)
    if most_rows:
        u, ids = splits.uniform("epk_id", f"boot{seed}"), rows.select("__cell", "epk_id").distinct()
        rows = rows.join(splits.capped(ids, {"__cell": most_rows}, u), ["__cell", "epk_id"], "left_semi")
    return rows, cells


def cell_draws(scored: DataFrame, draws: int, seed: int, most_rows: int | None = None, picks: str = "hash") -> DataFrame:
    """Long bootstrap draws of all cells of a predictions table, in one plan: dataset, axis, severity_tag, seed, model, metric, b, value. picks: as in `metric_draws`."""
    rows, cells = with_cell(scored, most_rows, seed)
    drawn = bootstrap.long_draws(bootstrap.metric_draws(rows, ["__cell", "model"], draws, seed, tops=True, cell=["__cell"], picks=picks), ["__cell", "model"])
    return drawn.join(cells, "__cell").select(*bootstrap.CELL, "seed", "model", "b", "metric", "value")


def cell_table(scored: DataFrame, draws: int, seed: int, level: float = 0.95, picks: str = "hash") -> DataFrame:
    """dataset, axis, severity_tag, seed, model, metric, point_estimate, n_rows, ci_low, ci_high, n_draws, n_failed_resamples of each cell."""
    rows, cells = with_cell(scored, None, seed)
    found = bootstrap.draw_table(rows, ["__cell", "model"], draws, seed, level, cell=["__cell"], picks=picks)
    return found.join(cells, "__cell").select(*bootstrap.CELL, "seed", *(c for c in found.columns if c != "__cell"))


def analyse(metrics: DataFrame, scored: DataFrame, reference: str, draws: int = 1000, seed: int = 0, level: float = 0.95, metric: str = "qini_auc_normalized") -> dict[str, DataFrame]:
    """The tables of a sweep: pooled, paired, breakpoints, robustness index, effect errors and rank agreement."""
    long = settled(cell_draws(scored, draws, seed, picks="split").filter(F.col("metric") == metric), "draws")
    pairs = bootstrap.paired(long, reference, level)
    breaks = regimes.breakpoints(pairs, metrics)
    effects = regimes.effect_table(metrics.withColumn("qini", F.col("qini_auc_normalized")))
    more = {}
    if not regimes.variant_families(regimes.with_series(long.select("model").distinct())).isEmpty():
        more = dict(zip(("series", "shifts", "influence"), regimes.hparam_influence(long, metrics, level), strict=True))
    return more | {"map": regimes.regime_map(breaks, pairs), "verdict": regimes.regime_verdict(breaks)} | {"pooled": bootstrap.pooled(long, level), "paired": pairs, "breakpoints": breaks, "robustness": regimes.robustness_index(breaks, metrics), "effects": effects, "agreement": regimes.rank_agreement(effects)}


TRIAL = "model string, trial int, status string, objective double, uplift_at_10pct double, fit_seconds double, params_json string"


def tune(spark: SparkSession, cell: DataFrame, name: str, build: Callable[[dict], Callable[[DataFrame], learners.Fitted]], space: dict, defaults: dict, rounds: int, seed: int, path: str, retry_failed: bool = False) -> DataFrame:
    """Random search on the validation split. Trials are kept in `path` as they end, and those that are there are not run again."""
    validate.require(not os.path.exists(f"{path}/final.json"), "the test split was opened; this search is sealed")
    os.makedirs(path, exist_ok=True)
    rows = tables.read_json(f"{path}/trials.json") if os.path.exists(f"{path}/trials.json") else []
    if retry_failed:
        rows = [r for r in rows if r["status"] == "ok"]
    done = {r["trial"] for r in rows}
    for trial in range(rounds):
        if trial not in done:
            params = trials.random_trial(space, defaults, seed, 0, trial)
            row, _ = score_row(cell, name, build(params), "validation")
            rows.append({"model": name, "trial": trial, "status": row["status"], "objective": row.get("qini_auc_normalized"), "uplift_at_10pct": row.get("uplift_at_10pct"), "fit_seconds": row.get("fit_seconds"), "params_json": json.dumps(params, sort_keys=True)})
            tables.write_json(f"{path}/trials.json", rows)
    return spark.createDataFrame([tuple(r[f.split()[0]] for f in TRIAL.split(", ")) for r in rows], TRIAL)


def final_test(spark: SparkSession, cell: DataFrame, found: DataFrame, name: str, build: Callable[[dict], Callable[[DataFrame], learners.Fitted]], path: str) -> dict:
    """The best trial on the test split, once."""
    validate.require(not os.path.exists(f"{path}/final.json"), "the test split was opened; this search is sealed")
    best = trials.best_trials(found).filter(F.col("model") == name).first()
    validate.require(best is not None, "no trial went well")
    row, _ = score_row(cell, name, build(json.loads(best["params_json"])), "test")
    tables.write_json(f"{path}/final.json", row | {"trial": best["trial"]})
    return row


def frozen(spark: SparkSession, cells: dict[int, DataFrame], found: DataFrame, target: int, builders: dict[str, Callable[[dict], Callable[[DataFrame], learners.Fitted]]]) -> DataFrame:
    """The best settings of complete searches on other seeds; searches that lack trials give placeholder rows."""
    audit = {r["model"]: r for r in trials.trial_audit(found, target).collect()}
    best = {r["model"]: json.loads(r["params_json"]) for r in trials.best_trials(found).collect()}
    out = []
    for seed, cell in cells.items():
        models = {m: builders[m](best[m]) for m in builders if m in best and audit[m]["complete"]}
        rows, _ = compare(spark, cell, models, seed=seed)
        missing = [(seed, m, "missing") for m in builders if m not in models]
        out.append(trials.union(rows, spark.createDataFrame(missing, "seed int, model string, status string")) if missing else rows)
    return trials.union(*out)
