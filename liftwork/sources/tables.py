"""Trial data sources, run scans and sinks."""

from __future__ import annotations

import csv
import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import normal
from ..operators.splits import exact_cap
from ..operators.trials import compatible
from ..operators.validate import check_binary, require
from ..shipping import ship
from .scratch import settled

NOT_FEATURES = ("epk_id", "T", "t", "y", "treatment_dt", "split")


@dataclass(frozen=True)
class Dataset:
    """Where a trial lies, the outcome it is judged by, and whether equal feature vectors must share a split."""

    name: str
    outcome: str
    group_safe: bool = False


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES]


def align(features: DataFrame, outcomes: DataFrame, ident: str = "epk_id") -> DataFrame:
    """Features joined one to one with outcomes; raises where ids repeat or are missing on either side."""
    sides = features.select(ident, F.lit(1).alias("x"), F.lit(0).alias("z")).unionByName(outcomes.select(ident, F.lit(0).alias("x"), F.lit(1).alias("z")))
    wrong = sides.groupBy(ident).agg(F.sum("x").alias("x"), F.sum("z").alias("z")).filter("x <> 1 OR z <> 1")
    require(wrong.isEmpty(), "ids of features and outcomes do not match one to one")
    return features.join(outcomes, ident)


def load(spark: SparkSession, root: str, dataset: Dataset, outcome: str | None = None, max_rows: int | None = None, seed: int = 0) -> DataFrame:
    """epk_id, t, y and the features of a trial kept as features.parquet and outcomes.parquet, capped by hash."""
    x, z = spark.read.parquet(f"{root}/{dataset.name}/features.parquet"), spark.read.parquet(f"{root}/{dataset.name}/outcomes.parquet")
    name = outcome or dataset.outcome
    require(name in z.columns, f"no outcome {name}")
    out = align(x.withColumn("t", F.col("T").cast("byte")).select("epk_id", "t", *feature_columns(x)), z.select("epk_id", F.col(name).alias("y")))
    check_binary(out, "t", both=True)
    check_binary(out, "y", both=True)
    return exact_cap(out.withColumn("y", F.col("y").cast("byte")), max_rows, f"load{seed}")


def metadata(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """Columns and row count from the files' footers."""
    df = spark.read.parquet(path)
    return df.columns, df.count()


def gaussian(spark: SparkSession, text: str, seed: int) -> DataFrame:
    """gaussian:<rows>x<columns>: epk_id and x0, x1, ... of hash normals."""
    n, d = map(int, text.removeprefix("gaussian:").split("x"))
    require(n >= 100 and d >= 2, "at least 100 rows and 2 columns")
    return spark.range(n).select(F.col("id").alias("epk_id"), *(normal("id", f"gauss{seed}/{k}").alias(f"x{k}") for k in range(d)))


def npz_covariates(spark: SparkSession, path: str, replication: int = 0) -> DataFrame:
    """One replication of the covariates x[row, column, replication] of a NumPy archive."""
    import numpy as np
    import pandas as pd

    x = np.load(path)["x"]
    x = x[:, :, replication] if x.ndim == 3 else x
    frame = pd.DataFrame(x, columns=[f"x{k}" for k in range(x.shape[1])])
    frame.insert(0, "epk_id", np.arange(len(frame)))
    return spark.createDataFrame(frame)


def covariates(spark: SparkSession, text: str, seed: int = 0) -> DataFrame:
    if text.startswith("gaussian:"):
        return gaussian(spark, text, seed)
    return npz_covariates(spark, text) if text.endswith(".npz") else spark.read.parquet(text)


DEFAULTS = {"axis": "baseline", "severity_tag": "full", "status": "ok"}


def metrics_scan(spark: SparkSession, root: str) -> DataFrame:
    """All metrics.csv under `root`, with their source and defaults for what older files lack."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "metrics.csv").option("header", True).option("inferSchema", True).csv(root)
    df = df.withColumn("source", F.col("_metadata.file_path"))
    for c, v in DEFAULTS.items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    return df if "severity" in df.columns else df.withColumn("severity", F.lit(None).cast("double"))


PREDICTION = ("epk_id", "t", "y", "score", "model")


LEDGER = "path string, rows long, columns array<string>, reason string"


def ledger(spark: SparkSession, root: str, need: tuple[str, ...] = PREDICTION, pattern: str = "*.parquet") -> DataFrame:
    """path, rows, columns, reason of every Parquet file under `root`: reason is null for good files, else why one cannot be used.

    Footers are read in tasks: at the end of the file where Arrow knows the file system, else from the file as Spark reads it.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    known = arrow_knows(root)
    files = listed.select("path", "content") if not known else listed.select("path", F.lit(None).cast("binary").alias("content"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    file = pq.ParquetFile(pa.BufferReader(r["content"]) if r["content"] is not None else open_input(r["path"]))
                    names = file.schema_arrow.names
                    lacks = [c for c in need if c not in names]
                    out.append((r["path"], file.metadata.num_rows, names, f"lacks {', '.join(lacks)}" if lacks else None))
                except (OSError, pa.ArrowException) as e:
                    out.append((r["path"], None, None, f"cannot be read: {str(e)[:200]}"))
            if out:
                columns = list(zip(*out, strict=True))
                types = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "rows", "columns", "reason"])

    ship(spark)
    return files.mapInArrow(look, LEDGER)


def arrow_knows(root: str) -> bool:
    """Whether tasks can open files of this kind of path by Arrow."""
    return "://" not in root or root.split("://")[0] in ("file", "hdfs", "s3", "gs")


def open_input(path: str):
    uri = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    fs, inner = FileSystem.from_uri(uri) if "://" in uri else (LocalFileSystem(), uri)
    return fs.open_input_file(inner)


def predictions_with_ledger(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(rows of all good files, the ledger with the rows of each file that lack a value)."""
    seen = settled(ledger(spark, root), "ledger")
    good = [r["path"] for r in seen.filter("reason IS NULL").select("path").collect()]  # one for each run
    if not good:
        return spark.createDataFrame([], "epk_id long, t int, y int, score double, model string"), seen.withColumn("rows_without_value", F.lit(None).cast("long"))
    rows = spark.read.option("mergeSchema", True).parquet(*good)
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in PREDICTION))
    bad = rows.select(F.col("_metadata.file_path").alias("path"), whole.alias("whole")).filter("NOT whole").groupBy("path").agg(F.count(F.lit(1)).alias("rows_without_value"))
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    counted = seen.join(bad.select(bare(F.col("path")).alias("__path"), "rows_without_value"), bare(F.col("path")) == F.col("__path"), "left").drop("__path")
    return rows.filter(whole), counted.withColumn("rows_without_value", F.when(F.col("reason").isNull(), F.coalesce("rows_without_value", F.lit(0).cast("long"))))


def predictions_scan(spark: SparkSession, root: str) -> DataFrame:
    """The predictions of all good Parquet files under `root`; `predictions_with_ledger` names what is left out and why."""
    return predictions_with_ledger(spark, root)[0]


TRIAL_ROW = "model string, trial int, status string, objective double, uplift_at_10pct double, fit_seconds double, params_json string"


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trials of a search kept as CSV, to resume from; none where there is no file yet."""
    if not os.path.exists(path):
        return spark.createDataFrame([], TRIAL_ROW)
    return spark.read.option("header", True).option("escape", '"').schema(TRIAL_ROW).csv(path)


def write_rows(path, rows: list[dict], columns: list[str]) -> None:
    """A small CSV file, written beside and moved into place."""
    with open(f"{path}.tmp", "w", newline="") as f:
        out = csv.DictWriter(f, columns, extrasaction="ignore")
        out.writeheader()
        out.writerows(rows)
    os.replace(f"{path}.tmp", path)


def stamp() -> str:
    """The time as part of a folder's name."""
    return time.strftime("%Y%m%d_%H%M%S")


def manifest(kind: str, rows: DataFrame, **facts) -> dict:
    """What a run's folder says about itself: kind, time, columns, rows and rates by split, versions and what else is given."""
    by = [c for c in ("split",) if c in rows.columns]
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("t").cast("double")).alias("treatment_rate"), F.avg(F.col("y").cast("double")).alias("outcome_rate"))
    return {"kind": kind, "made": stamp(), "spark": rows.sparkSession.version, "columns": rows.columns, "rows": [r.asDict() for r in sizes.collect()]} | facts


def walk(root: str) -> Iterator[tuple[str, bool, int]]:
    """path, whether a folder, time of change of all that is under `root`, on any file system that Spark knows."""
    spark = SparkSession.active()
    top = spark._jvm.org.apache.hadoop.fs.Path(str(root))
    files, todo = top.getFileSystem(spark._jsc.hadoopConfiguration()), [top]
    while todo:
        folder = todo.pop()
        for s in files.listStatus(folder) if files.exists(folder) else []:
            if s.isDirectory():
                todo.append(s.getPath())
            yield s.getPath().toString(), s.isDirectory(), s.getModificationTime()


def find_run(root: str, need: dict) -> str | None:
    """The newest folder with metrics, predictions and settings that meet `need`; on any file system."""
    inside: dict[str, dict[str, int]] = {}
    for path, _, changed in walk(root):
        folder, name = path.rsplit("/", 1)
        inside.setdefault(folder, {})[name] = changed
    found = [f for f, names in inside.items() if {"run_config.json", "metrics.csv"} <= set(names) and any(n.startswith("predictions.parquet") for n in names)]
    for folder in sorted(found, key=lambda f: max(inside[f].values()), reverse=True):
        if compatible(json.loads(SparkSession.active().read.text(f"{folder}/run_config.json", wholetext=True).first()[0]), need):
            return folder.removeprefix("file:") if folder.startswith("file:/") else folder
    return None


def read_json(path) -> dict:
    return json.loads(Path(path).read_text())


def write_json(path, what) -> None:
    """Written beside and moved into place, so that a crash leaves the old file or the new."""
    temporary = f"{path}.tmp"
    Path(temporary).write_text(json.dumps(what, indent=2, default=str))
    os.replace(temporary, path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("dataset", "axis", "severity_tag", "seed").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def regime_report(title: str, regimes: DataFrame, verdict: DataFrame, sections: dict[str, DataFrame], most_cells: int = 10_000) -> str:
    """A report with a line for each axis and its severities in order (it says how many of more than `most_cells` cells are not shown), the verdict, then other tables."""
    signs = {"wins": "+", "ties": "=", "loses": "-"}
    lines = [f"# {title}", "", "## Regime map", "", "+ better than the best alternative, = no difference, - worse, * breakpoint"]
    cells: dict[tuple, list[str]] = {}
    shown = regimes.orderBy("dataset", "metric", "axis", "severity_tag").limit(most_cells + 1).collect()  # one row for each cell of a sweep
    for r in shown[:most_cells]:
        cells.setdefault((r["dataset"], r["metric"], r["axis"]), []).append(f"{r['severity_tag']} {signs[r['outcome']]}{'*' if r['is_breakpoint'] else ''}")
    lines += [f"- {d} / {m} / {a}: " + ", ".join(v) for (d, m, a), v in cells.items()] or ["No cell."]
    if len(shown) > most_cells:
        lines += ["", f"{regimes.count() - most_cells} more cells are not shown; the table has them all."]
    lines += ["", "## Verdict", ""] + [f"- {r['dataset']} / {r['metric']}: {r['verdict']} ({r['axes_that_break']} of {r['axes']})" for r in verdict.orderBy("dataset", "metric").collect()]
    return "\n".join(lines) + "\n\n" + markdown("Tables", sections)


def markdown(title: str, sections: dict[str, DataFrame], most_rows: int = 200) -> str:
    """A report of small tables."""
    out = [f"# {title}"]
    for name, df in sections.items():
        rows = df.limit(most_rows + 1).collect()
        more = df.count() - most_rows if len(rows) > most_rows else 0
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) + " |" for r in rows[:most_rows]] or ["", "No rows."]
        out += ["", f"{more} more rows are not shown; the table has them all."] if more else []
    return "\n".join(out) + "\n"
