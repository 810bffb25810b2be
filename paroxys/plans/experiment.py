"""Experiment grids: datasets, repetitions and models, one result row each."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paroxys.operators.metrics import METRICS, fold_summary
from paroxys.operators.splits import first_subjects, random_rows
from paroxys.plans.models import fold_metrics, loso_scores, materialise

SEED = 42
RESULT = (
    "dataset string, rep int, seed int, model string, type string, status string, error string,"
    " n_folds bigint, recall double, specificity double, f1 double, auc_roc double"
)


def _choices(values: Sequence) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values]))


def grid(datasets: DataFrame, models: Sequence[str], reps: int = 1) -> DataFrame:
    """Every dataset row for every repetition and model, with the run's seed."""
    return (
        datasets.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
        .withColumn("model", _choices(models))
        .withColumn("seed", F.col("rep") + SEED)
    )


def ablation_grid(
    recordings: DataFrame,
    channels: Mapping[str, Sequence[str]],
    window_seconds: Sequence[float],
    preprocessing: Sequence[str],
) -> DataFrame:
    """Design variants for every recording, whose channel list is ``channels``.

    ``usable`` tells whether the recording has all channels of the variant.
    """
    sets = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("name"), F.array(*[F.lit(c) for c in cs]).alias("needs"))
                for name, cs in channels.items()
            ]
        )
    )
    return (
        recordings.withColumn("_set", sets)
        .withColumn("window_sec", _choices([float(w) for w in window_seconds]))
        .withColumn("preprocessing", _choices(preprocessing))
        .withColumn("channel_set", F.col("_set.name"))
        .withColumn("usable", F.size(F.array_except("_set.needs", "channels")) == 0)
        .drop("_set")
    )


def run_experiment(
    datasets: Mapping[str, DataFrame],
    models: Sequence[str],
    reps: int = 1,
    max_subjects: int | None = None,
    max_windows: int | None = None,
    overrides: Mapping[str, Mapping] | None = None,
    ledger: str | None = None,
) -> DataFrame:
    """Leave-one-subject-out results of every run; a failing run becomes an error row.

    Fits run while this is called. The result is one row per run. With a ``ledger``
    folder every run is stored when it ends and noted as done after that; a call that
    finds runs of the same settings there does not repeat them, those that failed aside.
    """
    rows = []
    spark = next(iter(datasets.values())).sparkSession
    for dataset, table in datasets.items():
        for rep in range(reps):
            seed = SEED + rep
            capped = table if max_subjects is None else first_subjects(table, max_subjects)
            capped = capped if max_windows is None else random_rows(capped, max_windows, seed=seed)
            for model in models:
                name = (dataset, rep, seed, model, "classical")
                limits = {"subjects": max_subjects, "windows": max_windows, "overrides": (overrides or {}).get(model)}
                run = hashlib.md5(json.dumps([name, limits], sort_keys=True).encode()).hexdigest()
                done = _finished(spark, ledger, run)
                if done is None:
                    done = (*name, *_run(capped, model, overrides))
                    _note(spark, ledger, run, done)
                rows.append(done)
    return spark.createDataFrame(rows, RESULT)


def _finished(spark: SparkSession, ledger: str | None, run: str) -> tuple | None:
    """The stored row of a run that is noted as done."""
    if ledger is None:
        return None
    try:
        if spark.read.schema("status string").parquet(f"{ledger}/done/{run}").first()["status"] != "ok":
            return None
        return tuple(spark.read.schema(RESULT).parquet(f"{ledger}/runs/{run}").first())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _note(spark: SparkSession, ledger: str | None, run: str, row: tuple) -> None:
    """Store a run's row, then that it is done; a run cut off between the two is run again."""
    if ledger is not None:
        spark.createDataFrame([row], RESULT).coalesce(1).write.mode("overwrite").parquet(f"{ledger}/runs/{run}")
        status = spark.createDataFrame([(row[5],)], "status string")
        status.coalesce(1).write.mode("overwrite").parquet(f"{ledger}/done/{run}")


def _run(table: DataFrame, model: str, overrides: Mapping[str, Mapping] | None) -> tuple:
    try:
        scores = materialise(loso_scores(table, [model], overrides), "scores")
        row = fold_summary(fold_metrics(scores), (*METRICS, "auc_roc")).first()
    except Exception as error:  # a run must not stop the grid
        return ("error", f"{type(error).__name__}: {error}", 0, None, None, None, None)
    shown = ("recall", "specificity", "f1", "auc_roc")
    return ("ok", None, row["n_folds"], *[row[f"mean_{m}"] for m in shown])


def leaderboard(results: DataFrame) -> DataFrame:
    """Runs by recall, with their metrics as text; failed runs last."""
    cells = {
        m: F.when(F.col("status") == "ok", F.format_string("%.3f", m)).otherwise("-")
        for m in ("recall", "specificity", "f1", "auc_roc")
    }
    ordered = results.orderBy(F.col("recall").desc_nulls_last(), "dataset", "model", "rep")
    return ordered.select("dataset", "rep", "model", "type", *[c.alias(n) for n, c in cells.items()], "status")
