"""Classifiers by name, leave-one-subject-out scoring and parameter search."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paroxys.operators.features import map_windows
from paroxys.operators.metrics import auc_roc, segment_metrics
from paroxys.operators.neighbours import knn_vote
from paroxys.operators.splits import loso_folds, loso_split, trainable
from paroxys.plans import boosting
from paroxys.session import shared_folder

# Default parameters per model.
DEFAULTS: dict[str, dict] = {
    "svm_rbf": {"C": 100.0, "gamma": 0.001, "components": 256, "maxIter": 100},
    "svm_linear": {"C": 1.0, "maxIter": 5000},
    "random_forest": {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 2},
    "xgboost": {"rounds": 200, "depth": 8, "rate": 0.1, "rows": 0.8, "columns": 0.8},
    # Grown by leaf without a depth; all rows are used, its share of rows needs a frequency to act.
    "lightgbm": {
        "rounds": 200, "leaves": 63, "depth": None, "rate": 0.05, "columns": 0.8,
        "l2": 0.0, "min_weight": 1e-3, "min_rows": 20,
    },
    "knn": {"k": 3},
}
SEED = 42
#: Models whose folds are fitted together.
BOOSTED = ("xgboost", "lightgbm")
#: Training rows a task of a fit has at least, if there are that many, and at most.
TASK_ROWS, MOST_TASK_ROWS = 20_000, 400_000
#: Fits that run side by side at least.
FITS = 4
COLUMNS = {"featuresCol": "vec", "labelCol": "y", "weightCol": "w"}


def model_names() -> list[str]:
    return sorted(DEFAULTS)


def parameters(name: str, overrides: Mapping | None = None) -> dict:
    if name not in DEFAULTS:
        raise ValueError(f"unknown model {name!r}; available: {model_names()}")
    return {**DEFAULTS[name], **(overrides or {})}


def build_estimator(name: str, n_train: int, overrides: Mapping | None = None) -> Estimator:
    """Spark estimator of a model that Spark fits: all but boosted trees and the neighbour vote."""
    p = parameters(name, overrides)
    if name in ("svm_linear", "svm_rbf"):
        # The penalty C of a sum of losses is 1 / (C * rows) on their mean. Inputs are
        # taken as they are: scaling would change the kernel the Fourier columns stand for.
        penalty = 1.0 / (p["C"] * max(n_train, 1))
        return LinearSVC(regParam=penalty, maxIter=p["maxIter"], standardization=False, **COLUMNS)
    if name == "random_forest":
        return RandomForestClassifier(seed=SEED, **p, **COLUMNS)
    raise ValueError(f"{name!r} has no estimator")


def fourier_features(df: DataFrame, gamma: float, components: int, x: str = "features") -> DataFrame:
    """Random Fourier features whose inner products approximate the RBF kernel."""

    def kernel(values: np.ndarray) -> list[np.ndarray]:
        rng = np.random.default_rng(SEED)
        directions = rng.normal(0.0, np.sqrt(2 * gamma), (values.shape[1], components))
        phases = rng.uniform(0.0, 2 * np.pi, components)
        return [np.sqrt(2.0 / components) * np.cos(values @ directions + phases)]

    wide = df.withColumn(x, F.col(x).cast("array<double>"))
    return map_windows(wide, kernel, x, "array<double>", x)


def class_weights(name: str, n_pos: int, n_neg: int) -> tuple[float, float]:
    """Weights of class 0 and 1: balanced, or the negative share on positives for ``xgboost``."""
    if name == "xgboost":
        return 1.0, n_neg / max(n_pos, 1)
    total = n_pos + n_neg
    return total / (2 * max(n_neg, 1)), total / (2 * max(n_pos, 1))


def weight(name: str, n_pos: int, n_neg: int, label: str = "y") -> Column:
    w_neg, w_pos = class_weights(name, n_pos, n_neg)
    return F.when(F.col(label) == 1, F.lit(float(w_pos))).otherwise(F.lit(float(w_neg)))


def boosted_scores(
    features: DataFrame, name: str, folds: Sequence, overrides: Mapping | None = None, subject: str = "subject"
) -> DataFrame:
    """Held-out scores of boosted trees, all folds at once.

    ``folds`` are rows with ``fold`` (a value of ``subject``), ``n_train`` and ``pos_train``.
    """
    params = boosting.Boosting(**{"seed": SEED, **parameters(name, overrides)})
    names = [f["fold"] for f in folds]
    weights = [class_weights(name, f["pos_train"], f["n_train"] - f["pos_train"]) for f in folds]
    margins, _, _ = boosting.boost(features, names, weights, params, subject=subject)
    return boosting.held_out_scores(margins, names, features.schema[subject].dataType.simpleString())


def neighbour_scores(features: DataFrame, folds: Sequence, overrides: Mapping | None = None) -> DataFrame:
    """Held-out scores of the neighbour vote, all folds at once: rows of other subjects vote.

    Windows of different subjects need different keys (``shared_keys``).
    """
    rows = features.where("subject is not null")
    held_out = rows.where(F.col("subject").isin([f["fold"] for f in folds]))
    p = parameters("knn", overrides)
    votes = knn_vote(held_out, rows, keep=["subject", "y"], x="features", apart="subject", **p)
    return votes.withColumnRenamed("subject", "fold")


def shared_keys(features: DataFrame) -> bool:
    """Whether windows of different subjects have one key."""
    ends = features.groupBy("window_id").agg(F.min("subject").alias("first"), F.max("subject").alias("last"))
    return bool(ends.where("first <> last").limit(1).count())


def fit_tasks(name: str, n_train: int, cores: int, beside: int = 1) -> int:
    """Tasks of a fit. Iterative fits run many small jobs: no more tasks than there are rows for.

    A gradient of the SVMs is a job of a few milliseconds, thousands of times: ``beside`` such
    fits share the cores with two tasks per core. The draws of a forest depend on its tasks,
    which follow the rows alone.
    """
    tasks = -(-n_train // TASK_ROWS) or 1
    if not name.startswith("svm"):
        return tasks
    return max(min(tasks, -(-2 * cores // beside)), -(-n_train // MOST_TASK_ROWS))


def fits_at_once(cores: int, fits: int) -> int:
    """Fits that run side by side: one per core, so that fits of single tasks leave none idle."""
    return min(max(FITS, cores), fits)


def side_by_side(spark: SparkSession, run: Callable, jobs: Sequence, parallel: int) -> list:
    """What ``run`` returns for each job, ``parallel`` of them at a time.

    Every job gets local properties of its own: threads that share them take away each
    other's execution id, and a fit fails.
    """
    tasks = [inheritable_thread_target(spark)(partial(run, job)) for job in jobs]
    with ThreadPool(parallel) as pool:
        return pool.map(lambda task: task(), tasks, chunksize=1)


def fit_score(
    name: str,
    train: DataFrame,
    test: DataFrame,
    n_pos: int,
    n_neg: int,
    overrides: Mapping | None = None,
    beside: int = 1,
) -> DataFrame:
    """Fit on ``train`` and return ``test`` with ``prob`` and ``pred`` (fitting runs now).

    ``svm_rbf`` expects both sides mapped by ``model_inputs``; ``beside`` fits share the cores.
    """
    if name == "knn":
        p = parameters(name, overrides)
        columns = [c for c in test.columns if c not in ("window_id", "features")]
        return knn_vote(test, train, keep=columns, x="features", **p)
    if name in BOOSTED:
        sides = [
            t.select("window_id", "y", "features", F.lit(side).alias("_side")) for t, side in ((train, "train"), (test, "test"))
        ]
        fold = {"fold": "test", "pos_train": n_pos, "n_train": n_pos + n_neg}
        scores = boosted_scores(sides[0].unionAll(sides[1]), name, [fold], overrides, "_side")
        scores = scores.select(F.col("window_id").alias("_key"), "prob", "pred")
        return test.drop("features").join(scores, F.col("window_id").eqNullSafe(F.col("_key"))).drop("_key")
    vector = array_to_vector(F.col("features").cast("array<double>"))
    rows = train.withColumns({"vec": vector, "w": weight(name, n_pos, n_neg)})
    tasks = fit_tasks(name, n_pos + n_neg, train.sparkSession.sparkContext.defaultParallelism, beside)
    fitted = rows.select("vec", "y", "w").coalesce(tasks)
    model = build_estimator(name, n_pos + n_neg, overrides).fit(fitted)
    scored = model.transform(test.withColumn("vec", vector))
    if name.startswith("svm"):
        margin = vector_to_array("rawPrediction")[1]
        prob = 1 / (1 + F.exp(-margin))
    else:
        prob = vector_to_array("probability")[1]
    return scored.withColumns({"prob": prob, "pred": F.col("prediction").cast("int")}).drop(
        "vec", "rawPrediction", "probability", "prediction", "features"
    )


def model_inputs(features: DataFrame, name: str, overrides: Mapping | None = None) -> DataFrame:
    """The feature table a model is fitted on; the kernel map is stored once for all folds."""
    if name != "svm_rbf":
        return features
    p = parameters(name, overrides)
    return materialise(fourier_features(features, p["gamma"], p["components"]), "fourier")


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, survives lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def loso_scores(
    features: DataFrame,
    models: Sequence[str],
    overrides: Mapping[str, Mapping] | None = None,
    parallel: int | None = None,
) -> DataFrame:
    """Scores of every window by models fitted without its subject.

    ``features`` holds ``(window_id, subject, y, features)`` and should be a stored
    table. The driver sees one row of counts per subject; fits of different folds run
    side by side, one per core if ``parallel`` does not say otherwise, those of boosted
    trees and of the neighbour vote in the same jobs; scoring stays one lazy union.
    """
    for name in models:
        parameters(name)
    folds = trainable(loso_folds(features)).orderBy("fold").collect()
    together = {n for n in models if n in BOOSTED}
    if "knn" in models and folds and not shared_keys(features):
        together.add("knn")
    jobs = [(n, f) for n in models if n not in together for f in folds]
    jobs += [(n, None) for n in models if n in together and folds]
    inputs = {n: model_inputs(features, n, (overrides or {}).get(n)) for n in models if folds}
    cores = features.sparkSession.sparkContext.defaultParallelism
    parallel = min(parallel or fits_at_once(cores, len(jobs)), len(jobs))

    def run(job) -> DataFrame:
        name, fold = job
        if fold is None:
            own = (overrides or {}).get(name)
            scored = neighbour_scores(inputs[name], folds, own) if name == "knn" else boosted_scores(inputs[name], name, folds, own)
            return scored.select(F.lit(name).alias("model"), "fold", "window_id", "y", "prob", "pred")
        train, test = loso_split(inputs[name], fold["fold"])
        n_pos = fold["pos_train"]
        scored = fit_score(
            name, train, test, n_pos, fold["n_train"] - n_pos, (overrides or {}).get(name), parallel
        )
        return scored.select(
            F.lit(name).alias("model"),
            F.lit(fold["fold"]).alias("fold"),
            "window_id",
            "y",
            "prob",
            "pred",
        )

    if not jobs:
        return features.sparkSession.createDataFrame(
            [], "model string, fold int, window_id bigint, y int, prob double, pred int"
        )
    return reduce(DataFrame.unionByName, side_by_side(features.sparkSession, run, jobs, parallel))


def fold_metrics(scores: DataFrame, by: Sequence[str] = ("model", "fold")) -> DataFrame:
    """Segment metrics, area and class counts per fold."""
    keys = list(by)
    segment = segment_metrics(scores, keys)
    area = auc_roc(scores, keys).withColumnsRenamed(
        {"n_pos": "n_pos_test", "n_neg": "n_neg_test"}
    )
    return segment.join(area, keys)


def draw_parameters(space: Mapping[str, Mapping], trials: int, seed: int = SEED) -> list[dict]:
    """Random settings from a declared space of float, log_float, int and categorical."""
    rng = np.random.default_rng(seed)

    def draw(spec: Mapping):
        kind = spec["type"]
        if kind == "categorical":
            return spec["choices"][int(rng.integers(len(spec["choices"])))]
        low, high = spec["low"], spec["high"]
        if kind == "log_float":
            return float(np.exp(rng.uniform(np.log(low), np.log(high))))
        step = spec.get("step")
        if kind == "int":
            return int(rng.integers(0, (high - low) // (step or 1) + 1)) * (step or 1) + low
        if kind == "float":
            if step:
                return float(low + step * rng.integers(0, int(round((high - low) / step)) + 1))
            return float(rng.uniform(low, high))
        raise ValueError(f"unknown parameter type {kind!r}")

    return [{name: draw(spec) for name, spec in space.items()} for _ in range(trials)]


def search(
    features: DataFrame,
    name: str,
    space: Mapping[str, Mapping],
    trials: int = 10,
    fold: str = "fold",
    parallel: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Mean recall over the given folds of randomly drawn settings, best first.

    ``fold`` numbers the folds from 0 (``splits.stratified_kfold``). All settings and folds
    are fitted side by side, one per core if ``parallel`` does not say otherwise; a setting
    drawn again is not fitted again.
    """
    counts = features.agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).first()
    n_pos, n_neg = int(counts["p"]), int(counts["n"] - counts["p"])
    rows = features.select(
        array_to_vector(F.col("features").cast("array<double>")).alias("vec"),
        F.col("y").cast("double").alias("y"),
        F.col(fold).cast("int").alias(fold),
        weight(name, n_pos, n_neg).alias("w"),
    )
    drawn = draw_parameters(space, trials, seed)
    if name in BOOSTED:
        return _ranked(features.sparkSession, drawn, _boosted_recalls(features, name, drawn, fold))
    estimator = build_estimator(name, n_pos + n_neg)
    recall = MulticlassClassificationEvaluator(
        labelCol="y", metricName="recallByLabel", metricLabel=1.0
    )
    spark = features.sparkSession
    different = {json.dumps(setting, sort_keys=True): setting for setting in drawn}
    rows.persist()
    n_folds = int(rows.agg(F.max(fold)).first()[0]) + 1
    kept = CrossValidator(numFolds=n_folds, foldCol=fold)._kFold(rows)
    # Deep forests take longest and are begun first.
    jobs = [(i, setting) for setting in sorted(different, key=lambda s: -_work(different[s])) for i in range(n_folds)]

    def run(job) -> float:
        train, validation = kept[job[0]]
        grid = {estimator.getParam(k): v for k, v in different[job[1]].items()}
        return recall.evaluate(estimator.fit(train, grid).transform(validation))

    parallel = parallel or fits_at_once(spark.sparkContext.defaultParallelism, len(jobs))
    try:
        found = dict(zip(jobs, side_by_side(spark, run, jobs, parallel)))
    finally:
        rows.unpersist()
    means = {s: float(np.mean([found[i, s] for i in range(n_folds)])) for s in different}
    return _ranked(spark, drawn, [means[json.dumps(setting, sort_keys=True)] for setting in drawn])


def _work(setting: Mapping) -> float:
    """What the levels of a forest's trees amount to, in no unit."""
    return setting.get("maxDepth", 0) * setting.get("numTrees", 1)


def _boosted_recalls(features: DataFrame, name: str, drawn: Sequence[Mapping], fold: str) -> list[float]:
    """Mean recall over the folds of each setting."""
    counts = loso_folds(features.withColumn(fold, F.col(fold).cast("int")), fold).orderBy("fold").collect()
    means = []
    for setting in drawn:
        scores = boosted_scores(features.withColumn(fold, F.col(fold).cast("int")), name, counts, setting, fold)
        means.append(segment_metrics(scores, ["fold"]).agg(F.avg("recall")).first()[0])
    return means


def _ranked(spark: SparkSession, drawn: Sequence[Mapping], means: Sequence[float]) -> DataFrame:
    table = [(i, json.dumps(s, sort_keys=True), float(m)) for i, (s, m) in enumerate(zip(drawn, means))]
    found = spark.createDataFrame(table, "trial int, params string, recall double")
    return found.orderBy(F.desc("recall"), "trial")
