import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from paroxys.operators import audit, features, splits
from paroxys.plans import experiment, models
from paroxys.plans.evaluate import evaluate
from paroxys.plans.prepare import Preparation, prepare, skipped
from paroxys.sources import datasets


@pytest.fixture(scope="module")
def table(spark):
    """Separable features of four subjects; subject 3 has no positives."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        subject, y = i % 4, int(i % 4 != 3 and i % 5 == 0)
        rows.append((i, subject, y, (rng.normal(size=6) + 6 * y).tolist()))
    return spark.createDataFrame(rows, "window_id bigint, subject int, y int, features array<double>")


@pytest.mark.parametrize("name", ["random_forest", "svm_linear", "svm_rbf", "xgboost", "lightgbm", "knn"])
def test_models_separate_the_classes(table, name):
    small = {
        "random_forest": {"numTrees": 5, "maxDepth": 3},
        "xgboost": {"rounds": 10, "depth": 2},
        "lightgbm": {"rounds": 10, "leaves": 4, "min_rows": 5},
        "svm_rbf": {"gamma": 0.05, "components": 64, "maxIter": 20},
        "svm_linear": {"maxIter": 20},
    }
    scores = models.loso_scores(table, [name], {name: small.get(name, {})})
    rows = models.fold_metrics(models.materialise(scores, "t")).collect()
    assert sorted(r["fold"] for r in rows) == [0, 1, 2]
    assert np.mean([r["recall"] for r in rows]) > 0.8
    assert np.mean([r["auc_roc"] for r in rows]) > 0.9
    assert all(r["n_pos_test"] + r["n_neg_test"] == 30 for r in rows)


def test_unknown_model(table):
    with pytest.raises(ValueError, match="unknown model"):
        models.loso_scores(table, ["svm"])
    assert models.model_names() == sorted(models.DEFAULTS)


def test_no_fold_gives_no_scores(table):
    assert models.loso_scores(table.where("y = 0"), ["svm_linear"]).count() == 0


def test_experiment_rows_and_sinks(spark, table, tmp_path):
    results = experiment.run_experiment(
        {"d": table}, ["svm_linear", "svm"], max_subjects=3, max_windows=80,
        overrides={"svm_linear": {"maxIter": 5}},
    )
    rows = {r["model"]: r for r in results.collect()}
    assert rows["svm_linear"]["status"] == "ok" and rows["svm_linear"]["n_folds"] >= 2
    assert rows["svm"]["status"] == "error" and "unknown model" in rows["svm"]["error"]
    path = str(tmp_path / "results")
    datasets.append_results(results, path, "first")
    datasets.append_results(results.withColumn("extra", F.lit(1)), path, "second")
    stored = datasets.read_results(spark, path)
    assert stored.count() == 4 and stored.where("extra = 1").count() == 2
    board = experiment.leaderboard(results).collect()
    assert board[0]["model"] == "svm_linear" and board[1]["recall"] == "-"


def test_loso_json(spark, table, tmp_path):
    from paroxys.operators.metrics import fold_summary

    scores = models.loso_scores(table, ["svm_linear"], {"svm_linear": {"maxIter": 5}})
    folds = models.fold_metrics(models.materialise(scores, "t"))
    summary = fold_summary(folds, ["recall", "f1"], ["model"])
    datasets.write_loso(folds, summary, str(tmp_path / "loso"))
    stored = spark.read.json(str(tmp_path / "loso")).first()
    assert stored["n_folds"] == 3 and len(stored["folds"]) == 3
    assert stored["mean"]["recall"] is not None and stored["std"]["f1"] is not None


def test_search_orders_by_recall(table):
    space = {
        "maxDepth": {"type": "int", "low": 1, "high": 3},
        "numTrees": {"type": "categorical", "choices": [2, 4]},
    }
    found = models.search(splits.stratified_kfold(table, 2), "random_forest", space, trials=2).collect()
    assert len(found) == 2 and found[0]["recall"] >= found[1]["recall"]
    assert set(json.loads(found[0]["params"])) == set(space)


def test_search_of_boosted_trees(table):
    space = {"depth": {"type": "int", "low": 1, "high": 2}, "rounds": {"type": "categorical", "choices": [2, 4]}}
    found = models.search(splits.stratified_kfold(table, 2), "xgboost", space, trials=2).collect()
    assert len(found) == 2 and found[0]["recall"] >= found[1]["recall"] > 0.8


def test_drawn_parameters_stay_in_their_space():
    space = {
        "a": {"type": "log_float", "low": 1e-5, "high": 1e-2},
        "b": {"type": "float", "low": 0.0, "high": 0.5, "step": 0.05},
        "c": {"type": "int", "low": 3, "high": 9, "step": 3},
        "d": {"type": "categorical", "choices": ["x", "y"]},
    }
    for s in models.draw_parameters(space, 50):
        assert 1e-5 <= s["a"] <= 1e-2 and 0 <= s["b"] <= 0.5 and s["c"] in (3, 6, 9) and s["d"] in "xy"
    assert models.draw_parameters(space, 3) == models.draw_parameters(space, 3)
    with pytest.raises(ValueError):
        models.draw_parameters({"a": {"type": "odd", "low": 0, "high": 1}}, 1)


@pytest.fixture(scope="module")
def corpus(spark):
    """Two subjects at 8 Hz for 600 s; a third recording lacks the channels."""
    rows = []
    for subject, recording, names in (
        ("PN00", "PN00-1", ("EEG T3", "F7")),
        ("PN01", "PN01-1", ("EEG T3", "F7")),
        ("PN01", "PN01-2", ("CZ",)),
    ):
        rng = np.random.default_rng(len(rows))
        for name in names:
            rows += [(subject, recording, name, i, float(v)) for i, v in enumerate(rng.normal(size=4800))]
    samples = spark.createDataFrame(rows, "subject string, recording string, channel string, i bigint, value double")
    seizures = spark.createDataFrame(
        [("PN00", "PN00-1.edf", 400.0, 420.0)],
        "subject string, recording string, onset_sec double, offset_sec double",
    )
    return samples, seizures


CFG = Preparation(
    channels=("T7", "F7"),
    source_rate=8,
    rate=4,
    window_sec=8.0,
    stride_sec=4.0,
    filters=[((0.5, 0.5), (1.0, 0.0))],
    wavelet_filter=True,
    sop_sec={"y_sop1": 60.0, "y_sop2": 120.0},
    sph_sec=30.0,
    postictal_sec=60.0,
)


def test_preparation_end_to_end(spark, corpus, tmp_path):
    samples, seizures = corpus
    done = prepare(samples, seizures, CFG)
    rows = done.collect()
    starts = {r["start_sec"] for r in rows if r["recording"] == "PN00-1"}
    assert {r["channel"] for r in rows} == {"T7", "F7"}
    assert all(len(r["x"]) == 32 for r in rows)
    assert not any(370 - 8 < s < 480 for s in starts) and 360.0 in starts and 480.0 in starts
    labels = {r["start_sec"]: (r["y_sop1"], r["y_sop2"]) for r in rows if r["subject"] == "PN00"}
    assert labels[312.0] == (1, 1) and labels[280.0] == (0, 1) and labels[200.0] == (0, 0)
    assert {(r["y_sop1"], r["y_sop2"]) for r in rows if r["subject"] == "PN01"} == {(0, 0)}
    lost = skipped(samples, CFG).collect()
    assert [r["recording"] for r in lost] == ["PN01-2"]

    path = str(tmp_path / "windows")
    datasets.write_windows(done, path)
    back = datasets.read_windows(spark, path, "y_sop2")
    assert "y_sop1" not in back.columns and back.count() == len(rows)
    first = back.where("k = 0").select("recording", "k")
    assert datasets.read_windows(spark, path, "y_sop1", first).select("k").distinct().count() == 1
    with pytest.raises(ValueError):
        datasets.read_windows(spark, path, "y_sop9")
    report = datasets.validate(spark.read.parquet(path), ["y_sop1", "y_sop2"], ["x", "y_sop1"], 2).first()
    assert report["valid"] and report["missing"] == ""
    meta = audit.metadata(
        back, {"dataset": "demo", "labeling": {"mode": "prediction"}}, skipped(samples, CFG)
    )
    datasets.write_metadata(meta, str(tmp_path / "meta"))
    stored = json.loads(spark.read.text(str(tmp_path / "meta")).first()[0])
    assert stored["dataset"] == "demo" and stored["skipped_no_channels"] == 1
    assert stored["labeling"]["mode"] == "prediction"


def test_preparation_modes(corpus):
    import dataclasses

    samples, seizures = corpus
    found = prepare(samples, seizures, dataclasses.replace(CFG, mode="detection", wavelet_filter=False))
    hits = {r["start_sec"] for r in found.where("y = 1").collect()}
    assert hits == {396.0, 400.0, 404.0, 408.0, 412.0, 416.0}
    with pytest.raises(ValueError):
        prepare(samples, seizures, dataclasses.replace(CFG, mode="other"))


def test_cutting_does_not_shuffle_signals_twice(spark, corpus):
    samples, seizures = corpus
    import dataclasses

    plain = dataclasses.replace(CFG, rate=8, filters=(), wavelet_filter=False, normalise=None)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = prepare(samples, seizures, plain)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("REPARTITION_BY_COL") == 1
    above = plan.split("REPARTITION_BY_COL")[0].splitlines()
    trunk = [line for line in above if line.lstrip("+- :*()0123456789").startswith("Exchange")]
    assert len(trunk) == 1


def test_stored_features_are_used(spark):
    rows = spark.createDataFrame(
        [(1, 0, 1, c, [1.0, 2.0, 3.0, 5.0] * 8) for c in (0, 1)],
        "window_id bigint, subject int, y int, ch int, x array<double>",
    )
    computed = features.features_or_stored(rows, None, level=1).first()
    assert len(computed["features"]) == 40
    stored = spark.createDataFrame([(1, [9.0])], "window_id bigint, features array<double>")
    assert features.features_or_stored(rows, stored).collect()[0]["features"] == [9.0]


def test_evaluation_row(spark, sequences):
    row = evaluate(sequences.withColumn("fold", F.lit(0)), group=["fold", "user_id"]).first()
    assert row["n_windows"] == sequences.count() and 0 <= row["auc_roc"] <= 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merged_dataset_moves_no_signals(spark, tmp_path):
    keys = ["recording", "k"]
    rows = [(f"r{i % 3}", i, [float(i)] * 4, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "recording string, k bigint, x array<double>, y int")

    def store(part, name):
        return datasets.write_bucketed(part, str(tmp_path / name), keys, 4)

    signals = store(df.select(*keys, "x"), "signals")
    first, second = store(df.select(*keys, "y"), "first"), store(df.select(*keys, (1 - F.col("y")).alias("y")), "second")
    vectors = store(df.select(*keys, F.array("k").alias("features")), "features")
    merged = datasets.merge_dataset(spark, signals, {"y_a": first, "y_b": second}, keys, vectors)
    got = {(r["recording"], r["k"]): (r["x"], r["y_a"], r["y_b"], r["features"]) for r in merged.collect()}
    assert got == {(r, k): (x, y, 1 - y, [k]) for r, k, x, y in rows}
    assert "hashpartitioning" not in _plan(merged)
    again = df.select(*keys, "y").where("k > 0")
    twice = store(again.unionAll(again.where("k = 1")), "twice")
    short = store(df.select(*keys, "y").where("k > 0"), "short")
    with pytest.raises(Exception, match="listed twice"):
        datasets.merge_dataset(spark, signals, {"y": twice}, keys).collect()
    other = store(df.select(*keys, "y").where("k > 0").unionAll(spark.createDataFrame([("r9", 9, 1)], "a string, b bigint, c int")), "other")
    for wrong in (short, other):
        with pytest.raises(Exception, match="different windows"):
            datasets.merge_dataset(spark, signals, {"y": wrong}, keys).collect()


def test_a_retried_run_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.range(3).withColumnRenamed("id", "v")
    for run in ("one", "two", "one"):
        datasets.append_results(rows, path, "e", run)
    assert datasets.read_results(spark, path).count() == 6


def test_an_experiment_goes_on_where_it_was_cut_off(table, tmp_path, monkeypatch):
    ledger = str(tmp_path / "ledger")
    tables, names, settings = {"d": table}, ["knn", "random_forest"], {"random_forest": {"numTrees": 3}}
    real, calls = experiment._run, []

    def cut_off(part, model, overrides):
        calls.append(model)
        if model == "random_forest":
            raise KeyboardInterrupt
        return real(part, model, overrides)

    monkeypatch.setattr(experiment, "_run", cut_off)
    with pytest.raises(KeyboardInterrupt):
        experiment.run_experiment(tables, names, overrides=settings, ledger=ledger)
    monkeypatch.setattr(experiment, "_run", lambda *a: calls.append(a[1]) or real(*a))
    rows = experiment.run_experiment(tables, names, overrides=settings, ledger=ledger).collect()
    assert calls == ["knn", "random_forest", "random_forest"]
    assert [(r["model"], r["status"]) for r in rows] == [("knn", "ok"), ("random_forest", "ok")]
    again = experiment.run_experiment(tables, names, overrides=settings, ledger=ledger).collect()
    assert again == rows and len(calls) == 3


def test_all_checks_of_a_sound_dataset_pass(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s in range(3):
        for k in range(40):
            for ch in ("F7", "F8"):
                rows.append((f"s{s}", f"rec{s}", k, ch, int(k == 7), (rng.normal(size=64) * 0.7).tolist()))
    df = spark.createDataFrame(rows, "subject string, recording string, k bigint, channel string, y int, x array<float>")
    settings = {
        "rate": 256, "window_sec": 4.0, "stride_sec": 1.0, "normalisation": "zscore", "mode": "prediction",
        "sop_minutes": 15.0, "sph_minutes": 5.0,
    }
    expected = {"channels": ("F7", "F8"), "length": 64, "windows": 100, "subjects": 3, "eligible": 3, "recordings": 3}
    figures = audit.window_figures(df)
    rows = {r["check"]: r["status"] for r in audit.conformance(figures, settings, expected).collect()}
    assert len(rows) == 27
    # One positive of forty is a share of 2.5 %, within the first range and below the second.
    assert {k for k, v in rows.items() if v != "PASS"} <= {"sop", "share", "window_mean"}
    assert rows["sop"] == "WARN" and rows["share"] == "FAIL"
    off = {r["check"]: r["status"] for r in audit.conformance(figures, {**settings, "sph_minutes": 1.0, "mode": "x"}).collect()}
    assert off["sph"] == off["mode"] == off["ready_subjects"] == off["channels"] == "FAIL"


def test_svm_fits_share_the_cores_and_forests_follow_the_rows():
    """fits side by side have about two tasks per core together, however many rows; F3: one fit per core."""
    assert models.fit_tasks("svm_linear", 9_230, 12, 10) == 1
    assert models.fit_tasks("svm_linear", 554_000, 12, 10) == 3
    assert models.fit_tasks("svm_linear", 554_000, 100, 4) == 28
    assert models.fit_tasks("svm_rbf", 5_000_000, 12, 10) == 13
    assert models.fit_tasks("random_forest", 554_000, 12, 10) == 28
    assert [models.fits_at_once(12, 10), models.fits_at_once(8, 10), models.fits_at_once(1, 10)] == [10, 8, 4]


def test_folds_are_fitted_one_per_core(spark, monkeypatch):
    """six folds on eight cores are fitted at the same time; four at once left cores idle."""
    together = threading.Barrier(6)
    rows = spark.createDataFrame(
        [(i, i % 6, int(i // 6 % 2), [float(i)]) for i in range(36)], "window_id bigint, subject int, y int, features array<double>"
    )

    def fit(name, train, test, n_pos, n_neg, overrides, beside=6):
        together.wait(20)
        return test.select("window_id", "y", F.lit(0.5).alias("prob"), F.lit(beside).alias("pred"))

    monkeypatch.setattr(models, "fit_score", fit)
    scores = models.loso_scores(rows, ["random_forest"])
    assert {r.pred for r in scores.collect()} == {6} and scores.count() == 36


def test_neighbours_of_all_folds_are_looked_for_at_once(table, monkeypatch):
    """one vote for all folds, with the scores of a vote per fold; keys that subjects share still get a vote per fold."""
    votes = []
    vote = models.knn_vote
    monkeypatch.setattr(models, "knn_vote", lambda *args, **options: votes.append(1) or vote(*args, **options))

    def scores(rows):
        votes.clear()
        found = models.loso_scores(rows, ["knn"]).select("fold", "window_id", "y", "prob", "pred").collect()
        return sorted((r["fold"], r["window_id"], r["y"], round(r["prob"], 9), r["pred"]) for r in found), len(votes)

    def by_fold(rows):
        found = []
        for fold in (0, 1, 2):
            train, test = splits.loso_split(rows, fold)
            scored = models.fit_score("knn", train, test, 1, 1).withColumn("fold", F.lit(fold))
            found += [(fold, r["window_id"], r["y"], round(r["prob"], 9), r["pred"]) for r in scored.collect()]
        return sorted(found)

    assert scores(table) == (by_fold(table), 1)
    shared = table.withColumn("window_id", F.floor(F.col("window_id") / 4))
    assert scores(shared) == (by_fold(shared), 3)


def test_fits_side_by_side_keep_their_local_properties(spark, monkeypatch):
    """F3 F4: threads that shared them lost their execution id at times (Cannot parse null string)."""
    together, context = threading.Barrier(4), spark.sparkContext
    rows = spark.createDataFrame(
        [(i, i % 4, int(i // 4 % 2), [float(i)]) for i in range(32)], "window_id bigint, subject int, y int, features array<double>"
    )

    def fit(name, train, test, n_pos, n_neg, overrides, beside=4):
        own = threading.current_thread().name
        together.wait(20)
        context.setLocalProperty("test.own", own)
        together.wait(20)
        kept = context.getLocalProperty("test.own") == own
        return test.select("window_id", "y", F.lit(0.5).alias("prob"), F.lit(int(kept)).alias("pred"))

    monkeypatch.setattr(models, "fit_score", fit)
    assert {r.pred for r in models.loso_scores(rows, ["random_forest"]).collect()} == {1}


def test_a_setting_drawn_again_is_not_fitted_again(table, monkeypatch):
    """a fit per fold and different setting, with the recalls of Spark's own search."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator

    rows = splits.stratified_kfold(table, 2)
    space = {"maxDepth": {"type": "int", "low": 1, "high": 2}, "numTrees": {"type": "categorical", "choices": [2]}}
    fits = []
    fit = models.RandomForestClassifier._fit
    monkeypatch.setattr(models.RandomForestClassifier, "_fit", lambda self, rows: fits.append(1) or fit(self, rows))
    found = models.search(rows, "random_forest", space, trials=6).collect()
    assert len(found) == 6 and len({r["params"] for r in found}) == 2 and len(fits) == 4
    estimator = models.build_estimator("random_forest", 120)
    settings = [{"maxDepth": 1, "numTrees": 2}, {"maxDepth": 2, "numTrees": 2}]
    n_pos = table.where("y = 1").count()
    ready = rows.select(
        array_to_vector("features").alias("vec"), F.col("y").cast("double").alias("y"), F.col("fold").cast("int").alias("fold"),
        models.weight("random_forest", n_pos, 120 - n_pos).alias("w"),
    )
    recall = MulticlassClassificationEvaluator(labelCol="y", metricName="recallByLabel", metricLabel=1.0)
    grid = [{estimator.getParam(k): v for k, v in setting.items()} for setting in settings]
    means = CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, evaluator=recall, numFolds=2, foldCol="fold"
    ).fit(ready).avgMetrics
    assert {r["params"]: r["recall"] for r in found} == {json.dumps(s, sort_keys=True): m for s, m in zip(settings, means)}
