"""Named queries over the driver tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paroxys import fixtures as fx
from paroxys.functions import channels
from paroxys.functions.scores import decide, scrub
from paroxys.operators import (
    alarms,
    annotations,
    audit,
    augment,
    features,
    labels,
    matching,
    metrics,
    neighbours,
    recursive,
    splits,
    windows,
)
from paroxys.plans import boosting, experiment, models
from paroxys.plans.evaluate import evaluate
from paroxys.plans.prepare import Preparation, prepare
from paroxys.session import shared_folder
from paroxys.sources import datasets, records
from paroxys.streaming import online

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(col: str | Column) -> Column:
    return F.round(col, 6)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles to some digits, so sums in another order compare equal."""
    return df.select(
        *[F.round(n, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes]
    )


def array_digest(x: str) -> list[Column]:
    """Length, sum and position-weighted sum of an array."""
    places = F.sequence(F.lit(1), F.size(x))
    weighted = F.zip_with(x, places, lambda v, j: v * j)
    zero = F.lit(0.0)
    return [
        F.size(x).alias("n"),
        r6(F.aggregate(x, zero, lambda a, v: a + v)).alias("total"),
        r6(F.aggregate(weighted, zero, lambda a, v: a + v)).alias("weighted"),
    ]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events labelled for all three occurrence periods, excluded windows dropped."""
    rows = labels.label_prediction(
        fx.windows(spark, sf_dir),
        fx.seizures(spark, sf_dir),
        fx.WINDOW_SEC,
        {f"y_sop{m}": s for m, s in fx.SOP_SEC.items()},
        fx.SPH_SEC,
        fx.POSTICTAL_SEC,
        chunk_sec=fx.MINUTE,
    )
    return labels.drop_excluded(rows, "y_sop15")


def channel_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.samples(spark, sf_dir).withColumn("channel", channels.normal_name("ch_raw"))


# --- sources, channels, recordings -----------------------------------------------


@query
def record_index(spark, sf_dir):
    paths = fx.table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    return records.record_index(paths, "pages")


@query
def channel_normalise(spark, sf_dir):
    raw = F.create_map(*[F.lit(x) for p in fx.RAW_CHANNELS.items() for x in p])
    rows = fx.table(spark, sf_dir, "events").withColumn("ch_raw", raw[F.col("event_type")])
    return rows.groupBy("ch_raw", channels.normal_name("ch_raw").alias("channel")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def channel_select(spark, sf_dir):
    raw = F.create_map(*[F.lit(x) for p in fx.RAW_CHANNELS.items() for x in p])
    rows = fx.table(spark, sf_dir, "events").select(
        "user_id", channels.normal_name(raw[F.col("event_type")]).alias("channel")
    )
    return channels.wearable_channels(rows, max_channels=3)


@query
def skipped_recordings(spark, sf_dir):
    raw = F.create_map(*[F.lit(x) for p in fx.RAW_CHANNELS.items() for x in p])
    rows = fx.table(spark, sf_dir, "events").select(
        "user_id", channels.normal_name(raw[F.col("event_type")]).alias("channel")
    )
    return channels.channel_coverage(rows, ["F8", "P7"])


@query
def recording_match(spark, sf_dir):
    stems = fx.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("subject"), F.col("c_name").alias("stem")
    )
    name = F.replace(F.col("s_name"), F.lit("Supplier"), F.lit("Customer"))
    variant = F.col("s_suppkey") % 3
    annotated = fx.table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("subject"),
        F.when(variant == 0, F.concat(name, F.lit(".edf")))
        .when(variant == 1, F.expr("right(s_name, 3)"))
        .otherwise(F.concat(F.expr("left(replace(s_name, 'Supplier', 'Customer'), 17)"), F.lit("--.edf")))
        .alias("recording"),
    )
    return matching.match_recordings(stems, annotated)


@query
def subject_lookup(spark, sf_dir):
    """Recordings with their subject's dense id; nations without one keep a null."""
    nations = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("subject"), "n_name")
    ids = audit.subject_map(
        fx.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("subject"))
    )
    recs = fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey"), F.col("c_nationkey").alias("subject")
    )
    known = labels.lookup_subjects(recs, ids)
    return labels.lookup_subjects(known, nations).groupBy("subject", "subject_id", "n_name").agg(
        F.count(F.lit(1)).alias("n_records")
    )


# --- signal ------------------------------------------------------------------------


@query
def sliding_windows(spark, sf_dir):
    cut = windows.sliding_windows_by_copy(fx.samples(spark, sf_dir), 16, 12)
    return cut.select("user_id", "k", "start", *array_digest("x"))


@query
def sliding_windows_chunked(spark, sf_dir):
    cut = windows.sliding_windows(fx.samples(spark, sf_dir), 16, 4)
    return windows.start_seconds(cut, 4, 256.0).select(
        "user_id", "k", "start", r6("start_sec").alias("start_sec"), *array_digest("x")
    )


@query
def zscore(spark, sf_dir):
    rows = windows.zscore(channel_samples(spark, sf_dir), out="z")
    return rows.select("event_id", "channel", r6("z").alias("z"))


@query
def minmax(spark, sf_dir):
    rows = windows.minmax(channel_samples(spark, sf_dir), out="z")
    return rows.select("event_id", "channel", r6("z").alias("z"))


@query
def window_zscore(spark, sf_dir):
    rows = windows.zscore_window(fx.vectors(spark, sf_dir), out="z")
    return rows.select("window_id", *array_digest("z"))


@query
def downsample(spark, sf_dir):
    return rounded(windows.downsample(fx.samples(spark, sf_dir), 512, 256))


@query
def trend_seasonal(spark, sf_dir):
    rows = windows.trend_seasonal(fx.samples(spark, sf_dir), 25)
    return rounded(rows.select("user_id", "i", "trend", "seasonal"))


@query
def iir_filter(spark, sf_dir):
    """Second-order low-pass at a quarter of the sampling rate, forward and backward."""
    low = (0.2928932188134524, 0.5857864376269049, 0.2928932188134524)
    rows = recursive.iir_filter(fx.samples(spark, sf_dir), low, (1.0, 0.0, 0.1715728752538099))
    return rounded(rows.select("user_id", "i", "value"))


# --- annotations and labels ---------------------------------------------------------


@query
def siena_intervals(spark, sf_dir):
    return rounded(annotations.siena_intervals(fx.siena_texts(spark, sf_dir)))


@query
def chbmit_intervals(spark, sf_dir):
    found = annotations.chbmit_intervals(fx.chbmit_texts(spark, sf_dir))
    return rounded(
        found.select(
            "subject",
            "recording",
            "onset_sec",
            "offset_sec",
            "duration_sec",
            F.expr("file_start.h * 3600 + file_start.m * 60 + file_start.s").alias("start_clock"),
            F.expr("file_end.h * 3600 + file_end.m * 60 + file_end.s").alias("end_clock"),
        )
    )


@query
def seizure_counts(spark, sf_dir):
    texts = fx.chbmit_texts(spark, sf_dir)
    return annotations.seizure_counts(texts, annotations.chbmit_intervals(texts))


@query
def label_detection(spark, sf_dir):
    return labels.label_detection(
        fx.windows(spark, sf_dir), fx.seizures(spark, sf_dir), fx.WINDOW_SEC, 0.2, chunk_sec=fx.MINUTE
    ).select("user_id", "window_id", "y")


@query
def label_prediction(spark, sf_dir):
    return labels.label_prediction(
        fx.windows(spark, sf_dir),
        fx.seizures(spark, sf_dir),
        fx.WINDOW_SEC,
        fx.SOP_SEC[15],
        fx.SPH_SEC,
        fx.POSTICTAL_SEC,
        chunk_sec=fx.MINUTE,
    ).select("user_id", "window_id", "y")


@query
def label_multi_sop(spark, sf_dir):
    return labelled(spark, sf_dir).drop("start_sec")


@query
def label_merge(spark, sf_dir):
    """Label sets stored apart, brought together by window key."""
    rows = models.materialise(labelled(spark, sf_dir), "labels")
    variants = {f"y_sop{m}": rows.withColumnRenamed(f"y_sop{m}", "y") for m in fx.SOP_SEC}
    return labels.merge_labels(variants, ["user_id", "window_id"])


# --- audits --------------------------------------------------------------------------


@query
def class_balance(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumnRenamed("y_sop15", "y")
    return rounded(audit.class_balance(rows, "user_id"))


@query
def sop_table(spark, sf_dir):
    names = [f"y_sop{m}" for m in (5, 10, 15)]
    return rounded(audit.label_table(labelled(spark, sf_dir), names))


@query
def sop_table_by_subject(spark, sf_dir):
    names = [f"y_sop{m}" for m in (5, 10, 15)]
    return rounded(audit.label_table(labelled(spark, sf_dir), names, ["user_id"]))


def _summary(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumnRenamed("y_sop15", "y")
    rows = rows.withColumn("subject", F.col("user_id") % 10)
    return audit.dataset_summary(rows, "subject", "user_id")


@query
def dataset_summary(spark, sf_dir):
    return rounded(_summary(spark, sf_dir))


@query
def structure_checks(spark, sf_dir):
    return rounded(audit.structure_checks(_summary(spark, sf_dir)))


def _conformance(spark, sf_dir):
    rows = _prepared(spark, sf_dir).withColumnRenamed("y_far", "y")
    settings = {
        "rate": 1, "window_sec": 8.0, "stride_sec": 4.0, "normalisation": "zscore", "mode": "prediction",
        "sop_minutes": 16.0, "sph_minutes": 5.0,
    }
    return audit.conformance(audit.window_figures(rows), settings)


@query
def conformance(spark, sf_dir):
    """All checks of the prepared dataset."""
    return rounded(_conformance(spark, sf_dir))


@query
def conformance_counts(spark, sf_dir):
    return audit.status_counts(_conformance(spark, sf_dir))


@query
def channel_correlation(spark, sf_dir):
    return rounded(audit.channel_correlation(fx.channel_vectors(spark, sf_dir)))


@query
def norm_audit(spark, sf_dir):
    return rounded(audit.norm_audit(fx.channel_vectors(spark, sf_dir), ["ch"]))


# --- metrics ---------------------------------------------------------------------------


@query
def class_weights(spark, sf_dir):
    return rounded(splits.class_weights(fx.vectors(spark, sf_dir)))


@query
def sample_weights(spark, sf_dir):
    rows = splits.sample_weights(fx.vectors(spark, sf_dir))
    return rounded(rows.select("window_id", "y", "weight"))


@query
def binary_weights(spark, sf_dir):
    return rounded(splits.binary_weights(fx.flat_scores(spark, sf_dir), by=["fold"]))


@query
def score_decisions(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    logits = events.select("event_id", ((F.col("value") - 50) / 50).alias("l1"))
    return rounded(decide(logits.withColumn("l0", -F.col("l1"))).drop("l0", "l1"))


@query
def segment_metrics(spark, sf_dir):
    return rounded(metrics.segment_metrics(fx.flat_scores(spark, sf_dir), ["user_id"]))


@query
def auc_roc(spark, sf_dir):
    return rounded(metrics.auc_roc(fx.flat_scores(spark, sf_dir)))


@query
def auc_roc_by_fold(spark, sf_dir):
    return rounded(metrics.auc_roc(fx.flat_scores(spark, sf_dir), ["fold"]))


@query
def threshold_sweep(spark, sf_dir):
    scores = fx.flat_scores(spark, sf_dir)
    return rounded(metrics.threshold_sweep(scores, with_auc="prob"))


@query
def threshold_sweep_voted(spark, sf_dir):
    """The sweep after majority vote and collar merge at every threshold."""
    level = alarms.vote_level(fx.scored(spark, sf_dir), 3, 2, collar=3)
    return rounded(metrics.threshold_sweep(level, level="level", n_thresholds=21))


@query
def threshold_sweep_callable(spark, sf_dir):
    """The same sweep with the post-processing given as a function of the decisions."""

    def post(rows, group):
        return alarms.vote_and_merge(rows, 3, 2, 3, group=group)

    scores = fx.scored(spark, sf_dir).select("user_id", "k", "y", "prob")
    cut = alarms.per_threshold(scores, metrics.even_thresholds(21), post)
    return rounded(metrics.segment_metrics(cut, ["threshold"]))


@query
def operating_point(spark, sf_dir):
    sweep = metrics.threshold_sweep(fx.flat_scores(spark, sf_dir))
    return rounded(metrics.operating_point(sweep, 4.0, 200.0))


@query
def loso_summary(spark, sf_dir):
    folds = metrics.segment_metrics(fx.flat_scores(spark, sf_dir), ["fold"])
    return rounded(metrics.fold_summary(folds, metrics.METRICS))


@query
def full_evaluation(spark, sf_dir):
    """Segment, area and event metrics per fold of subjects, from logits."""
    rows = decide(fx.scored(spark, sf_dir).drop("prob", "pred"))
    rows = rows.withColumn("fold", (F.col("user_id") % 10).cast("int"))
    return rounded(evaluate(rows, by=["fold"], group=["fold", "user_id"]))


@query
def loso_event_summary(spark, sf_dir):
    events = alarms.event_metrics(
        fx.scored(spark, sf_dir).withColumn("fold", F.col("user_id") % 10),
        by=["fold"],
        group=["fold", "user_id"],
    )
    return rounded(metrics.fold_summary(events, ("fp_per_hour", "detection_rate", "hours")))


@query
def ensemble_quantile(spark, sf_dir):
    return rounded(metrics.ensemble_quantile(fx.ensemble(spark, sf_dir), 0.6))


@query
def loss_metrics(spark, sf_dir):
    return rounded(metrics.loss_metrics(fx.flat_scores(spark, sf_dir), by=["fold"]))


# --- alarms -------------------------------------------------------------------------------


@query
def majority_vote(spark, sf_dir):
    return alarms.majority_vote(fx.scored(spark, sf_dir)).select("user_id", "k", "pred")


@query
def majority_vote_even(spark, sf_dir):
    voted = alarms.majority_vote(fx.scored(spark, sf_dir), n=4, k=3)
    return voted.select("user_id", "k", "pred")


@query
def ema(spark, sf_dir):
    return rounded(
        alarms.ema_smooth(fx.scored(spark, sf_dir), 0.3, 0.5).select("user_id", "k", "ema", "ema_pred")
    )


@query
def collar_merge(spark, sf_dir):
    return alarms.collar_merge(fx.scored(spark, sf_dir)).select("user_id", "k", "pred")


@query
def alarm_runs(spark, sf_dir):
    return alarms.alarm_runs(fx.scored(spark, sf_dir))


@query
def event_metrics(spark, sf_dir):
    return rounded(alarms.event_metrics(fx.scored(spark, sf_dir)))


@query
def event_metrics_any(spark, sf_dir):
    return rounded(alarms.event_metrics(fx.scored(spark, sf_dir), 1.0, credit="any", by=()))


@query
def vote_then_merge(spark, sf_dir):
    return alarms.vote_and_merge(fx.scored(spark, sf_dir)).select("user_id", "k", "pred")


@query
def alarm_events(spark, sf_dir):
    """Event metrics of voted and merged alarms."""
    return rounded(alarms.event_metrics(alarms.vote_and_merge(fx.scored(spark, sf_dir)), by=()))


# --- features -----------------------------------------------------------------------------


def _dwt(spark, sf_dir, level):
    rows = fx.vectors(spark, sf_dir).select("window_id", "x")
    for _ in range(level - 1):
        rows = features.dwt_level(rows).select("window_id", F.col("approx").alias("x"))
    bands = [F.struct(F.lit(b).alias("band"), F.col(b).alias("x")) for b in ("approx", "detail")]
    cut = features.dwt_level(rows).select("window_id", F.explode(F.array(*bands)).alias("b"))
    return cut.select("window_id", "b.*").select("window_id", "band", *array_digest("x"))


@query
def dwt_level1(spark, sf_dir):
    return _dwt(spark, sf_dir, 1)


@query
def dwt_level2(spark, sf_dir):
    return _dwt(spark, sf_dir, 2)


@query
def dwt_bands(spark, sf_dir):
    """Three levels of coefficients from the batch kernel."""
    rows = features.dwt_bands(fx.vectors(spark, sf_dir).select("window_id", "x"), 3)
    return rows.select("window_id", "band", *array_digest("x"))


@query
def band_stats(spark, sf_dir):
    stats = features.band_stats(fx.vectors(spark, sf_dir).select("window_id", "x"))
    return rounded(
        stats.select("window_id", "min", "max", "mean", "var", "std", "skewness", "kurtosis")
    )


@query
def sample_entropy(spark, sf_dir):
    stats = features.band_stats(fx.vectors(spark, sf_dir).select("window_id", "x"))
    clean = F.get(scrub(F.array("sample_entropy")), F.lit(0))
    return rounded(stats.select("window_id", clean.alias("entropy")))


@query
def permutation_entropy(spark, sf_dir):
    stats = features.band_stats(fx.vectors(spark, sf_dir).select("window_id", "x"))
    return rounded(stats.select("window_id", F.col("permutation_entropy").alias("entropy")))


@query
def shannon_entropy(spark, sf_dir):
    stats = features.band_stats(fx.vectors(spark, sf_dir).select("window_id", "x"))
    return rounded(stats.select("window_id", F.col("shannon_entropy").alias("entropy")))


@query
def dwt_filter(spark, sf_dir):
    rows = features.dwt_filter(fx.samples(spark, sf_dir))
    return rounded(rows.select("user_id", "i", "value"))


@query
def dwt_subbands(spark, sf_dir):
    """Every band of every window rebuilt to the window's length, band by band."""
    rows = features.dwt_subbands(fx.vectors(spark, sf_dir).select("window_id", "x"), 4)
    return rows.select("window_id", "band", *array_digest("x"))


@query
def dwt_subbands_sum(spark, sf_dir):
    """The rebuilt bands of a window add up to it."""
    rows = features.dwt_subbands(fx.vectors(spark, sf_dir).select("window_id", "x"), 4)
    points = rows.select("window_id", F.posexplode("x").alias("t", "v"))
    return rounded(points.groupBy("window_id", "t").agg(F.sum("v").alias("v")))


@query
def feature_vector(spark, sf_dir):
    """Four wavelet levels of four channels of 1024 samples: two hundred values per window."""
    rows = features.feature_vector(fx.long_vectors(spark, sf_dir), 4)
    rows = rows.withColumn("features", F.col("features").cast("array<double>"))
    return rows.select("window_id", "subject", "y", *array_digest("features"))


@query
def psd(spark, sf_dir):
    spectra = features.power_spectrum(fx.channel_vectors(spark, sf_dir, 1), nperseg=64)
    return rounded(features.class_spectrum(spectra), 9)


@query
def band_power(spark, sf_dir):
    spectra = features.power_spectrum(fx.channel_vectors(spark, sf_dir, 1), nperseg=64)
    return rounded(features.band_power(features.class_spectrum(spectra)), 9)


# --- augmentation ---------------------------------------------------------------------------


@query
def time_shift(spark, sf_dir):
    return augment.time_shift(fx.vectors(spark, sf_dir)).select("window_id", *array_digest("x"))


@query
def amplitude_scale(spark, sf_dir):
    return augment.amplitude_scale(fx.vectors(spark, sf_dir)).select("window_id", *array_digest("x"))


@query
def channel_dropout(spark, sf_dir):
    rows = augment.channel_dropout(fx.channel_vectors(spark, sf_dir), 4, p=0.5)
    return rows.select("window_id", "ch", *array_digest("x"))


@query
def gaussian_noise(spark, sf_dir):
    return augment.gaussian_noise(fx.vectors(spark, sf_dir)).select("window_id", *array_digest("x"))


@query
def augment_compose(spark, sf_dir):
    rows = augment.compose(fx.vectors(spark, sf_dir), [augment.time_shift, augment.amplitude_scale])
    return rows.select("window_id", *array_digest("x"))


# --- splits and sampling ---------------------------------------------------------------------


@query
def loso_folds(spark, sf_dir):
    return splits.trainable(splits.loso_folds(fx.vectors(spark, sf_dir)))


@query
def kfold(spark, sf_dir):
    return splits.stratified_kfold(fx.vectors(spark, sf_dir)).select("window_id", "y", "fold")


@query
def stratified_split(spark, sf_dir):
    return splits.stratified_split(fx.vectors(spark, sf_dir)).select("window_id", "y", "role")


@query
def subject_cap(spark, sf_dir):
    return splits.first_subjects(fx.vectors(spark, sf_dir), 2).select("window_id", "subject")


@query
def row_cap(spark, sf_dir):
    return splits.random_rows(fx.vectors(spark, sf_dir), 50).select("window_id", "subject")


@query
def undersample(spark, sf_dir):
    return splits.undersample(fx.vectors(spark, sf_dir), 3.0).select("window_id", "y")


@query
def per_class_pick(spark, sf_dir):
    return splits.per_class(fx.vectors(spark, sf_dir), 40).select("window_id", "y")


@query
def weighted_sample(spark, sf_dir):
    return splits.weighted_sample(fx.vectors(spark, sf_dir))


# --- neighbours ----------------------------------------------------------------------------------


@query
def knn(spark, sf_dir):
    """Vote of the three nearest windows of other subjects, for every window."""
    rows = fx.vectors(spark, sf_dir)
    return rounded(neighbours.knn_vote(rows, rows, k=3, apart="subject"))


# --- models --------------------------------------------------------------------------------------


def _feature_table(spark, sf_dir, level=4):
    """Stored wavelet features of all windows."""
    vectors = features.feature_vector(fx.channel_vectors(spark, sf_dir), level)
    return models.materialise(vectors, "features")


def _loso(spark, sf_dir, name, **overrides):
    scores = models.loso_scores(_feature_table(spark, sf_dir), [name], {name: overrides})
    return rounded(models.fold_metrics(models.materialise(scores, "scores")))


@query
def random_forest_loso(spark, sf_dir):
    return _loso(spark, sf_dir, "random_forest")


@query
def gbt_loso(spark, sf_dir):
    """Two hundred rounds of depth eight, all folds in the same jobs."""
    return _loso(spark, sf_dir, "xgboost")


@query
def leafwise_gbt_loso(spark, sf_dir):
    """Two hundred rounds of 63 leaves, the best leaf first."""
    return _loso(spark, sf_dir, "lightgbm")


@query
def gbt_first_tree(spark, sf_dir):
    """Splits of each fold's first tree over the raw samples, on equal class weights."""
    rows = models.materialise(fx.vectors(spark, sf_dir), "vectors")
    folds = [f["fold"] for f in splits.trainable(splits.loso_folds(rows)).orderBy("fold").collect()]
    params = boosting.Boosting(depth=3, bins=16)
    return rounded(boosting.first_splits(rows, folds, [(1.0, 1.0)] * len(folds), params, x="x"))


@query
def linear_svc_loso(spark, sf_dir):
    return _loso(spark, sf_dir, "svm_linear")


@query
def rbf_svc_loso(spark, sf_dir):
    return _loso(spark, sf_dir, "svm_rbf")


@query
def knn_loso(spark, sf_dir):
    """Fold metrics of the neighbour vote; folds come from excluding the own subject."""
    rows = fx.vectors(spark, sf_dir)
    votes = neighbours.knn_vote(rows, rows, keep=["subject", "y"], k=3, apart="subject")
    return rounded(models.fold_metrics(votes.withColumnRenamed("subject", "fold"), ["fold"]))


@query
def loso_leaderboard(spark, sf_dir):
    """A small grid of runs with an unknown model name among them."""
    results = experiment.run_experiment(
        {"embeddings": _feature_table(spark, sf_dir)},
        ["knn", "random_forest", "xgboost", "svm"],
    )
    return experiment.leaderboard(results)


@query
def param_search(spark, sf_dir):
    rows = splits.stratified_kfold(_feature_table(spark, sf_dir), 3)
    space = {
        "numTrees": {"type": "categorical", "choices": [50, 100]},
        "maxDepth": {"type": "int", "low": 5, "high": 10},
    }
    return rounded(models.search(rows, "random_forest", space, trials=10))


@query
def experiment_grid(spark, sf_dir):
    """Runs planned for each label variant, with its number of windows."""
    names = [f"y_sop{m}" for m in (5, 10, 15)]
    variants = audit.label_table(labelled(spark, sf_dir), names)
    table = variants.select(F.col("variant").alias("dataset"), "total", "preictal")
    return experiment.grid(table, models.model_names(), reps=2)


@query
def ablation_grid(spark, sf_dir):
    raw = F.create_map(*[F.lit(x) for p in fx.RAW_CHANNELS.items() for x in p])
    rows = fx.table(spark, sf_dir, "events").select(
        "user_id", channels.normal_name(raw[F.col("event_type")]).alias("channel")
    )
    recordings = rows.groupBy("user_id").agg(F.collect_set("channel").alias("channels"))
    grid = experiment.ablation_grid(
        recordings,
        {"two": ["T7", "T8"], "four": ["F7", "F8", "T7", "T8"], "six": list(channels.WEARABLE)},
        [2, 4, 8, 16],
        ["zscore+bandpass", "bandpass", "zscore"],
    )
    return grid.groupBy("channel_set", "window_sec", "preprocessing").agg(
        F.count(F.lit(1)).alias("recordings"), F.count_if("usable").alias("usable")
    )


@query
def knn_loso_summary(spark, sf_dir):
    """Mean and deviation over the folds of the neighbour vote."""
    rows = fx.vectors(spark, sf_dir)
    votes = neighbours.knn_vote(rows, rows, keep=["subject", "y"], k=3, apart="subject")
    folds = models.fold_metrics(votes.withColumnRenamed("subject", "fold"), ["fold"])
    return rounded(metrics.fold_summary(folds, (*metrics.METRICS, "auc_roc")))


# --- stored datasets --------------------------------------------------------------------------------


def _prepared(spark, sf_dir):
    """From samples and seizures to labelled windows: two samples a second averaged to one,
    a low-pass forward and backward, the two finest wavelet bands removed, z-scores."""
    rows = fx.samples(spark, sf_dir).withColumns(
        {
            "subject": (F.col("user_id") % 10).cast("string"),
            "recording": F.col("user_id").cast("string"),
            "channel": F.lit("EEG T3"),
        }
    )
    onsets = rows.where("event_type = 'purchase' and value > 150")
    seizures = onsets.select(
        "subject",
        "recording",
        (F.col("i") / 2).alias("onset_sec"),
        (F.col("i") / 2 + 2).alias("offset_sec"),
    )
    low = (0.2928932188134524, 0.5857864376269049, 0.2928932188134524)
    cfg = Preparation(
        channels=("T7",),
        source_rate=2,
        rate=1,
        window_sec=8.0,
        stride_sec=4.0,
        filters=((low, (1.0, 0.0, 0.1715728752538099)),),
        wavelet_filter=True,
        sop_sec={"y_near": 8.0, "y_far": 16.0},
        sph_sec=4.0,
        postictal_sec=8.0,
    )
    signal = rows.select("subject", "recording", "channel", "i", "value")
    return prepare(signal, seizures, cfg)


@query
def prepare_dataset(spark, sf_dir):
    """The prepared windows with their labels and a digest of their samples."""
    return _prepared(spark, sf_dir).select(
        "recording", "channel", "k", r6("start_sec").alias("start_sec"), "y_near", "y_far", *array_digest("x")
    )


@query
def dataset_roundtrip(spark, sf_dir):
    """Labelled windows written, read back under one label and counted per subject."""
    path = shared_folder(spark, "windows")
    rows = labelled(spark, sf_dir).withColumn("subject", F.col("user_id") % 10)
    datasets.write_windows(rows, path)
    stored = datasets.read_windows(spark, path, label="y_sop10")
    return stored.groupBy("subject").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("positives")
    )


@query
def dataset_validation(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("subject", F.col("user_id") % 10)
    names = ["y_sop5", "y_sop10", "y_sop15"]
    return rounded(datasets.validate(rows, names, ["subject", "x_dwt", *names], 2))


# --- streams ---------------------------------------------------------------------------------------------


def _event_stream(spark, sf_dir):
    schema = fx.table(spark, sf_dir, "events").schema
    return online.read_events(spark, sf_dir, "events.parquet", schema)


def _score_stream(spark, sf_dir):
    prob = F.col("value") / (F.col("value") + 50)
    return _event_stream(spark, sf_dir).select(
        "user_id", "ts", "event_id", prob.alias("prob"), (prob >= 0.5).cast("int").alias("pred")
    )


@query
def stream_windows(spark, sf_dir):
    closed = online.window_stats(_event_stream(spark, sf_dir))
    return rounded(online.run_available(closed, "stream-windows"))


#: Events of a user are hours apart, their files may be weeks late.
STREAM_ORDER = online.Ordering(late=60.0, slot=10 * 86_400.0, idle=30 * 86_400.0)
DAILY_ORDER = online.Ordering(late=60.0, slot=86_400.0, idle=30 * 86_400.0)
PATIENT_ORDER = online.Ordering(late=400 * 86_400.0, slot=10 * 86_400.0, idle=30 * 86_400.0)


def _ordered(rows, operator, purpose, order=STREAM_ORDER):
    """Results of an ordered operator over all that is there; late rows fail the query."""
    results, late = online.run_ordered(rows, lambda r: operator(r, order=order), purpose, order=order)
    lost = late.count()
    if lost:
        raise online.LateRows(f"{lost} rows came too late")
    return results


@query
def stream_ema(spark, sf_dir):
    return rounded(_ordered(_score_stream(spark, sf_dir), online.online_ema, "stream-ema"))


@query
def stream_vote(spark, sf_dir):
    return _ordered(_score_stream(spark, sf_dir), online.online_vote, "stream-vote")


@query
def stream_alarm(spark, sf_dir):
    return _ordered(_score_stream(spark, sf_dir), online.online_alarm, "stream-alarm")


def _reversed_files(spark, sf_dir, parts=3):
    """The events as files of following stretches of time, the newest written first."""
    path = shared_folder(spark, "reversed")
    events = fx.table(spark, sf_dir, "events")
    place = F.ntile(parts).over(W.orderBy("_day"))
    days = events.groupBy(F.to_date("ts").alias("_day")).agg(F.count("*").alias("_n")).withColumn("_part", place)
    dealt = models.materialise(
        events.withColumn("_day", F.to_date("ts")).join(F.broadcast(days.drop("_n")), "_day").drop("_day"), "dealt"
    )
    for part in range(parts, 0, -1):
        dealt.where(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return path, events.schema


@query
def stream_parity(spark, sf_dir):
    """The online average over three files in reverse order, one per micro-batch."""
    path, schema = _reversed_files(spark, sf_dir)
    stream = online.read_events(spark, path, "*.parquet", schema, 1)
    prob = F.col("value") / (F.col("value") + 50)
    scored = stream.select("user_id", "ts", "event_id", prob.alias("prob"))
    return rounded(_ordered(scored, online.online_ema, "stream-parity", PATIENT_ORDER))


@query
def stream_vote_reversed(spark, sf_dir):
    """The online vote over three files in reverse order."""
    path, schema = _reversed_files(spark, sf_dir)
    stream = online.read_events(spark, path, "*.parquet", schema, 1)
    pred = (F.col("value") / (F.col("value") + 50) >= 0.5).cast("int")
    scored = stream.select("user_id", "ts", "event_id", pred.alias("pred"))
    return _ordered(scored, online.online_vote, "vote-reversed", PATIENT_ORDER)


@query
def stream_late_rows(spark, sf_dir):
    """Windows over three files in reverse order without patience: rows windowed, rows late, rows in."""
    path, schema = _reversed_files(spark, sf_dir)
    stream = online.read_events(spark, path, "*.parquet", schema, 1).select("user_id", "ts", "event_id", "value")
    _, rows, late = online.run_windows(stream, "late-rows", order=DAILY_ORDER)
    kept = rows.select("user_id", "event_id", F.lit(False).alias("late"))
    return kept.unionByName(late.select("user_id", "event_id", F.lit(True).alias("late")))


# --- the same results across chunk borders ----------------------------------------------------------------


@query
def windows_small_chunks(spark, sf_dir):
    cut = windows.sliding_windows(fx.samples(spark, sf_dir), 16, 4, size=16)
    return windows.start_seconds(cut, 4, 256.0).select(
        "user_id", "k", "start", r6("start_sec").alias("start_sec"), *array_digest("x")
    )


@query
def iir_small_chunks(spark, sf_dir):
    low = (0.2928932188134524, 0.5857864376269049, 0.2928932188134524)
    rows = recursive.iir_filter(fx.samples(spark, sf_dir), low, (1.0, 0.0, 0.1715728752538099), size=16)
    return rounded(rows.select("user_id", "i", "value"))


@query
def dwt_filter_small_chunks(spark, sf_dir):
    rows = features.dwt_filter(fx.samples(spark, sf_dir), size=16)
    return rounded(rows.select("user_id", "i", "value"))


@query
def vote_small_chunks(spark, sf_dir):
    return alarms.majority_vote(fx.scored(spark, sf_dir), size=16).select("user_id", "k", "pred")


@query
def collar_small_chunks(spark, sf_dir):
    return alarms.collar_merge(fx.scored(spark, sf_dir), size=16).select("user_id", "k", "pred")


@query
def ema_small_chunks(spark, sf_dir):
    rows = alarms.ema_smooth(fx.scored(spark, sf_dir), 0.3, 0.5, size=16)
    return rounded(rows.select("user_id", "k", "ema", "ema_pred"))


@query
def runs_small_chunks(spark, sf_dir):
    return alarms.alarm_runs(fx.scored(spark, sf_dir), size=16)


@query
def knn_stored(spark, sf_dir):
    """The neighbour vote of a stored table with itself, over several blocks."""
    rows = models.materialise(fx.vectors(spark, sf_dir), "vectors")
    return rounded(neighbours.knn_vote(rows, rows, k=3, apart="subject", pivots=5, block_rows=40))


# --- files written and read back ------------------------------------------------------------------------------


@query
def discovered_records(spark, sf_dir):
    """Folders of a stored dataset that the listing finds, one per subject."""
    path = shared_folder(spark, "discovery")
    datasets.write_windows(fx.vectors(spark, sf_dir).select("subject", "window_id"), path)
    found = records.discover_records(spark, path, "*.parquet")
    subject = F.regexp_extract("path", "subject=([^/]*)/", 1).cast("bigint")
    return found.groupBy(subject.alias("subject")).agg((F.min("length") > 0).alias("found"))


@query
def stored_samples(spark, sf_dir):
    """Samples as files, read for two channels."""
    path = shared_folder(spark, "samples")
    named = channel_samples(spark, sf_dir)
    named.select(
        (F.col("user_id") % 10).cast("string").alias("subject"),
        F.col("user_id").cast("string").alias("recording"),
        "channel",
        "i",
        "value",
    ).write.parquet(path)
    rows = records.read_samples(spark, path, ["F7", "T7"])
    return rounded(rows.groupBy("subject", "channel").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@query
def stored_annotations(spark, sf_dir):
    """Seizure lists as text files with several blocks each, found by folder."""
    path = shared_folder(spark, "annotations")
    texts = fx.siena_texts(spark, sf_dir)
    # A file per subject: the files cost the time, not their few bytes, by which Spark would merge the tasks.
    tasks = 4 * spark.sparkContext.defaultParallelism
    texts.repartition(tasks, "subject").sortWithinPartitions("subject", "path").select(
        "subject", "txt"
    ).write.partitionBy("subject").text(path)
    found = records.read_texts(spark, path, "*.txt")
    named = found.withColumn("subject", F.replace("subject", F.lit("subject="), F.lit("")))
    return rounded(annotations.siena_intervals(named))


@query
def stored_features(spark, sf_dir):
    """Vectors taken from a stored feature table instead of being computed."""
    vectors = fx.channel_vectors(spark, sf_dir)
    rows = features.features_or_stored(vectors, _feature_table(spark, sf_dir, 1))
    rows = rows.withColumn("features", F.col("features").cast("array<double>"))
    return rows.select("window_id", "subject", "y", *array_digest("features"))


@query
def results_table(spark, sf_dir):
    """Two experiments appended to one results table, the second with one more column."""
    path = shared_folder(spark, "results")
    names = [f"y_sop{m}" for m in (5, 10, 15)]
    table = audit.label_table(labelled(spark, sf_dir), names)
    datasets.append_results(table.select("variant", "total"), path, "first")
    datasets.append_results(table.select("variant", "total", "preictal"), path, "second")
    return datasets.read_results(spark, path).select("experiment", "variant", "total", "preictal")


@query
def loso_json(spark, sf_dir):
    """Fold metrics nested in a JSON file beside their mean and deviation."""
    path = shared_folder(spark, "loso")
    folds = metrics.segment_metrics(fx.flat_scores(spark, sf_dir), ["fold"]).withColumn("model", F.lit("scores"))
    summary = metrics.fold_summary(folds, ["recall", "f1"], ["model"])
    datasets.write_loso(folds.select("model", "fold", "recall"), summary, path)
    back = spark.read.json(path)
    best = F.aggregate("folds", F.lit(0.0), lambda a, f: F.greatest(a, f["recall"]))
    return rounded(
        back.select("model", "n_folds", "mean.recall", F.col("std.f1").alias("f1_spread"), best.alias("best_recall"))
    )


@query
def metadata_json(spark, sf_dir):
    """A dataset's description written as JSON and read back."""
    path = shared_folder(spark, "metadata")
    names = {f"y_sop{m}": float(m) for m in (5, 10, 15)}
    rows = labelled(spark, sf_dir).withColumn("subject", F.col("user_id") % 10).withColumn("y", F.col("y_sop15"))
    raw = F.create_map(*[F.lit(x) for p in fx.RAW_CHANNELS.items() for x in p])
    named = fx.table(spark, sf_dir, "events").select("user_id", channels.normal_name(raw[F.col("event_type")]).alias("channel"))
    settings = {
        "dataset": "events", "sample_rate_hz": 256, "seq_len": 1024, "window_sec": 4.0, "stride_sec": 1.0,
        "channels": 4, "selected_channels": ["F7", "F8", "T7", "T8"], "normalization": "zscore",
        "labeling": {
            "mode": "prediction", "overlap_fraction": 0.2, "sop_minutes": fx.SOP_SEC[15] / 60,
            "sph_minutes": fx.SPH_SEC / 60, "postictal_gap_minutes": fx.POSTICTAL_SEC / 60,
        },
    }
    written = audit.metadata(
        rows, settings, channels.channel_coverage(named, ["F8", "P7"]), names, subject="subject", recording="user_id"
    )
    datasets.write_metadata(written, path)
    back = spark.read.json(path)
    return rounded(
        back.select(
            "dataset", "samples", "positive", "negative", "class_ratio", "num_subjects", "record_count", "sample_rate_hz",
            "seq_len", "window_sec", "stride_sec", "channels", "normalization", "skipped_no_channels",
            F.concat_ws(",", "selected_channels").alias("selected_channels"),
            F.to_json("subject_map").alias("subject_map"),
            "labeling.mode", "labeling.overlap_fraction", "labeling.sop_minutes", "labeling.sph_minutes",
            "labeling.postictal_gap_minutes",
            *[F.col(f"label_keys.{n}.positive").alias(f"positive_{n}") for n in names],
            *[F.col(f"label_keys.{n}.sop_minutes").alias(f"minutes_{n}") for n in names],
        )
    )


@query
def merged_dataset(spark, sf_dir):
    """Signals, two label variants and features of the same windows, met bucket by bucket."""
    keys = ["subject", "window_id"]
    rows = fx.vectors(spark, sf_dir)
    store = lambda df, name: datasets.write_bucketed(df, shared_folder(spark, name), keys, 8)
    third = (F.col("window_id") % 3 == 0).cast("int").alias("y")
    tables = {"y_first": store(rows.select(*keys, "y"), "first"), "y_third": store(rows.select(*keys, third), "third")}
    vectors = store(features.feature_vector(fx.channel_vectors(spark, sf_dir), 1).select(*keys, "features"), "vectors")
    merged = datasets.merge_dataset(spark, store(rows.select(*keys, "x"), "signals"), tables, keys, vectors)
    doubles = merged.withColumn("features", F.col("features").cast("array<double>"))
    digest = [c.alias(f"f_{name}") for c, name in zip(array_digest("features"), ("n", "total", "weighted"))]
    return doubles.select(*keys, "y_first", "y_third", *array_digest("x"), *digest)


@query
def inner_split(spark, sf_dir):
    """Training and validation windows inside every fold of a split by subject."""
    rows = fx.vectors(spark, sf_dir)
    parts = []
    for fold in splits.trainable(splits.loso_folds(rows)).orderBy("fold").collect():
        train, _ = splits.loso_split(rows, fold["fold"])
        for role, part in zip(("train", "val"), splits.inner_split(train, fold["n_train"], 0.1)):
            counts = part.groupBy("y").agg(F.count("*").alias("n"))
            parts.append(counts.withColumns({"role": F.lit(role), "fold": F.lit(fold["fold"])}))
    return reduce(DataFrame.unionByName, parts)