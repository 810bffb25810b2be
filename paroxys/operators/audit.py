"""Dataset summaries, class balance and signal quality audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paroxys.functions import arrays
from paroxys.functions.arrays import let
from paroxys.operators.metrics import ratio
from paroxys.operators.ordered import dense_index, ordered_bucket


def dataset_summary(
    windows: DataFrame, subject: str = "subject", recording: str = "recording", label: str = "y"
) -> DataFrame:
    """One row: window counts, class ratio, subjects and recordings."""
    y = F.col(label)
    return windows.agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum(y).cast("bigint").alias("positive"),
        F.sum(1 - y).cast("bigint").alias("negative"),
        F.avg(y).alias("class_ratio"),
        F.count_distinct(subject).alias("num_subjects"),
        F.count_distinct(recording).alias("record_count"),
    )


def subject_map(windows: DataFrame, subject: str = "subject") -> DataFrame:
    """Dense subject ids in name order, as rows ``(subject_id, subject)``."""
    names = windows.select(subject).distinct()
    return dense_index(
        ordered_bucket(names, subject, "chunk", 64), [], "chunk", [subject], "subject_id"
    ).select("subject_id", subject)


def metadata(
    windows: DataFrame,
    settings: dict[str, object],
    skipped: DataFrame | None = None,
    label_keys: Mapping[str, float] | None = None,
    **columns: str,
) -> DataFrame:
    """The dataset summary with its settings, as one JSON-ready row.

    ``settings`` are written as they are, mappings as nested documents; lists name, say,
    the selected channels. ``skipped`` counts recordings without any configured channel
    (``channels.channel_coverage``). ``subject_map`` lists the subjects by their dense id.
    ``label_keys`` names the label columns of a merged dataset with their occurrence
    periods in minutes; each is written with its number of positives.
    """
    subjects = subject_map(windows, columns.get("subject", "subject"))
    names = subjects.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("subject_id").cast("string"), F.col(subjects.columns[1]).cast("string")))))
    ).scalar()
    summary = dataset_summary(windows, **columns)
    fixed = {
        name: F.array(*[F.lit(v) for v in value]) if isinstance(value, (list, tuple)) else F.lit(value)
        for name, value in settings.items()
        if not isinstance(value, dict)
    }
    fixed["subject_map"] = names
    if label_keys:
        totals = windows.agg(*[F.sum(name).cast("bigint").alias(name) for name in label_keys])
        fixed["label_keys"] = F.struct(
            *[
                F.struct(F.lit(float(minutes)).alias("sop_minutes"), totals.select(name).scalar().alias("positive")).alias(name)
                for name, minutes in label_keys.items()
            ]
        )
    nested = {
        name: F.struct(*[F.lit(v).alias(k) for k, v in value.items()])
        for name, value in settings.items()
        if isinstance(value, dict)
    }
    if skipped is not None:
        count = skipped.agg(F.count(F.when(F.col("skipped"), 1))).scalar()
        fixed["skipped_no_channels"] = count
    return summary.withColumns({**fixed, **nested})


def class_balance(windows: DataFrame, subject: str = "subject", label: str = "y") -> DataFrame:
    """Counts per subject and, with a null subject, in total."""
    y = F.col(label)
    counted = windows.rollup(subject).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(y == 1, 1)).alias("preictal"),
        F.count(F.when(y == 0, 1)).alias("interictal"),
        F.grouping(subject).cast("int").alias("is_total"),
    )
    return counted.withColumns(
        {
            "preictal_pct": 100 * ratio(F.col("preictal"), F.col("total")),
            "loso_eligible": (F.col("preictal") > 0),
        }
    )


def label_table(
    windows: DataFrame, labels: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Counts per label column, from one pass over the windows."""
    wide = windows.groupBy(*by).agg(
        *[F.count(F.when(F.col(c) >= 0, 1)).alias(f"{c}_total") for c in labels],
        *[F.count(F.when(F.col(c) == 1, 1)).alias(f"{c}_pre") for c in labels],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("variant"),
                    F.col(f"{c}_total").alias("total"),
                    F.col(f"{c}_pre").alias("preictal"),
                )
                for c in labels
            ]
        )
    )
    return wide.select(*by, rows.alias("r")).select(
        *by,
        "r.*",
        (F.col("r.total") - F.col("r.preictal")).alias("interictal"),
        (100 * ratio(F.col("r.preictal"), F.col("r.total"))).alias("preictal_pct"),
    )


def channel_correlation(
    windows: DataFrame,
    keys: Sequence[str] = ("window_id", "y"),
    channel: str = "ch",
    x: str = "x",
    label: str = "y",
) -> DataFrame:
    """Mean Pearson correlation per channel pair and class, and the class difference.

    A window's channels are gathered into one row (a montage is small), standardised,
    and multiplied pairwise there; pairs of samples never become rows.
    """
    gathered = windows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(channel).alias("ch"), F.col(x).alias("x")))).alias("c")
    )

    def standardise(values: Column) -> Column:
        return let(
            arrays.mean(values),
            lambda m: let(
                arrays.std(values, m),
                lambda s: F.transform(values, lambda v: F.try_divide(v - m, s)),
            ),
        )

    standard = F.transform(
        "c", lambda c: F.struct(c["ch"].alias("ch"), let(c["x"], standardise).alias("z"))
    )

    def correlate(a: Column, b: Column) -> Column:
        return arrays.mean(F.zip_with(a["z"], b["z"], lambda u, v: u * v))

    def all_pairs(channels: Column) -> Column:
        return F.flatten(
            F.transform(
                channels,
                lambda a: F.transform(
                    F.filter(channels, lambda b: b["ch"] > a["ch"]),
                    lambda b: F.struct(
                        a["ch"].alias("ch_a"), b["ch"].alias("ch_b"), correlate(a, b).alias("r")
                    ),
                ),
            )
        )

    rows = gathered.select(label, F.explode(let(standard, all_pairs)).alias("p"))
    return (
        rows.groupBy(F.col("p.ch_a").alias("ch_a"), F.col("p.ch_b").alias("ch_b"))
        .agg(
            F.avg(F.when(F.col(label) == 0, F.col("p.r"))).alias("interictal"),
            F.avg(F.when(F.col(label) == 1, F.col("p.r"))).alias("preictal"),
        )
        .withColumn("delta", F.col("preictal") - F.col("interictal"))
    )


def norm_audit(windows: DataFrame, by: Sequence[str] = (), x: str = "x") -> DataFrame:
    """Mean of the window means and deviations."""
    def moments(values: Column) -> Column:
        return let(
            arrays.mean(values),
            lambda m: F.struct(m.alias("m"), arrays.std(values, m).alias("s")),
        )

    rows = windows.select(*by, let(F.col(x), moments).alias("_w")).select(
        *by, F.col("_w.m").alias("_m"), F.col("_w.s").alias("_s")
    )
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_m").alias("mean_of_means"),
        F.avg("_s").alias("mean_of_stds"),
        F.max(F.abs("_m")).alias("max_abs_mean"),
    )


def checklist(summary: DataFrame, checks: dict[str, tuple[Column, Column, bool]]) -> DataFrame:
    """Rows ``(check, status, value)``: PASS, else WARN if tolerable, else FAIL.

    Each check is ``(condition, shown value, is a warning only)`` over a one-row summary.
    """
    cells = [
        F.struct(
            F.lit(name).alias("check"),
            F.when(F.coalesce(condition, F.lit(False)), "PASS")
            .otherwise("WARN" if soft else "FAIL")
            .alias("status"),
            value.cast("double").alias("value"),
        )
        for name, (condition, value, soft) in checks.items()
    ]
    return summary.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def window_figures(
    windows: DataFrame, x: str = "x", label: str = "y", keys: Sequence[str] = ("subject", "recording", "k")
) -> DataFrame:
    """One row about a window table with a row per window and channel.

    Arrays shrink to their length, mean and deviation where they are; windows, then
    subjects, are counted from those.
    """
    subject, recording, _ = keys
    moments = let(
        F.col(x).cast("array<double>"),
        lambda v: let(arrays.mean(v), lambda m: F.struct(m.alias("m"), arrays.std(v, m).alias("s"), F.size(v).alias("n"))),
    )
    rows = windows.select(*keys, "channel", F.col(label).alias("y"), moments.alias("w"))
    each = rows.groupBy(*keys).agg(
        F.max("y").alias("y"),
        F.count_distinct("channel").alias("channels"),
        F.collect_set("channel").alias("names"),
        F.min("w.n").alias("shortest"),
        F.max("w.n").alias("longest"),
        F.sum("w.m").alias("m"),
        F.sum("w.s").alias("s"),
    )
    people = each.groupBy(subject).agg(
        F.count("*").alias("samples"),
        F.sum("y").alias("positive"),
        F.count_distinct(recording).alias("recordings"),
        F.min("channels").alias("fewest"),
        F.max("channels").alias("most"),
        F.array_distinct(F.flatten(F.collect_set("names"))).alias("names"),
        F.min("shortest").alias("shortest"),
        F.max("longest").alias("longest"),
        F.sum("m").alias("m"),
        F.sum("s").alias("s"),
        F.sum("channels").alias("rows"),
    )
    return people.agg(
        F.coalesce(F.sum("samples"), F.lit(0)).alias("samples"),
        F.sum("positive").alias("positive"),
        (F.sum("positive") / F.sum("samples")).alias("positive_share"),
        F.count("*").alias("subjects"),
        F.count_if(F.col("positive") > 0).alias("eligible"),
        F.sum("recordings").alias("recordings"),
        F.min("fewest").alias("fewest"),
        F.max("most").alias("most"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names"),
        F.min("shortest").alias("shortest"),
        F.max("longest").alias("longest"),
        (F.sum("m") / F.sum("rows")).alias("mean_of_means"),
        (F.sum("s") / F.sum("rows")).alias("mean_of_stds"),
    ).withColumn("single_precision", F.lit(dict(windows.dtypes)[x] == "array<float>"))


# What a dataset of the full corpus looks like.
EXPECTED = {
    "rate": 256, "window_sec": 4.0, "stride_sec": 1.0, "channels": ("F7", "F8", "T7", "T8"), "length": 1024,
    "windows": 100_000, "subjects": 14, "eligible": 10, "recordings": 41, "sph_minutes": 5.0,
    "normalisation": "zscore", "mode": "prediction",
}


def conformance(figures: DataFrame, settings: Mapping, expected: Mapping = EXPECTED) -> DataFrame:
    """All checks of a prepared dataset: is it ready to train on, does it follow the design?

    ``figures`` comes from ``window_figures``; ``settings`` has ``rate``, ``window_sec``,
    ``stride_sec``, ``normalisation``, ``mode``, ``sop_minutes`` and ``sph_minutes``. An
    occurrence period that fits is a warning: its choice is open to debate.
    """
    c, e = F.col, {**EXPECTED, **expected}
    fixed = lambda ok: (F.lit(bool(ok)), F.lit(float(bool(ok))))
    shape = (c("fewest") == len(e["channels"])) & (c("most") == len(e["channels"]))
    length = (c("shortest") == e["length"]) & (c("longest") == e["length"])
    names = c("names") == F.array_sort(F.array(*[F.lit(n) for n in e["channels"]]))
    single = c("single_precision")
    sop_fits = 5 <= settings["sop_minutes"] <= 20
    checks = {
        # Ready for training.
        "ready_windows": (c("samples") > e["windows"], c("samples")),
        "ready_channels": (shape, c("most")),
        "ready_length": (length, c("longest")),
        "ready_rate": (F.lit(settings["rate"] == e["rate"]), F.lit(settings["rate"])),
        "ready_precision": (single, single),
        "ready_subjects": (c("subjects") == e["subjects"], c("subjects")),
        "ready_eligible": (c("eligible") >= e["eligible"], c("eligible")),
        "ready_share": (c("positive_share").between(0.001, 0.05), c("positive_share")),
        "ready_mode": fixed(settings["mode"] == e["mode"]),
        "ready_mean": (F.abs("mean_of_means") < 0.1, c("mean_of_means")),
        "ready_std": (c("mean_of_stds") > 0, c("mean_of_stds")),
        # The design.
        "rate": (F.lit(settings["rate"] == e["rate"]), F.lit(settings["rate"])),
        "shape": (shape & length, c("longest")),
        "window": (F.lit(abs(settings["window_sec"] - e["window_sec"]) < 0.01), F.lit(settings["window_sec"])),
        "stride": (F.lit(abs(settings["stride_sec"] - e["stride_sec"]) < 0.01), F.lit(settings["stride_sec"])),
        "channels": (names, F.size("names")),
        "normalisation": fixed(settings["normalisation"] == e["normalisation"]),
        "window_mean": (F.abs("mean_of_means") < 0.01, c("mean_of_means")),
        "window_std": ((c("mean_of_stds") > 0.4) & (c("mean_of_stds") < 1.1), c("mean_of_stds")),
        "sop": (F.lit(sop_fits), F.lit(settings["sop_minutes"])),
        "sph": (F.lit(settings["sph_minutes"] == e["sph_minutes"]), F.lit(settings["sph_minutes"])),
        "mode": fixed(settings["mode"] == e["mode"]),
        "subjects": (c("subjects") == e["subjects"], c("subjects")),
        "recordings": (c("recordings") == e["recordings"], c("recordings")),
        "all_eligible": (c("eligible") == c("subjects"), c("eligible")),
        "share": (c("positive_share").between(0.03, 0.2), c("positive_share")),
        "precision": (single, single),
    }
    rows = checklist(figures, {name: (ok, value, False) for name, (ok, value) in checks.items()})
    warned = (F.col("check") == "sop") & (F.col("status") == "PASS")
    return rows.withColumn("status", F.when(warned, "WARN").otherwise(F.col("status")))


def structure_checks(summary: DataFrame) -> DataFrame:
    """Structural checks of a prepared dataset, from ``dataset_summary``."""
    col = F.col
    return checklist(
        summary,
        {
            "has_windows": (col("samples") > 0, col("samples"), False),
            "has_positives": (col("positive") > 0, col("positive"), False),
            "counts_add_up": (
                col("positive") + col("negative") == col("samples"),
                col("positive") + col("negative"),
                False,
            ),
            "several_subjects": (col("num_subjects") >= 2, col("num_subjects"), False),
            "positive_share": (
                col("class_ratio").between(0.005, 0.2),
                col("class_ratio"),
                True,
            ),
        },
    )


def status_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
