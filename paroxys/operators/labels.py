"""Seizure labels for windows.

A window is labelled by whether *some* seizure zone meets a pair of bounds. Zones of a
recording, ordered by start, need only the farthest end seen so far to answer that,
so windows and zones are merged into one ordered scan. Cost grows with their number,
not with the pairs of windows and seizures, and long recordings are cut by time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paroxys.operators.ordered import running, time_chunk

GROUP = ("user_id",)
DAY = 86_400.0

# Order of rows at equal time: zones a window may start with, the window, later zones.
_INCLUSIVE, _PROBE, _STRICT = 0, 1, 2


def _zones(
    seizures: DataFrame, group: Sequence[str], reaches: Sequence[str], zones: Sequence[tuple]
) -> DataFrame:
    """One row per seizure and zone: ``(name, from, reach, order at equal time)``."""
    cells = [
        F.struct(
            start.cast("double").alias("_t"),
            F.lit(rank).alias("_rank"),
            *[
                (end.cast("double") if reach == name else F.lit(None).cast("double")).alias(reach)
                for reach in reaches
            ],
        )
        for name, start, end, rank in zones
    ]
    return seizures.select(*group, F.explode(F.array(*cells)).alias("_z")).select(*group, "_z.*")


def _reach_at(
    windows: DataFrame,
    zones: DataFrame,
    group: Sequence[str],
    reaches: Sequence[str],
    start: str,
    chunk_sec: float,
) -> DataFrame:
    """Add to every window the farthest end per zone name among the zones before it."""
    probes = windows.withColumn("_t", F.col(start).cast("double")).withColumn(
        "_rank", F.lit(_PROBE)
    )
    merged = probes.unionByName(zones, allowMissingColumns=True)
    merged = merged.withColumn("_chunk", time_chunk("_t", chunk_sec))
    scanned = running(
        merged,
        group,
        "_chunk",
        ["_t", "_rank"],
        maxes={f"far_{reach}": F.col(reach) for reach in reaches},
    )
    return scanned.where(F.col("_rank") == _PROBE).drop("_t", "_rank", "_chunk", *reaches)


def label_detection(
    windows: DataFrame,
    seizures: DataFrame,
    win_sec: float,
    overlap_fraction: float = 0.2,
    group: Sequence[str] = GROUP,
    start: str = "start_sec",
    chunk_sec: float = DAY,
) -> DataFrame:
    """``y`` = 1 where one seizure covers at least the given fraction of the window.

    At fraction 0 any seizure of the recording makes all its windows 1.
    """
    if not 0 <= overlap_fraction <= 1:
        raise ValueError("overlap_fraction must lie in [0, 1]")
    if overlap_fraction == 0:
        known = F.col("onset_sec").isNotNull() & F.col("offset_sec").isNotNull()
        marked = seizures.where(known).select(*group).distinct().withColumn("_any", F.lit(1))
        return windows.join(marked, list(group), "left").withColumn(
            "y", F.coalesce("_any", F.lit(0))
        ).drop("_any")
    need = overlap_fraction * win_sec
    onset, offset = F.col("onset_sec"), F.col("offset_sec")
    zones = _zones(
        seizures.where((offset - onset) / win_sec >= overlap_fraction),
        group,
        ["ictal"],
        [("ictal", onset - (win_sec - need), offset, _INCLUSIVE)],
    )
    reached = _reach_at(windows, zones, group, ["ictal"], start, chunk_sec)
    hit = (F.col("far_ictal") - F.col(start)) / win_sec >= overlap_fraction
    return reached.withColumn("y", F.coalesce(hit, F.lit(False)).cast("int")).drop("far_ictal")


def label_prediction(
    windows: DataFrame,
    seizures: DataFrame,
    win_sec: float,
    sop_sec: float | Mapping[str, float],
    sph_sec: float,
    postictal_sec: float,
    group: Sequence[str] = GROUP,
    start: str = "start_sec",
    chunk_sec: float = DAY,
) -> DataFrame:
    """-1 in excluded windows, 1 in preictal ones, else 0.

    Excluded: the window overlaps a seizure, the horizon before it or the gap after
    it. Preictal: it lies inside the occurrence period that ends a horizon before an
    onset. Exclusion wins whatever the order of seizures. Several occurrence periods,
    given as ``{column: seconds}``, are labelled in the same scan.
    """
    periods = {"y": sop_sec} if not isinstance(sop_sec, Mapping) else dict(sop_sec)
    onset, offset = F.col("onset_sec"), F.col("offset_sec")
    alarm_end = onset - sph_sec
    zones = [
        ("excluded", onset - win_sec, offset, _STRICT),
        ("excluded", onset - sph_sec - win_sec, onset, _STRICT),
        ("excluded", offset - win_sec, offset + postictal_sec, _STRICT),
    ]
    zones += [(name, alarm_end - sop, alarm_end, _INCLUSIVE) for name, sop in periods.items()]
    reaches = ["excluded", *periods]
    reached = _reach_at(
        windows, _zones(seizures, group, reaches, zones), group, reaches, start, chunk_sec
    )
    begin = F.col(start)
    excluded = F.coalesce(begin < F.col("far_excluded"), F.lit(False))

    def label(name: str) -> Column:
        preictal = F.coalesce(begin + win_sec <= F.col(f"far_{name}"), F.lit(False))
        return F.when(excluded, -1).when(preictal, 1).otherwise(0)

    return reached.withColumns({name: label(name) for name in periods}).drop(
        *[f"far_{reach}" for reach in reaches]
    )


def drop_excluded(labelled: DataFrame, label: str = "y") -> DataFrame:
    """Windows that take part in training and evaluation."""
    return labelled.where(F.col(label) >= 0)


def label_windows(
    windows: DataFrame, seizures: DataFrame, mode: str, win_sec: float, **options
) -> DataFrame:
    """Labels by mode: every window for detection, kept windows for prediction."""
    if mode == "detection":
        return label_detection(windows, seizures, win_sec, **options)
    if mode == "prediction":
        return drop_excluded(label_prediction(windows, seizures, win_sec, **options))
    raise ValueError(f"unknown labeling mode {mode!r}")


def merge_labels(
    variants: Mapping[str, DataFrame], keys: Sequence[str], label: str = "y"
) -> DataFrame:
    """One row per window with a label column per variant.

    Every variant must label the same windows once; a window missing from one, or listed
    twice in one, makes the job fail. Windows meet by key, with one shuffle for all variants.
    """
    tagged = None
    for name, df in variants.items():
        part = df.select(*keys, F.lit(name).alias("_variant"), F.col(label).alias("_label"))
        tagged = part if tagged is None else tagged.unionByName(part)
    merged = tagged.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_variant") == name, F.col("_label"))).alias(name) for name in variants],
        *[F.count_if(F.col("_variant") == name).alias(f"_times_{name}") for name in variants],
    )
    complete = F.lit(True)
    for name in variants:
        complete = complete & (F.col(f"_times_{name}") == 1)
    first = next(iter(variants))
    checked = F.when(complete, F.col(first)).otherwise(
        F.raise_error(F.lit("label variants cover different windows or list one twice")).cast("int")
    )
    return merged.withColumn(first, checked).drop(*[f"_times_{name}" for name in variants])


def lookup_subjects(df: DataFrame, subjects: DataFrame, key: str = "subject") -> DataFrame:
    """Attach the subject's dense id; subjects unknown to the table keep a null id."""
    return df.join(subjects, key, "left")
