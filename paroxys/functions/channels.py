"""Electrode names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Signal-type prefixes, renamed electrodes, and wearable placements by
# priority.
PREFIXES = ("EEG", "EOG", "EMG", "ECG", "EKG")
RENAMED = {"T3": "T7", "T4": "T8", "T5": "P7", "T6": "P8"}
WEARABLE = ("T7", "T8", "F7", "F8", "P7", "P8")


def normal_name(raw: str | Column) -> Column:
    """Trimmed upper-case electrode name without signal prefix, in current naming."""
    col = F.col(raw) if isinstance(raw, str) else raw
    tidy = F.upper(F.trim(col))
    typed = F.substring(tidy, 1, 4).isin(*[f"{p} " for p in PREFIXES])
    name = F.when(typed, F.trim(F.substr(tidy, F.lit(5)))).otherwise(tidy)
    renamed = name
    for old, new in RENAMED.items():
        renamed = F.when(name == old, F.lit(new)).otherwise(renamed)
    return renamed


def wearable_channels(
    df: DataFrame,
    max_channels: int = 6,
    recording: Sequence[str] = ("user_id",),
    channel: str = "channel",
    priority: Sequence[str] = WEARABLE,
) -> DataFrame:
    """Each recording's best available placements with their ``priority`` (from 0).

    Channels collapse to the distinct placements of a recording first, at most one row
    per entry of the priority list.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in priority]), F.col(channel)) - 1
    present = df.where(F.col(channel).isin(*priority)).select(*recording, channel).distinct()
    best = W.partitionBy(*recording).orderBy("priority")
    return (
        present.withColumn("priority", rank.cast("int"))
        .withColumn("_rn", F.row_number().over(best))
        .where(F.col("_rn") <= max_channels)
        .drop("_rn")
    )


def configured_channels(
    df: DataFrame, channels: Sequence[str], channel: str = "channel"
) -> DataFrame:
    return df.where(F.col(channel).isin(*channels))


def channel_coverage(
    df: DataFrame,
    channels: Sequence[str],
    recording: Sequence[str] = ("user_id",),
    channel: str = "channel",
) -> DataFrame:
    """Configured channels present per recording; ``skipped`` where there is none."""
    found = F.when(F.col(channel).isin(*channels), F.col(channel))
    return (
        df.groupBy(*recording)
        .agg(F.array_sort(F.collect_set(found)).alias("_found"))
        .select(
            *recording,
            F.size("_found").alias("n_channels"),
            (F.size("_found") == 0).alias("skipped"),
            (F.size("_found") == len(set(channels))).alias("complete"),
        )
    )
