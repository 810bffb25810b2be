"""From samples and annotations to a stored, labelled window dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paroxys.functions.channels import channel_coverage, configured_channels, normal_name
from paroxys.operators import features, labels, recursive, windows
from paroxys.operators.matching import seizures_of_recordings

KEYS = ["subject", "recording"]


@dataclass(frozen=True)
class Preparation:
    """Settings of one dataset; lengths in seconds, rates in Hz."""

    channels: Sequence[str] = ("F7", "F8", "T7", "T8")
    source_rate: int = 512
    rate: int = 256
    window_sec: float = 4.0
    stride_sec: float = 1.0
    filters: Sequence[tuple[Sequence[float], Sequence[float]]] = ()
    wavelet_filter: bool = False
    normalise: str | None = "zscore"
    mode: str = "prediction"
    overlap_fraction: float = 0.2
    sop_sec: Mapping[str, float] = field(
        default_factory=lambda: {"y_sop5": 300.0, "y_sop10": 600.0, "y_sop15": 900.0}
    )
    sph_sec: float = 300.0
    postictal_sec: float = 900.0
    # "exact" names, or "fuzzy" ones: part of each other, as loosely kept lists need.
    match: str = "exact"


def clean_signal(samples: DataFrame, cfg: Preparation) -> DataFrame:
    """Configured channels, resampled and filtered.

    Recordings without any configured channel drop out here; ``skipped`` counts them.
    """
    named = samples.withColumn("channel", normal_name("channel"))
    kept = configured_channels(named, cfg.channels)
    group = [*KEYS, "channel"]
    if cfg.rate != cfg.source_rate:
        kept = windows.downsample(kept, cfg.source_rate, cfg.rate, group)
    for b, a in cfg.filters:
        kept = recursive.iir_filter(kept, b, a, group)
    if cfg.wavelet_filter:
        kept = features.dwt_filter(kept, group=group)
    return kept


def skipped(samples: DataFrame, cfg: Preparation) -> DataFrame:
    """Recordings with none of the configured channels."""
    named = samples.withColumn("channel", normal_name("channel"))
    return channel_coverage(named, cfg.channels, KEYS).where("skipped")


def positions(samples: DataFrame, cfg: Preparation) -> DataFrame:
    """Start of every window, from the length of the raw recordings alone."""
    named = samples.withColumn("channel", normal_name("channel"))
    last = F.max("i")
    if cfg.rate != cfg.source_rate:
        last = F.floor(last * cfg.rate / F.lit(cfg.source_rate))
    lengths = (
        configured_channels(named, cfg.channels)
        .groupBy(*KEYS)
        .agg((last + 1).cast("bigint").alias("n_samples"))
    )
    stride = int(cfg.stride_sec * cfg.rate)
    spots = windows.window_positions(lengths, int(cfg.window_sec * cfg.rate), stride)
    return windows.start_seconds(spots, stride, cfg.rate).drop("n_samples")


def label(spots: DataFrame, seizures: DataFrame, cfg: Preparation) -> DataFrame:
    """Labels of the kept windows, once per window and not per channel."""
    stems = spots.select("subject", F.col("recording").alias("stem"))
    matched = seizures_of_recordings(stems, seizures, cfg.match)
    matched = matched.select(
        "subject", F.col("stem").alias("recording"), "onset_sec", "offset_sec"
    )
    if cfg.mode == "detection":
        return labels.label_detection(
            spots, matched, cfg.window_sec, cfg.overlap_fraction, group=KEYS
        )
    if cfg.mode == "prediction":
        rows = labels.label_prediction(
            spots, matched, cfg.window_sec, cfg.sop_sec, cfg.sph_sec, cfg.postictal_sec, group=KEYS
        )
        # Exclusion does not depend on the occurrence period, so any label column tells.
        return labels.drop_excluded(rows, next(iter(cfg.sop_sec)))
    raise ValueError(f"unknown labeling mode {cfg.mode!r}")


def prepare(samples: DataFrame, seizures: DataFrame, cfg: Preparation) -> DataFrame:
    """Labelled windows, one row per window and channel.

    Windows are labelled before they are cut, so excluded ones are never built. Signals
    are normalised by their whole recording while they are cut.
    """
    signal = clean_signal(samples, cfg)
    norms = None
    if cfg.normalise in ("zscore", "minmax"):
        norms = windows.channel_scaling(signal, cfg.normalise, KEYS)
    return windows.cut_chosen(
        signal,
        label(positions(samples, cfg), seizures, cfg),
        int(cfg.window_sec * cfg.rate),
        int(cfg.stride_sec * cfg.rate),
        KEYS,
        norms=norms,
    )
