"""Wavelet, entropy and spectral features of windows.

Windows are ``(keys…, x)`` rows, one per channel, with a bounded array ``x``. Kernels
run on Arrow batches inside ``mapInArrow``: no shuffle, and rows of equal length are
computed together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paroxys.functions import bandstats, wavelet
from paroxys.functions.scores import scrub
from paroxys.operators.ordered import CHUNK_ROWS, map_halo_chunks, with_halo

BATCH_CELLS = 1 << 18


def _rows_of_equal_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and stacked values of the rows of each length, in bounded blocks."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        step = max(1, BATCH_CELLS // max(int(length) * 64, 1))
        for at in range(0, len(rows), step):
            block = rows[at : at + step]
            yield block, flat[starts[block][:, None] + np.arange(length)[None, :]]


def _column(parts: list[np.ndarray]) -> pa.Array:
    """One value, or one array, per row of blocks that were computed together."""
    if not all(isinstance(p, np.ndarray) for p in parts):
        # Arrays of unequal lengths within a row.
        return pa.array([cell for part in parts for cell in part])
    if parts[0].ndim == 1:
        return pa.array(np.concatenate(parts))
    sizes = np.concatenate([np.full(len(p), p.shape[1]) for p in parts])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    inner = _column([p.reshape(-1, *p.shape[2:]) for p in parts])
    return pa.ListArray.from_arrays(pa.array(offsets), inner)


def map_windows(
    df: DataFrame,
    kernel: Callable[[np.ndarray], list[np.ndarray]],
    out: str,
    outputs: str,
    x: str = "x",
) -> DataFrame:
    """Apply ``kernel`` to every window; it returns one array per output column.

    ``out`` names the columns comma-separated, ``outputs`` their types. A two-dimensional
    result becomes an array per row.
    """
    names, types = out.split(","), outputs.split(",")
    keep = [f for f in df.schema.fields if f.name not in names]
    added = ", ".join(f"{n} {t}" for n, t in zip(names, types))
    schema = StructType(keep + StructType.fromDDL(added).fields)
    kept = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            places: list[np.ndarray] = []
            parts: list[list] = [[] for _ in names]
            for rows, values in _rows_of_equal_length(batch.column(x)):
                places.append(rows)
                for column, result in zip(parts, kernel(values)):
                    column.append(result)
            order = pa.array(np.argsort(np.concatenate(places)))
            columns = [batch.column(n) for n in kept] + [_column(p).take(order) for p in parts]
            yield pa.RecordBatch.from_arrays(columns, names=kept + names)

    return df.mapInArrow(run, schema)


def dwt_level(df: DataFrame, x: str = "x") -> DataFrame:
    """One analysis step as array expressions: columns ``approx`` and ``detail``."""
    source = F.col(x)
    return df.withColumns(
        {
            "approx": wavelet.analyse_expr(source, wavelet.DB4_LOW),
            "detail": wavelet.analyse_expr(source, wavelet.DB4_HIGH),
        }
    )


def dwt_bands(df: DataFrame, level: int = 4, x: str = "x") -> DataFrame:
    """One row per window and band of coefficients; band 0 is the approximation."""

    def kernel(values: np.ndarray) -> list[np.ndarray]:
        bands = wavelet.decompose(values, level)
        return [[[b[r] for b in bands] for r in range(len(values))]]

    wide = map_windows(df, kernel, "_bands", "array<array<double>>", x)
    others = [c for c in df.columns if c != x]
    return wide.select(*others, F.posexplode("_bands").alias("band", x))


def dwt_subbands(df: DataFrame, level: int = 4, x: str = "x") -> DataFrame:
    """One row per window and band, rebuilt to the window's length; bands sum to it."""

    def kernel(values: np.ndarray) -> list[np.ndarray]:
        bands = [wavelet.keep_bands(values, level, frozenset([b])) for b in range(level + 1)]
        return [[[b[r] for b in bands] for r in range(len(values))]]

    wide = map_windows(df, kernel, "_bands", "array<array<double>>", x)
    others = [c for c in df.columns if c != x]
    return wide.select(*others, F.posexplode("_bands").alias("band", x))


def dwt_filter_windows(
    df: DataFrame,
    level: int = 5,
    keep_levels: Sequence[int] = (3, 4, 5),
    approx: bool = True,
    x: str = "x",
) -> DataFrame:
    """Band-pass of single windows by rebuilding from the kept bands."""
    kept = _kept(level, keep_levels, approx)
    return map_windows(
        df, lambda v: [wavelet.keep_bands(v, level, kept)], x, "array<double>", x
    ).select(*df.columns)


def _kept(level: int, keep_levels: Sequence[int], approx: bool) -> frozenset[int]:
    details = {level + 1 - d for d in keep_levels if 1 <= d <= level}
    return frozenset(details | ({0} if approx else set()))


def dwt_filter(
    df: DataFrame,
    level: int = 5,
    keep_levels: Sequence[int] = (3, 4, 5),
    approx: bool = True,
    group: Sequence[str] = ("user_id",),
    index: str = "i",
    value: str = "value",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Band-pass of whole recordings by rebuilding from the kept bands.

    The transform repeats with period ``2**level``, so a chunk that starts on that grid
    and carries as many neighbouring samples as the filters reach gives the values of
    the unbroken recording.
    """
    kept = _kept(level, keep_levels, approx)
    halo = wavelet.halo_for(level)
    step = 2**level
    size = -(-max(size, halo) // step) * step

    def rebuild(values: np.ndarray) -> np.ndarray:
        return wavelet.keep_bands(values[None, :], level, kept)[0]

    rows = with_halo(df, index, halo, halo, size)
    return map_halo_chunks(rows, group, index, value, rebuild, value).select(*df.columns)


def band_stats(df: DataFrame, x: str = "x", entropy_points: int | None = None) -> DataFrame:
    """The ten statistics as columns; see ``bandstats.band_stats`` for ``entropy_points``."""

    def kernel(values: np.ndarray) -> list[np.ndarray]:
        return list(bandstats.band_stats(values, entropy_points).T)

    types = ",".join(["double"] * len(bandstats.STATS))
    return map_windows(df, kernel, ",".join(bandstats.STATS), types, x).drop(x)


def channel_features(
    df: DataFrame, level: int = 4, x: str = "x", entropy_points: int | None = None
) -> DataFrame:
    """``features``: ten statistics for every band of one channel, approximation first."""

    def kernel(values: np.ndarray) -> list[np.ndarray]:
        parts = [bandstats.band_stats(b, entropy_points) for b in wavelet.decompose(values, level)]
        return [np.concatenate(parts, axis=1).astype(np.float32)]

    made = map_windows(df, kernel, "features", "array<float>", x).drop(x)
    cleaned = scrub(F.col("features").cast("array<double>")).cast("array<float>")
    return made.withColumn("features", cleaned)


def feature_vector(
    df: DataFrame,
    level: int = 4,
    keys: Sequence[str] = ("window_id", "subject", "y"),
    channel: str = "ch",
    x: str = "x",
    entropy_points: int | None = None,
) -> DataFrame:
    """One vector per window: channel, then band, then statistic.

    Only the short per-channel vectors are shuffled, not the signals.
    """
    per_channel = channel_features(df.select(*keys, channel, x), level, x, entropy_points)
    return per_channel.groupBy(*keys).agg(
        F.flatten(
            F.transform(
                F.sort_array(F.collect_list(F.struct(channel, "features"))), lambda c: c["features"]
            )
        ).alias("features")
    )


def features_or_stored(windows: DataFrame, stored: DataFrame | None, key: str = "window_id", **options) -> DataFrame:
    """Stored vectors where a feature table exists, computed ones otherwise."""
    if stored is None:
        return feature_vector(windows, **options)
    return windows.drop("x", options.get("channel", "ch")).distinct().join(stored.select(key, "features"), key)


def power_spectrum(df: DataFrame, fs: float = 256.0, nperseg: int = 256, x: str = "x") -> DataFrame:
    """One row per window and frequency: Welch density over half-overlapping Hann segments.

    Segments lose their mean; windows shorter than ``nperseg`` form one segment.
    """

    def kernel(values: np.ndarray) -> list[np.ndarray]:
        length = min(nperseg, values.shape[1])
        taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
        step = max(length - length // 2, 1)
        power = 0.0
        starts = range(0, values.shape[1] - length + 1, step)
        for start in starts:
            part = values[:, start : start + length]
            part = (part - part.mean(axis=1, keepdims=True)) * taper
            power = power + np.abs(np.fft.rfft(part, axis=1)) ** 2
        power = power / len(starts) / (fs * (taper**2).sum())
        inner = slice(1, -1 if length % 2 == 0 else None)
        power[:, inner] *= 2
        return [power]

    wide = map_windows(df, kernel, "_psd", "array<double>", x)
    others = [c for c in df.columns if c != x]
    length = F.least(F.lit(nperseg), F.size(x))
    return wide.select(*others, length.alias("_n"), F.posexplode("_psd").alias("bin", "power")).select(
        *others, "bin", (F.col("bin") * F.lit(float(fs)) / F.col("_n")).alias("freq"), "power"
    )


def class_spectrum(spectra: DataFrame, by: Sequence[str] = ("ch", "y")) -> DataFrame:
    """Mean and deviation of the power per class, channel and frequency."""
    return spectra.groupBy(*by, "bin", "freq").agg(
        F.avg("power").alias("mean_power"), F.stddev_pop("power").alias("std_power")
    )


# EEG frequency bands in Hz, lower edge included.
BANDS = {
    "delta": (0.5, 4.0),
    "theta": (4.0, 8.0),
    "alpha": (8.0, 13.0),
    "beta": (13.0, 30.0),
    "gamma": (30.0, 45.0),
}


def band_power(spectrum: DataFrame, by: Sequence[str] = ("ch", "y")) -> DataFrame:
    """Mean trapezoid area of each band, from a ``class_spectrum`` of equally long windows.

    The area is linear in the power, so the area of the mean spectrum is the mean area
    of the windows; only the small class spectrum is read.
    """
    freq = F.col("freq")
    band = F.lit(None).cast("string")
    for name, (low, high) in BANDS.items():
        band = F.when((freq >= low) & (freq < high), F.lit(name)).otherwise(band)
    inside = spectrum.withColumn("band", band).where("band is not null")
    ahead = W.partitionBy(*by, "band").orderBy("freq")
    step = F.lead("freq").over(ahead) - freq
    height = (F.lead("mean_power").over(ahead) + F.col("mean_power")) / 2
    return (
        inside.withColumn("_area", F.coalesce(step * height, F.lit(0.0)))
        .groupBy(*by, "band")
        .agg(F.sum("_area").alias("power"))
    )
