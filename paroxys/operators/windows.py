"""Signal operators on long ``(recording, channel, i, value)`` samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paroxys.functions import arrays
from paroxys.functions.arrays import let
from paroxys.operators.ordered import CHUNK_ROWS, index_chunk, with_halo

GROUP = ("user_id",)
# Samples whose windows are sliced from one array.
SLICE_ROWS = CHUNK_ROWS // 4
_SAMPLES = "array<struct<i:bigint,v:double>>"


def n_windows(length: Column, window: int, stride: int) -> Column:
    """How many whole windows fit into ``length`` samples."""
    return F.greatest(F.floor((length - window) / stride) + 1, F.lit(0)).cast("bigint")


def _check(window: int, stride: int) -> None:
    if window < 1 or stride < 1:
        raise ValueError("window and stride must be positive")


def windows_per_chunk(window: int, stride: int, size: int = SLICE_ROWS) -> int:
    """Windows that start in one chunk: a whole number of strides near ``size`` samples."""
    return max(-(-size // stride), -(-window // stride))


def _packed(
    df: DataFrame,
    window: int,
    stride: int,
    group: Sequence[str],
    index: str,
    value: str,
    size: int,
    together: Sequence[str] | None = None,
) -> DataFrame:
    """One sorted array ``s`` per chunk, with the samples its windows need from the next."""
    span = windows_per_chunk(window, stride, size) * stride
    rows = with_halo(df, index, 0, max(window - stride, 0), span)
    if together:
        rows = rows.repartition(*together, "chunk")
    item = F.struct(F.col(index).cast("bigint").alias("i"), F.col(value).cast("double").alias("v"))
    packed = rows.groupBy(*group, "chunk").agg(F.sort_array(F.collect_list(item)).alias("s"))
    begin = F.col("chunk") * span
    return packed.withColumn("s", _whole(F.col("s"), begin)).where(F.size("s") >= window)


def _whole(s: Column, begin: Column) -> Column:
    """The sorted samples, if they count up from ``begin`` one by one; else the job fails.

    Windows are slices by position, so a missing or doubled sample would shift them.
    """
    last = F.element_at(s, -1)["i"]
    sound = (last >= begin) & (s["i"] == F.sequence(begin.cast("bigint"), F.greatest(last, begin).cast("bigint")))
    broken = F.raise_error(F.lit("samples of a recording are missing or given twice"))
    return F.when(sound, s).otherwise(broken.cast(_SAMPLES))


def _gaps(df: DataFrame, group: Sequence[str], index: str) -> Column:
    """How many recordings do not count their samples from 0 without holes; a scalar."""
    found = df.groupBy(*group).agg((F.max(index) + 1 != F.count(F.lit(1))).alias("_bad"))
    return found.agg(F.count_if("_bad")).scalar()


def sliding_windows(
    df: DataFrame,
    window: int,
    stride: int,
    group: Sequence[str] = GROUP,
    index: str = "i",
    value: str = "value",
    size: int = SLICE_ROWS,
) -> DataFrame:
    """Whole windows ``(k, start, x)`` at 0, stride, 2*stride, …; the tail is dropped.

    One shuffle by ``(recording, chunk)``: a chunk holds a whole number of strides and
    borrows the ``window - stride`` samples that its last windows reach into the next
    chunk, then slices its bounded array. Samples are copied once per chunk border, not
    once per window.
    """
    _check(window, stride)
    per_chunk = windows_per_chunk(window, stride, size)
    packed = _packed(df, window, stride, group, index, value, size)
    last = F.least(F.lit(per_chunk - 1), F.floor((F.size("s") - window) / F.lit(stride)).cast("int"))

    def cut_all(v: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda j: F.struct(
                (F.col("chunk") * per_chunk + j).cast("bigint").alias("k"),
                F.slice(v, j * stride + 1, F.lit(window)).alias("x"),
            ),
        )

    cut = let(F.col("s.v"), cut_all)
    return packed.select(*group, F.explode(cut).alias("w")).select(
        *group, "w.k", (F.col("w.k") * stride).alias("start"), "w.x"
    )


def window_positions(
    lengths: DataFrame, window: int, stride: int, length: str = "n_samples"
) -> DataFrame:
    """A row per whole window of every recording, from the recordings' lengths alone."""
    _check(window, stride)
    last = n_windows(F.col(length), window, stride) - 1
    return lengths.where(last >= 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))


def cut_chosen(
    df: DataFrame,
    chosen: DataFrame,
    window: int,
    stride: int,
    recording: Sequence[str],
    channel: str = "channel",
    index: str = "i",
    value: str = "value",
    norms: DataFrame | None = None,
    size: int = SLICE_ROWS,
) -> DataFrame:
    """Cut only the windows listed in ``chosen`` (``recording…, k`` and more columns).

    Samples are placed by ``(recording, chunk)`` once, for all channels. The chosen
    windows arrive as one array per chunk on the same key, so signals are not shuffled
    again to meet their labels, and windows that were not chosen are never built. The
    same join brings ``norms`` (``channel_scaling``), applied before slicing.
    """
    _check(window, stride)
    per_chunk = windows_per_chunk(window, stride, size)
    packed = _packed(df, window, stride, [*recording, channel], index, value, size, recording)
    columns = [c for c in chosen.columns if c not in recording]
    wanted = (
        chosen.withColumn("chunk", F.floor(F.col("k") / F.lit(per_chunk)).cast("bigint"))
        .groupBy(*recording, "chunk")
        .agg(F.collect_list(F.struct(*columns)).alias("wanted"))
    )
    if norms is not None:
        wanted = wanted.join(norms, list(recording))

    def scaled(v: Column) -> Column:
        if norms is None:
            return v
        norm = F.col("norms")[F.col(channel)]
        return let(norm, lambda n: F.transform(v, lambda x: (x - n["shift"]) / n["scale"]))

    def cut_all(v: Column) -> Column:
        first = F.col("chunk") * per_chunk
        return F.transform(
            "wanted",
            lambda w: F.struct(
                *[w[c].alias(c) for c in columns],
                F.slice(v, ((w["k"] - first) * stride + 1).cast("int"), F.lit(window)).alias("x"),
            ),
        )

    joined = packed.join(wanted, [*recording, "chunk"])
    cut = joined.select(*recording, channel, F.explode(let(scaled(F.col("s.v")), cut_all)).alias("w"))
    return cut.select(*recording, channel, "w.*").where(F.size("x") == window)


def sliding_windows_by_copy(
    df: DataFrame,
    window: int,
    stride: int,
    group: Sequence[str] = GROUP,
    index: str = "i",
    value: str = "value",
) -> DataFrame:
    """The same windows by sending each sample to every window that holds it.

    Fits strides near or above the window length, where samples are hardly copied and
    no recording needs a large array.
    """
    _check(window, stride)
    i = F.col(index)
    first = F.greatest(F.lit(0), F.ceil((i - window + 1) / F.lit(stride))).cast("bigint")
    last = F.floor(i / F.lit(stride)).cast("bigint")
    broken = F.raise_error(F.lit("samples of a recording are missing or given twice"))
    sound = F.when(_gaps(df, group, index) == 0, F.lit(True)).otherwise(broken.cast("boolean"))
    members = df.where(sound & (first <= last)).withColumn("k", F.explode(F.sequence(first, last)))
    item = F.struct(i.cast("bigint").alias("i"), F.col(value).cast("double").alias("v"))
    return (
        members.groupBy(*group, "k")
        .agg(F.sort_array(F.collect_list(item)).alias("s"))
        .withColumn("s", _whole(F.col("s"), F.col("k") * stride))
        .where(F.size("s") == window)
        .select(*group, "k", (F.col("k") * stride).alias("start"), F.col("s.v").alias("x"))
    )


def start_seconds(windows: DataFrame, stride: int, rate: float) -> DataFrame:
    return windows.withColumn("start_sec", F.col("k") * stride / F.lit(float(rate)))


def scaling(value: str, mode: str, eps: float | None = None) -> tuple[Column, Column]:
    """Aggregates ``(shift, scale)`` of a normalisation, ``(x - shift) / scale``."""
    if mode == "zscore":
        return F.avg(value), F.stddev_pop(value) + (1e-6 if eps is None else eps)
    if mode == "minmax":
        return F.min(value), F.max(value) - F.min(value) + (1e-8 if eps is None else eps)
    raise ValueError(f"unknown normalisation {mode!r}")


def channel_scaling(
    df: DataFrame, mode: str, recording: Sequence[str], channel: str = "channel", value: str = "value"
) -> DataFrame:
    """``norms`` per recording: a map from channel to shift and scale (a montage is small)."""
    shift, scale = scaling(value, mode)
    figures = df.groupBy(*recording, channel).agg(shift.alias("shift"), scale.alias("scale"))
    entry = F.struct(F.col(channel), F.struct("shift", "scale"))
    return figures.groupBy(*recording).agg(F.map_from_entries(F.collect_list(entry)).alias("norms"))


def _scale(
    df: DataFrame,
    mode: str,
    eps: float,
    group: Sequence[str],
    index: str,
    value: str,
    out: str,
    size: int,
) -> DataFrame:
    """Scale every sample by statistics of its whole recording and channel.

    Statistics are one small row per group. They are repeated once per chunk the group
    spans and joined by chunk, so a long recording spreads over many join tasks;
    Spark broadcasts them when they are small.
    """
    home = index_chunk(index, size)
    shift, scale = scaling(value, mode, eps)
    summary = (
        df.groupBy(*group)
        .agg(
            shift.alias("_shift"),
            scale.alias("_scale"),
            F.min(home).alias("_c0"),
            F.max(home).alias("_c1"),
        )
        .withColumn("_chunk", F.explode(F.sequence("_c0", "_c1")))
        .drop("_c0", "_c1")
    )
    joined = df.withColumn("_chunk", home).join(summary, [*group, "_chunk"])
    scaled = (F.col(value) - F.col("_shift")) / F.col("_scale")
    return joined.withColumn(out, scaled).drop("_chunk", "_shift", "_scale")


def zscore(
    df: DataFrame,
    group: Sequence[str] = ("user_id", "channel"),
    eps: float = 1e-6,
    index: str = "i",
    value: str = "value",
    out: str = "value",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """``(x - mean) / (population std + eps)`` over each channel of a recording."""
    return _scale(df, "zscore", eps, group, index, value, out, size)


def minmax(
    df: DataFrame,
    group: Sequence[str] = ("user_id", "channel"),
    eps: float = 1e-8,
    index: str = "i",
    value: str = "value",
    out: str = "value",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """``(x - min) / (max - min + eps)`` over each channel of a recording."""
    return _scale(df, "minmax", eps, group, index, value, out, size)


def normalise(df: DataFrame, mode: str | None, **options) -> DataFrame:
    """``zscore``, ``minmax``, or anything else for unchanged samples."""
    if mode == "zscore":
        return zscore(df, **options)
    if mode == "minmax":
        return minmax(df, **options)
    return df


def zscore_window(df: DataFrame, x: str = "x", eps: float = 1e-6, out: str = "x") -> DataFrame:
    """Z-score of each window by its own mean and deviation; no shuffle."""

    def scale(values: Column) -> Column:
        return let(
            arrays.mean(values),
            lambda m: let(
                arrays.std(values, m) + eps, lambda s: F.transform(values, lambda v: (v - m) / s)
            ),
        )

    return df.withColumn(out, let(F.col(x), scale))


def downsample(
    df: DataFrame,
    source_rate: int,
    target_rate: int,
    group: Sequence[str] = GROUP,
    index: str = "i",
    value: str = "value",
) -> DataFrame:
    """Mean of the samples that fall into each step of the lower rate."""
    if target_rate > source_rate:
        raise ValueError("target_rate must not exceed source_rate")
    step = F.floor(F.col(index) * target_rate / F.lit(source_rate)).cast("bigint")
    return df.groupBy(*group, step.alias(index)).agg(F.avg(value).alias(value))


def trend_seasonal(
    df: DataFrame,
    kernel: int = 25,
    group: Sequence[str] = GROUP,
    index: str = "i",
    value: str = "value",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Centred moving average (cut at the ends) and what remains of the signal."""
    half = kernel // 2
    rows = with_halo(df, index, half, half, size)
    frame = W.partitionBy(*group, "chunk").orderBy(index).rowsBetween(-half, half)
    return (
        rows.withColumn("trend", F.avg(value).over(frame))
        .where("own")
        .drop("chunk", "own")
        .withColumn("seasonal", F.col(value) - F.col("trend"))
    )
