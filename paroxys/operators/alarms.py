"""From window decisions to alarms: voting, smoothing, merging, runs and events.

All inputs hold one row per window: ``group`` columns name the recording, ``index``
counts its windows from 0 without holes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paroxys.operators.ordered import (
    CHUNK_ROWS,
    index_chunk,
    map_halo_chunks,
    running,
    with_halo,
)

GROUP = ("user_id",)
WHOLE = (W.unboundedPreceding, W.unboundedFollowing)


def _frame(group: Sequence[str], index: str, first: int, last: int):
    return W.partitionBy(*group, "chunk").orderBy(index).rowsBetween(first, last)


def _shifts(
    group: Sequence[str], index: str, value: str, reach: int
) -> tuple[list[Column], list[Column]]:
    """Values 1, 2, … ``reach`` rows before and after; null beyond the ends."""
    order = W.partitionBy(*group, "chunk").orderBy(index)
    steps = range(1, reach + 1)
    return (
        [F.lag(value, j).over(order) for j in steps],
        [F.lead(value, j).over(order) for j in steps],
    )


def _too_short(group: Sequence[str], index: str, n: int) -> Column:
    """True in recordings of fewer than ``n`` windows (only their first chunk can say so)."""
    return F.max(index).over(_frame(group, index, *WHOLE)) < n - 1


def _vote(group: Sequence[str], index: str, value: str, n: int, k: int) -> Column:
    half = n // 2
    votes = F.coalesce(F.sum(value).over(_frame(group, index, -half, half)), F.lit(0))
    return F.when(_too_short(group, index, n), F.col(value)).otherwise(
        (votes >= k).cast("int")
    )


def _bridge(group: Sequence[str], index: str, value: str, collar: int) -> Column:
    alarm_at = F.when(F.col(value) == 1, F.col(index))
    previous = F.max(alarm_at).over(_frame(group, index, -collar, -1))
    gap = F.min(alarm_at).over(_frame(group, index, 1, collar)) - previous - 1
    raised = F.coalesce(F.col(value) == 1, F.lit(False))
    return (raised | F.coalesce(gap <= collar, F.lit(False))).cast("int")


def _settle(df: DataFrame) -> DataFrame:
    return df.where("own").drop("chunk", "own")


def majority_vote(
    df: DataFrame,
    n: int = 3,
    k: int = 2,
    group: Sequence[str] = GROUP,
    index: str = "k",
    value: str = "pred",
    out: str = "pred",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """1 where at least ``k`` of the windows within ``n // 2`` are 1.

    The frame is cut at the recording's ends; a recording shorter than ``n`` keeps its
    decisions. Even ``n`` therefore counts ``n + 1`` windows. A null decision counts as 0.
    """
    half = n // 2
    rows = with_halo(df, index, half, half, max(size, n))
    return _settle(rows.withColumn(out, _vote(group, index, value, n, k)))


def collar_merge(
    df: DataFrame,
    collar: int = 3,
    group: Sequence[str] = GROUP,
    index: str = "k",
    value: str = "pred",
    out: str = "pred",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Fill gaps of at most ``collar`` windows between two alarms."""
    if collar < 1:
        return df.withColumn(out, F.col(value))
    rows = with_halo(df, index, collar, collar, size)
    return _settle(rows.withColumn(out, _bridge(group, index, value, collar)))


def vote_and_merge(
    df: DataFrame,
    n: int = 3,
    k: int = 2,
    collar: int = 3,
    vote: bool = True,
    merge: bool = True,
    group: Sequence[str] = GROUP,
    index: str = "k",
    value: str = "pred",
    out: str = "pred",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Majority vote, then collar merge, in one shuffle: the halo covers both."""
    merge = merge and collar >= 1
    reach = (n // 2 if vote else 0) + (collar if merge else 0)
    rows = with_halo(df, index, reach, reach, max(size, n)).withColumn(out, F.col(value))
    if vote:
        rows = rows.withColumn(out, _vote(group, index, out, n, k))
    if merge:
        rows = rows.withColumn(out, _bridge(group, index, out, collar))
    return _settle(rows)


def vote_level(
    df: DataFrame,
    n: int = 3,
    k: int = 2,
    collar: int = 0,
    group: Sequence[str] = GROUP,
    index: str = "k",
    prob: str = "prob",
    out: str = "level",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """The highest threshold at which vote-then-merge still raises each window.

    Voting at threshold t asks whether the k-th largest probability in the frame
    reaches t, and merging asks whether both ends of some short gap reach t. Both
    commute with thresholding, so one pass over scores serves every threshold. Windows
    that no threshold raises get minus infinity.
    """
    reach = n // 2 + collar
    floor = F.lit(float("-inf"))
    rows = with_halo(df, index, reach, reach, max(size, n))
    back, ahead = _shifts(group, index, prob, n // 2)
    in_frame = F.sort_array(F.array(F.col(prob), *back, *ahead), asc=False)
    ranked = F.coalesce(F.get(in_frame, F.lit(k - 1)), floor)
    rows = rows.withColumn(
        out, F.when(_too_short(group, index, n), F.col(prob)).otherwise(ranked)
    )
    if collar:
        back, ahead = _shifts(group, index, out, collar)
        ends = [
            F.least(F.coalesce(left, floor), F.coalesce(right, floor))
            for i, left in enumerate(back, 1)
            for right in ahead[: collar + 1 - i]
        ]
        rows = rows.withColumn(out, F.greatest(out, *ends))
    return _settle(rows)


def _smooth(p: np.ndarray, alpha: float, block: int = 32) -> np.ndarray:
    """Exponential average of one stretch, started at its first value."""
    keep = 1.0 - alpha
    lag = np.subtract.outer(np.arange(block), np.arange(block))
    weights = np.where(lag >= 0, alpha * keep ** np.maximum(lag, 0), 0.0)
    padded = np.zeros(-(-len(p) // block) * block)
    padded[: len(p)] = p
    padded[0] = p[0] / alpha
    local = padded.reshape(-1, block) @ weights.T
    fade = keep ** np.arange(1, block + 1)
    carry = 0.0
    for row in local:
        row += carry * fade
        carry = row[-1]
    return local.ravel()[: len(p)]


def ema_smooth(
    df: DataFrame,
    alpha: float = 0.3,
    threshold: float = 0.5,
    group: Sequence[str] = GROUP,
    index: str = "k",
    prob: str = "prob",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``ema`` (causal, started at the first probability) and ``ema_pred``.

    A chunk starts its recursion early, on the last rows of the chunk before it. The
    warm-up is as long as an unknown start takes to fade below 2**-60, less than the
    rounding of a double, so chunked and unbroken runs agree.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must lie in (0, 1]")
    warm = 0 if alpha == 1 else math.ceil(-60 * math.log(2) / math.log(1 - alpha))
    rows = with_halo(df, index, warm, 0, max(size, warm))
    smoothed = map_halo_chunks(rows, group, index, prob, lambda p: _smooth(p, alpha), "ema")
    return smoothed.withColumn("ema_pred", (F.col("ema") >= threshold).cast("int"))


def run_starts(
    df: DataFrame,
    values: dict[str, str],
    group: Sequence[str] = GROUP,
    index: str = "k",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """For each ``value -> out`` add the first index of the run of 1s a row lies in."""
    last_zero = {
        out: F.when(F.col(value) == 0, F.col(index)) for value, out in values.items()
    }
    rows = df.withColumn("chunk", index_chunk(index, size))
    rows = running(rows, group, "chunk", [index], maxes=last_zero)
    starts = {
        out: F.when(F.col(value) == 1, F.coalesce(F.col(out), F.lit(-1)) + 1)
        for value, out in values.items()
    }
    return rows.withColumns(starts).drop("chunk")


def alarm_runs(
    df: DataFrame,
    group: Sequence[str] = GROUP,
    index: str = "k",
    value: str = "pred",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Runs of 1s as inclusive ``(start_k, end_k)``."""
    rows = run_starts(df.select(*group, index, value), {value: "start_k"}, group, index, size)
    return (
        rows.where("start_k is not null")
        .groupBy(*group, "start_k")
        .agg(F.max(index).alias("end_k"))
    )


def event_metrics(
    df: DataFrame,
    seconds_per_window: float = 4.0,
    credit: str = "first",
    by: Sequence[str] = GROUP,
    group: Sequence[str] = GROUP,
    index: str = "k",
    truth: str = "y",
    value: str = "pred",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """False alarms per hour and detected seizures, per ``by`` (a subset of ``group``).

    A predicted run that meets a true run is no false alarm. With ``credit="first"``
    it detects only the first true run it meets, with ``"any"`` all of them. Two runs
    meet exactly where a window is 1 in both, so no run-to-run join is needed.
    """
    if credit not in ("first", "any"):
        raise ValueError("credit must be 'first' or 'any'")
    rows = run_starts(
        df.select(*dict.fromkeys([*group, index, truth, value])),
        {truth: "true_start", value: "pred_start"},
        group,
        index,
        size,
    )
    both = (F.col(truth) == 1) & (F.col(value) == 1)
    per_run = rows.groupBy(*group, "pred_start").agg(
        F.min(F.when(both, F.col("true_start"))).alias("first_met"),
        F.count(F.lit(1)).alias("windows"),
        F.count(F.when(F.col(index) == F.col("true_start"), 1)).alias("seizures"),
    )
    per_seizure = per_run.groupBy(*group, "first_met").agg(
        F.count(
            F.when(F.col("pred_start").isNotNull() & F.col("first_met").isNull(), 1)
        ).alias("false_alarms"),
        F.sum("windows").alias("windows"),
        F.sum("seizures").alias("seizures"),
    )
    counts = per_seizure.groupBy(*by).agg(
        F.count("first_met").alias("n_detected"),
        F.sum("seizures").alias("n_seizures"),
        F.sum("false_alarms").alias("n_false_alarms"),
        F.sum("windows").alias("n_windows"),
    )
    if credit == "any":
        met = rows.where(both).select(*group, "true_start").distinct()
        met = met.groupBy(*by).agg(F.count(F.lit(1)).alias("_met"))
        if by:
            counts = counts.join(met, list(by), "left")
        else:
            counts = counts.withColumn("_met", met.select("_met").scalar())
        counts = counts.withColumn(
            "n_detected", F.coalesce(F.col("_met"), F.lit(0)).cast("bigint")
        ).drop("_met")
    hours = F.col("n_windows") * F.lit(float(seconds_per_window)) / 3600.0
    return counts.withColumn("hours", hours).withColumns(
        {
            "detection_rate": F.col("n_detected") / F.greatest("n_seizures", F.lit(1)),
            "fp_per_hour": F.col("n_false_alarms") / F.greatest("hours", F.lit(1e-12)),
        }
    )


def per_threshold(
    df: DataFrame,
    thresholds: Sequence[float],
    post: Callable[[DataFrame, Sequence[str]], DataFrame],
    group: Sequence[str] = GROUP,
    prob: str = "prob",
) -> DataFrame:
    """Decisions under every threshold after any row-preserving post-processing.

    ``post`` receives the decisions and the grouping to respect. Rows multiply by the
    number of thresholds; prefer ``vote_level`` where it fits.
    """
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    rows = df.withColumn("threshold", grid)
    rows = rows.withColumn("pred", (F.col(prob) >= F.col("threshold")).cast("int"))
    return post(rows, [*group, "threshold"])
