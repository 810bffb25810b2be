"""Training-set augmentation of window arrays.

Every random choice is a hash of the window key and a seed: repeatable, JVM-side, no
shuffle. Compose by chaining ``DataFrame.transform``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paroxys.functions.arrays import let
from paroxys.functions.hashing import uniform


def compose(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


def _chosen(key: str, p: float, seed: int) -> Column:
    return uniform(key, seed) < p


def time_shift(
    df: DataFrame, max_shift: int = 50, p: float = 0.5, key: str = "window_id", seed: int = 1, x: str = "x"
) -> DataFrame:
    """Rotate by a whole number of samples in ``[-max_shift, max_shift)``."""
    shift = F.floor(uniform(key, seed + 1) * (2 * max_shift)).cast("int") - max_shift
    n = F.size(x)
    head = F.pmod(-shift, n)
    rotated = F.concat(F.slice(x, head + 1, n), F.slice(x, F.lit(1), head))
    return df.withColumn(x, F.when(_chosen(key, p, seed), rotated).otherwise(F.col(x)))


def amplitude_scale(
    df: DataFrame,
    low: float = 0.8,
    high: float = 1.2,
    p: float = 0.5,
    key: str = "window_id",
    seed: int = 2,
    x: str = "x",
) -> DataFrame:
    """Multiply by one factor in ``[low, high)``."""
    factor = low + (high - low) * uniform(key, seed + 1)
    scaled = let(factor, lambda f: F.transform(x, lambda v: v * f))
    return df.withColumn(x, F.when(_chosen(key, p, seed), scaled).otherwise(F.col(x)))


def channel_dropout(
    df: DataFrame,
    channels: int,
    p: float = 0.1,
    key: str = "window_id",
    channel: str = "ch",
    seed: int = 3,
    x: str = "x",
) -> DataFrame:
    """Zero one channel of the chosen windows (rows are window channels)."""
    dropped = F.floor(uniform(key, seed + 1) * channels).cast("int")
    silent = F.transform(x, lambda v: F.lit(0.0))
    return df.withColumn(
        x, F.when(_chosen(key, p, seed) & (F.col(channel) == dropped), silent).otherwise(F.col(x))
    )


def gaussian_noise(
    df: DataFrame, std: float = 0.01, p: float = 0.5, key: str = "window_id", seed: int = 4, x: str = "x"
) -> DataFrame:
    """Add normal noise: Box-Muller on two draws per sample, from the window's key and
    the sample's place."""

    def noisy(v: Column, i: Column) -> Column:
        place = F.concat_ws(":", F.col(key).cast("string"), (i + 1).cast("string"))
        size = F.sqrt(-2 * F.log(1 - uniform(place, seed + 1)))
        return v + std * size * F.cos(2 * math.pi * uniform(place, seed + 2))

    return df.withColumn(x, F.when(_chosen(key, p, seed), F.transform(x, noisy)).otherwise(F.col(x)))
