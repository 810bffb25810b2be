"""Daubechies-4 wavelet: array expressions for Catalyst and kernels for Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from paroxys.functions.arrays import let

# Daubechies-4 analysis low-pass filter.
DB4_LOW = (
    -0.010597401784997278,
    0.032883011666982945,
    0.030841381835986965,
    -0.18703481171888114,
    -0.02798376941698385,
    0.6308807679295904,
    0.7148465705525415,
    0.23037781330885523,
)
TAPS = len(DB4_LOW)
DB4_HIGH = tuple((-1) ** (j + 1) * DB4_LOW[TAPS - 1 - j] for j in range(TAPS))


def analyse_expr(x: Column, taps: tuple[float, ...]) -> Column:
    """One analysis step with half-sample symmetric edges, as an array expression."""
    return let(x, lambda values: let(F.size(values), lambda n: _convolve(values, n, taps)))


def _convolve(x: Column, n: Column, taps: tuple[float, ...]) -> Column:

    def reflected(i: Column) -> Column:
        return let(
            F.pmod(i, 2 * n),
            lambda at: F.get(x, F.when(at < n, at).otherwise(2 * n - 1 - at)),
        )

    def output(k: Column) -> Column:
        total = F.lit(0.0)
        for j, tap in enumerate(taps):
            total = total + F.lit(tap) * reflected(2 * k + F.lit(1 - j))
        return total

    last = F.floor((n + TAPS - 1) / 2).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), output)


def analyse(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Approximation and detail of every row of a ``(rows, n)`` array."""
    n = x.shape[-1]
    m = (n + TAPS - 1) // 2
    at = (2 * np.arange(m)[:, None] + 1 - np.arange(TAPS)[None, :]) % (2 * n)
    frames = x[..., np.where(at < n, at, 2 * n - 1 - at)]
    return frames @ np.array(DB4_LOW), frames @ np.array(DB4_HIGH)


def synthesise(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Inverse of ``analyse``, possibly one sample longer than its input."""
    m = low.shape[-1]
    full = np.zeros(low.shape[:-1] + (2 * m + TAPS - 2,))
    for part, taps in ((low, DB4_LOW), (high, DB4_HIGH)):
        for j, tap in enumerate(reversed(taps)):
            full[..., j : j + 2 * m : 2] += tap * part
    return full[..., TAPS - 2 : 2 * m]


def decompose(x: np.ndarray, level: int) -> list[np.ndarray]:
    """``[approximation, detail level, …, detail 1]``."""
    details = []
    for _ in range(level):
        x, detail = analyse(x)
        details.append(detail)
    return [x, *reversed(details)]


def recompose(bands: list[np.ndarray]) -> np.ndarray:
    x = bands[0]
    for detail in bands[1:]:
        x = synthesise(x[..., : detail.shape[-1]], detail)
    return x


def keep_bands(x: np.ndarray, level: int, kept: frozenset[int]) -> np.ndarray:
    """Signal rebuilt from the bands at the given positions of ``decompose``."""
    bands = decompose(x, level)
    chosen = [b if i in kept else np.zeros_like(b) for i, b in enumerate(bands)]
    return recompose(chosen)[..., : x.shape[-1]]


def halo_for(level: int) -> int:
    """Samples beyond a chunk that can influence it, rounded up to the decimation step."""
    reach = 2 * (TAPS - 1) * (2**level - 1)
    step = 2**level
    return -(-reach // step) * step
