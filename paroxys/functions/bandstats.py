"""Ten statistics of every row of an array; rows are handled together."""

from __future__ import annotations

import numpy as np

STATS = (
    "min",
    "max",
    "mean",
    "var",
    "std",
    "skewness",
    "kurtosis",
    "sample_entropy",
    "permutation_entropy",
    "shannon_entropy",
)


def moments(x: np.ndarray) -> list[np.ndarray]:
    mean = x.mean(axis=1)
    dev = x - mean[:, None]
    m2 = (dev**2).mean(axis=1)
    flat = np.ptp(x, axis=1) == 0
    with np.errstate(divide="ignore", invalid="ignore"):
        skew = np.where(flat, np.nan, (dev**3).mean(axis=1) / m2**1.5)
        kurt = np.where(flat, np.nan, (dev**4).mean(axis=1) / m2**2 - 3)
    return [x.min(axis=1), x.max(axis=1), mean, m2, np.sqrt(m2), skew, kurt]


def sample_entropy(
    x: np.ndarray, m: int = 2, tolerance: float = 0.2, max_n: int | None = None
) -> np.ndarray:
    """-log of how often m-point matches stay matches with one more point.

    Taken over the whole row, or over its first ``max_n`` points. 0 without spread or
    without matches of length m, infinite without longer ones. Rows are compared with
    themselves lag by lag, so memory stays that of the rows.
    """
    x = x[:, :max_n]
    n = x.shape[1]
    if n < 2:
        return np.zeros(len(x))
    radius = tolerance * x.std(axis=1, ddof=1)
    short, long = np.zeros(len(x)), np.zeros(len(x))
    for lag in range(1, n):
        close = np.abs(x[:, lag:] - x[:, :-lag]) <= radius[:, None]
        for length, total in ((m, short), (m + 1, long)):
            starts = n - length - lag
            if starts < 1:
                continue
            run = close[:, :starts].copy()
            for step in range(1, length):
                run &= close[:, step : step + starts]
            total += run.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.log(long / short)
    return np.where((radius == 0) | (short == 0), 0.0, entropy)


def permutation_entropy(x: np.ndarray) -> np.ndarray:
    """Entropy in bits of the order patterns of three successive points."""
    if x.shape[1] < 3:
        return np.zeros(len(x))
    a, b, c = x[:, :-2], x[:, 1:-1], x[:, 2:]
    pattern = 4 * (a <= b) + 2 * (a <= c) + 1 * (b <= c)
    share = np.stack([(pattern == p).mean(axis=1) for p in range(8)], axis=1)
    return -(share * np.log2(share + 1e-12)).sum(axis=1)


def shannon_entropy(x: np.ndarray, bins: int = 32) -> np.ndarray:
    """Entropy in bits of the histogram between a row's minimum and maximum."""
    low, width = x.min(axis=1), np.ptp(x, axis=1)
    safe = np.where(width == 0, 1.0, width)
    cell = np.minimum((x - low[:, None]) / safe[:, None] * bins, bins - 1).astype(np.int64)
    share = np.stack([(cell == b).mean(axis=1) for b in range(bins)], axis=1)
    logs = np.log2(share, out=np.zeros_like(share), where=share > 0)
    return -(share * logs).sum(axis=1)


def band_stats(x: np.ndarray, entropy_points: int | None = None) -> np.ndarray:
    """``(rows, 10)`` statistics in the order of ``STATS``.

    ``entropy_points`` limits the sample entropy to that many first points (64 is the
    usual shortcut); by default it covers the whole row.
    """
    entropy = sample_entropy(x, max_n=entropy_points)
    columns = [*moments(x), entropy, permutation_entropy(x), shannon_entropy(x)]
    return np.stack(columns, axis=1)
