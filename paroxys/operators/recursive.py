"""Zero-phase recursive filtering of whole recordings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from paroxys.operators.ordered import CHUNK_ROWS, map_halo_chunks, with_halo


#: Samples whose recursion is worked out by one product of matrices.
STEP = 64


class Cascade:
    """A recursive filter as a moving sum followed by one section per pole.

    Sections keep poles of any multiplicity accurate, where one long recursion would
    magnify rounding by the product of their gains. Conjugate poles follow each other;
    after the second the values are real again.
    """

    def __init__(self, b: Sequence[float], a: Sequence[float]) -> None:
        num, den = np.trim_zeros(np.asarray(b, float), "b"), np.trim_zeros(np.asarray(a, float), "b")
        self.taps = num / den[0] if len(num) else np.zeros(1)
        poles = np.roots(den) if len(den) > 1 else np.empty(0)
        if len(poles) and np.abs(poles).max() >= 1:
            raise ValueError("the filter is unstable")
        pairs = [q for p in poles[poles.imag > 0] for q in (p, p.conjugate())]
        self.poles = [*pairs, *np.sort(poles[poles.imag == 0].real)]

    def run(self, x: np.ndarray) -> np.ndarray:
        """Filter as if the first value had always been there."""
        n = len(x)
        reach = len(self.taps) - 1
        u = np.convolve(np.concatenate([np.full(reach, x[0]), x]), self.taps)[reach : reach + n]
        rest = x[0] * self.taps.sum()
        spare = np.zeros(-n % STEP)
        lag = np.arange(STEP)[:, None] - np.arange(STEP)[None, :]
        for place, pole in enumerate(self.poles):
            rest = rest / (1 - pole)
            forced = np.where(lag >= 0, pole ** np.maximum(lag, 0), 0)
            blocks = np.concatenate([u, spare]).reshape(-1, STEP) @ forced.T
            before, last, step = [], rest, pole**STEP
            for end in blocks[:, -1].tolist():
                before.append(last)
                last = end + step * last
            u = (blocks + np.array(before)[:, None] * pole ** np.arange(1, STEP + 1)).ravel()[:n]
            if place and np.iscomplexobj(u) and pole == np.conjugate(self.poles[place - 1]):
                u, rest = u.real, rest.real
        return u

    def memory(self) -> int:
        """Samples until what is left of the response is below 2**-60 of its whole."""
        n = 4 * STEP
        while True:
            # The step response less its first value: an impulse at the second sample.
            impulse = np.zeros(n)
            impulse[1] = 1.0
            left = np.cumsum(np.abs(self.run(impulse))[::-1])[::-1]
            short = np.flatnonzero(left <= left[0] * 2.0**-60)
            if len(short) and short[0] <= n // 2:
                return int(short[0])
            if n > 1 << 26:
                raise ValueError("the filter remembers too long")
            n *= 2


def both_ways(cascade: Cascade, x: np.ndarray, pad: int) -> np.ndarray:
    """Forward then backward, with odd reflections of ``pad`` samples at the ends."""
    pad = min(pad, len(x) - 1)
    head = 2 * x[0] - x[pad:0:-1]
    tail = 2 * x[-1] - x[::-1][1 : pad + 1]
    forward = cascade.run(np.concatenate([head, x, tail]))
    return cascade.run(forward[::-1])[::-1][pad : pad + len(x)]


def iir_filter(
    df: DataFrame,
    b: Sequence[float],
    a: Sequence[float],
    group: Sequence[str] = ("user_id",),
    index: str = "i",
    value: str = "value",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Filter every recording forward and backward with the given coefficients.

    Recordings are odd-reflected by three filter lengths at their true ends. Chunks
    carry as many neighbouring samples as the recursion remembers (to below double
    rounding), so a long recording is filtered by many tasks with the result of one.
    """
    cascade = Cascade(b, a)
    pad = 3 * max(len(a), len(b))
    memory = cascade.memory() + pad
    size = max(size, memory)

    rows = with_halo(df, index, memory, memory, size)
    return map_halo_chunks(
        rows, group, index, value, lambda x: both_ways(cascade, x, pad), value
    ).select(*df.columns)
