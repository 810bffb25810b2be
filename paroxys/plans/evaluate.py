"""Evaluation of a scored table: segment, area and event metrics side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from paroxys.operators.alarms import event_metrics
from paroxys.operators.metrics import auc_roc, segment_metrics


def evaluate(
    scored: DataFrame,
    by: Sequence[str] = ("fold",),
    group: Sequence[str] = ("fold", "recording"),
    index: str = "k",
    seconds_per_window: float = 4.0,
    credit: str = "first",
) -> DataFrame:
    """One row per ``by``; event metrics follow ``index`` inside each recording.

    With a stride below the window length pass the stride as ``seconds_per_window``:
    hours are counted per window.
    """
    keys = list(by)
    segment = segment_metrics(scored, keys)
    area = auc_roc(scored, keys).select(*keys, "auc_roc")
    events = event_metrics(scored, seconds_per_window, credit, keys, group, index)
    return segment.join(area, keys).join(events, keys)
