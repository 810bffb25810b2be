"""Scores, decisions and array clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def softmax_positive(l0: Column, l1: Column) -> Column:
    """Probability of class 1 from two logits."""
    return 1 / (1 + F.exp(l0 - l1))


def cross_entropy(l0: Column, l1: Column) -> tuple[Column, Column]:
    """Cross-entropy of two logits against class 0 and class 1, safe for large gaps."""
    top = F.greatest(l0, l1)
    log_norm = top + F.log(F.exp(l0 - top) + F.exp(l1 - top))
    return log_norm - l0, log_norm - l1


def decide(df: DataFrame, threshold: float = 0.5, l0: str = "l0", l1: str = "l1") -> DataFrame:
    """Probability and decision of every scored row."""
    scored = df.withColumn("prob", softmax_positive(F.col(l0), F.col(l1)))
    return scored.withColumn("pred", (F.col("prob") >= threshold).cast("int"))


def scrub(values: Column) -> Column:
    """Array with NaN and null as 0, +Inf as 5 and -Inf as 0."""
    inf = float("inf")
    return F.transform(
        values,
        lambda v: F.when(v.isNull() | F.isnan(v) | (v == -inf), F.lit(0.0))
        .when(v == inf, F.lit(5.0))
        .otherwise(v),
    )
