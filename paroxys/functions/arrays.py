"""Array expressions that evaluate shared parts once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used inside another lambda would be inlined there and computed for every
    element; bound as a lambda variable it is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def std(x: Column, centre: Column) -> Column:
    """Population deviation around a mean that is a column or bound variable."""
    squares = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + (v - centre) * (v - centre))
    return F.sqrt(squares / F.size(x))
