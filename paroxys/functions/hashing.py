"""Repeatable pseudo-random draws, the same in every engine and on every retry.

A draw is the head of the MD5 digest of ``seed:key``. Seeds are mixed in before the
digest, so draws of different seeds, and of neighbouring keys, are independent. Keys of
any type work by their text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws are whole numbers below this: 13 hexadecimal digits.
MODULUS = 1 << 52


def replayable_key(key: str | Column, seed: int = 42) -> Column:
    """Pseudo-random integer in ``[0, MODULUS)``; a null key counts as empty text."""
    col = F.col(key) if isinstance(key, str) else key
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("bigint")


def uniform(key: str | Column, seed: int = 42) -> Column:
    """Pseudo-random double in ``[0, 1)``."""
    return replayable_key(key, seed) / F.lit(float(MODULUS))
