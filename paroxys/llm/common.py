"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paroxys.session import shared_folder

#: The white space of the contracts: blank and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Byte table that lower-cases A-Z and leaves every other byte of UTF-8 alone.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Store rows in the shared folder and read them back: lineage ends at the files."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, also not in another case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        new = f"_{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        found.append(new)
    return found


def crc32_of(column: str) -> Column:
    """CRC-32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def binary(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The UTF-8 bytes of a text column, one value at a time; null reads as empty."""
    for value in batch.column(name).cast(pa.large_binary()):
        yield value.as_py() or b""


def give_back() -> None:
    """Return freed memory of a Python worker to the system; workers live for many tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def spans_of(mask_starts, mask_ends) -> list[tuple[int, int]]:
    """Merge sorted half-open spans that touch or overlap."""
    out: list[list[int]] = []
    for a, b in zip(mask_starts, mask_ends):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: Rows up to which a stored helper table is sent to every executor.
SMALL_ROWS = 400_000


def small(df: DataFrame, bound: int = SMALL_ROWS) -> DataFrame:
    """A stored table with few narrow columns, broadcast if it has at most ``bound`` rows;
    beyond that Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= bound else df
