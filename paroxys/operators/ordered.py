"""Ordered work on recordings of any length.

A recording can hold a large share of all rows, so nothing here sends a whole
recording to one task. Rows are keyed by ``(recording, chunk)``; a chunk is a
bounded stretch of the index or of time. Two patterns cover every ordered operator:

* ``with_halo``: a result that looks a fixed number of rows back or ahead. Each
  chunk receives copies of its neighbours' edge rows, then works alone.
* ``running``: a running sum or maximum. Chunk totals are scanned first (one small
  row per chunk), and the total before each chunk is added to its inner scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

CHUNK_ROWS = 1 << 16


def index_chunk(index: str, size: int = CHUNK_ROWS) -> Column:
    return F.floor(F.col(index) / F.lit(size)).cast("bigint")


def time_chunk(seconds: str | Column, length: float) -> Column:
    col = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.floor(col / F.lit(float(length))).cast("bigint")


def with_halo(
    df: DataFrame,
    index: str,
    before: int,
    after: int,
    size: int = CHUNK_ROWS,
    chunk: str = "chunk",
    own: str = "own",
) -> DataFrame:
    """Key rows by chunk and copy edge rows into the neighbouring chunk.

    ``index`` counts rows of a recording from 0 without holes. After the operator's
    own window has run, keep the rows where ``own`` is true.
    """
    if max(before, after) > size:
        raise ValueError(f"halo ({before}, {after}) exceeds the chunk size {size}")
    home = index_chunk(index, size)
    offset = F.col(index) - home * size
    early = (offset < after) & (home > 0)
    late = offset >= size - before
    copies = (
        F.when(early & late, F.array(home, home - 1, home + 1))
        .when(early, F.array(home, home - 1))
        .when(late, F.array(home, home + 1))
        .otherwise(F.array(home))
    )
    return (
        df.withColumn("_home", home)
        .withColumn(chunk, F.explode(copies))
        .withColumn(own, F.col(chunk) == F.col("_home"))
        .drop("_home")
    )


def running(
    df: DataFrame,
    group: Sequence[str],
    chunk: str,
    order: Sequence[str | Column],
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running sums and maxima over each group, in chunk-then-row order.

    Chunks must follow the row order (every row of a chunk sorts before every row of
    the next). Sums start at 0, maxima are null until a non-null value was seen.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    keys = [*group, chunk]
    rows = df.withColumns({f"_in_{name}": col for name, col in {**sums, **maxes}.items()})
    totals = rows.groupBy(*keys).agg(
        *[F.sum(f"_in_{name}").alias(f"_all_{name}") for name in sums],
        *[F.max(f"_in_{name}").alias(f"_all_{name}") for name in maxes],
    )
    earlier = W.partitionBy(*group).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        *[F.sum(f"_all_{name}").over(earlier).alias(f"_pre_{name}") for name in sums],
        *[F.max(f"_all_{name}").over(earlier).alias(f"_pre_{name}") for name in maxes],
    )
    inner = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    zero = F.lit(0)
    results = {
        name: F.coalesce(F.col(f"_pre_{name}"), zero)
        + F.coalesce(F.sum(f"_in_{name}").over(inner), zero)
        for name in sums
    } | {
        name: F.greatest(F.col(f"_pre_{name}"), F.max(f"_in_{name}").over(inner))
        for name in maxes
    }
    helpers = [f"_{kind}_{name}" for kind in ("in", "pre") for name in (*sums, *maxes)]
    return rows.join(carry, keys).withColumns(results).drop(*helpers)


def dense_index(
    df: DataFrame,
    group: Sequence[str],
    chunk: str,
    order: Sequence[str | Column],
    out: str = "i",
) -> DataFrame:
    """Row position within the group, from 0."""
    ranked = running(df, group, chunk, order, sums={out: F.lit(1)})
    return ranked.withColumn(out, (F.col(out) - 1).cast("bigint"))


def ordered_bucket(df: DataFrame, key: str, out: str = "chunk", buckets: int = 1024) -> DataFrame:
    """Cut a sort key into nearly equal ordered ranges; ``df`` comes from a grouping by it.

    The cut points are the ``buckets - 1`` keys with the smallest hashes: a bounded,
    repeatable sample, read as a scalar subquery, so no range holds a fixed share of
    the distinct keys however they cluster. The cuts only place rows; no row is lost.
    """
    cuts = (
        df.select(F.col(key).alias("_cut"))
        .distinct()
        .orderBy(F.xxhash64("_cut"), "_cut")
        .limit(buckets - 1)
        .agg(F.sort_array(F.collect_list("_cut")))
        .scalar()
    )
    # Binary search for the number of cuts at or below the key.
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(buckets - 1, 1).bit_length()))])

    def further(place: Column, step: Column) -> Column:
        return F.when(F.get("_cuts", place + step - 1) <= F.col(key), place + step).otherwise(place)

    found = F.aggregate(steps, F.lit(0), further).cast("bigint")
    return df.withColumn("_cuts", cuts).withColumn(out, found).drop("_cuts")


def chunk_count(df: DataFrame, rows: int = CHUNK_ROWS) -> Column:
    """How many chunks of about ``rows`` rows a table needs, as a scalar subquery."""
    return df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(rows)), F.lit(1)).cast("int")).scalar()


def hashed_bucket(order_key: str | Column, span: int, buckets: int | Column = 1024) -> Column:
    """Ordered range of a key that is spread evenly over ``[0, span)``."""
    col = F.col(order_key) if isinstance(order_key, str) else order_key
    return F.floor(col / F.lit(float(span)) * buckets).cast("bigint")


def map_halo_chunks(
    df: DataFrame,
    group: Sequence[str],
    index: str,
    value: str,
    kernel: Callable[[np.ndarray], np.ndarray],
    out: str,
    chunk: str = "chunk",
    own: str = "own",
) -> DataFrame:
    """Run a whole-array kernel over every chunk of ``with_halo`` and keep the own rows.

    Chunks arrive sorted in Arrow batches and are cut where their key changes. Many short
    recordings share a batch; a chunk that crosses batches is held until it is complete,
    and chunks are bounded.
    """
    keys = [*group, chunk]
    fields = [f for f in df.schema.fields if f.name not in (chunk, own, out)]
    schema = StructType([*fields, StructField(out, DoubleType())])
    names = [f.name for f in fields]

    def starts(table: pa.Table) -> list[int]:
        n = table.num_rows
        moved = np.zeros(n - 1, dtype=bool)
        for key in keys:
            column = table[key]
            unequal = pc.not_equal(column.slice(1), column.slice(0, n - 1))
            moved |= pc.fill_null(unequal, True).to_numpy()
        return [0, *(np.flatnonzero(moved) + 1).tolist()]

    def finish(table: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        values = table[value].to_numpy().astype(np.float64)
        ends = [*cuts[1:], len(values)]
        done = np.concatenate([kernel(values[a:b]) for a, b in zip(cuts, ends)])
        result = table.select(names).append_column(out, pa.array(done))
        if value == out:
            result = table.select([n for n in names if n != out]).append_column(out, pa.array(done))
        yield from result.filter(table[own]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]) if len(held) < 2 else None
            if table is None:
                edge = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch])
                if len(starts(edge)) == 1:
                    held.append(batch)
                    continue
                table = pa.Table.from_batches([*held, batch])
            cuts = starts(table) if table.num_rows > 1 else [0]
            if len(cuts) > 1:
                yield from finish(table.slice(0, cuts[-1]), cuts[:-1])
                held = table.slice(cuts[-1]).combine_chunks().to_batches()
            else:
                held.append(batch)
        if held:
            yield from finish(pa.Table.from_batches(held), [0])

    rows = df.repartition(*keys).sortWithinPartitions(*keys, index)
    return rows.mapInArrow(run, schema)
