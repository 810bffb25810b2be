"""Exact deduplication in two passes with a Bloom filter of repeated hashes.

Pass one turns every normalised text into a 64-bit hash and notes, for each bit of a
blocked filter, whether it was asked for once or more often. Only the bits asked for
more than once remain, so pass two knows which rows can have an equal partner at all.
Those rows shuffle by digest; all others pass straight through. The filter has at most
``MAX_BITS`` bits (32 MB) however large the table is: beyond its comfort more rows
shuffle, and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paroxys.llm.common import SPACE, fresh, written

BITS_PER_ROW = 16
MAX_BITS = 1 << 28
#: Bits of one filter block, and probes a hash makes inside its block.
BLOCK_BITS = 4096
PROBES = 2
#: Blocks that travel together while the filter is built.
GROUP_BLOCKS = 64


def normalised(text: str | Column) -> Column:
    """Every run of white space as one space; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), SPACE, " ")


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks)).cast("bigint")


def _probe(h: Column, k: int) -> Column:
    return F.shiftrightunsigned(h, 64 - 12 * (k + 1)).bitwiseAND(F.lit(BLOCK_BITS - 1))


def repeated_filter(hashes: DataFrame, blocks: int) -> DataFrame:
    """``(block, words)`` of the bits that more than one row asked for.

    ``hashes`` has one column ``h``. Each task sends its own bits, once and more, so a
    hash held by a third of all rows arrives once per task.
    """
    width = GROUP_BLOCKS * BLOCK_BITS

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        h = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
        base = np.mod(h, blocks) * BLOCK_BITS
        u = h.view(np.uint64)
        bits = np.concatenate(
            [
                base + ((u >> np.uint64(64 - 12 * (k + 1))) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)
                for k in range(PROBES)
            ]
        )
        bits, times = np.unique(bits, return_counts=True)
        cuts = np.flatnonzero(np.diff(bits // width)) + 1
        for own, often in zip(np.split(bits, cuts), np.split(times > 1, cuts)):
            if len(own):
                inside = (own % width).astype(np.uint32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": [int(own[0] // width)],
                        "once": [inside.tobytes()],
                        "often": [inside[often].tobytes()],
                    }
                )

    def merge(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        once, often = np.zeros(width, bool), np.zeros(width, bool)
        for a, b in zip(batch["once"], batch["often"]):
            at = np.frombuffer(a, np.uint32)
            often[at] |= once[at]
            once[at] = True
            often[np.frombuffer(b, np.uint32)] = True
        grid = np.packbits(often.reshape(GROUP_BLOCKS, BLOCK_BITS), axis=1, bitorder="little")
        full = np.flatnonzero(grid.any(axis=1))
        return pd.DataFrame(
            {
                "block": full + key[0] * GROUP_BLOCKS,
                # Objects, also where no bit was asked for twice.
                "words": pd.Series([grid[i].view("<i8").tolist() for i in full], dtype=object),
            }
        )

    partial = hashes.mapInArrow(collect, "part bigint, once binary, often binary")
    return partial.groupBy("part").applyInPandas(merge, "block bigint, words array<bigint>")


def digest(text: str | Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _possible(df: DataFrame, sha: str, blocks: DataFrame, n_blocks: int) -> tuple[DataFrame, str]:
    """``df`` with a flag: may the digest occur more than once? Never wrongly false."""
    block, words, flag = fresh(df, "block", "words", "flag")
    h = F.xxhash64(sha)
    looked = df.withColumn(block, _block(h, n_blocks)).join(
        F.broadcast(blocks.select(F.col("block").alias(block), F.col("words").alias(words))),
        block,
        "left",
    )
    bits = [_probe(h, k) for k in range(PROBES)]
    hits = [F.getbit(F.col(words)[F.shiftright(b, 6).cast("int")], b.bitwiseAND(F.lit(63))) == 1 for b in bits]
    both = hits[0]
    for hit in hits[1:]:
        both = both & hit
    return looked.withColumn(flag, F.coalesce(both, F.lit(False))).drop(block, words), flag


def mark_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    bits_per_row: int = BITS_PER_ROW,
    max_bits: int = MAX_BITS,
    whole_rows: bool = True,
) -> tuple[DataFrame, dict[str, str]]:
    """The rows of ``docs`` plus ``sha``, ``size`` and ``keep`` under fresh names.

    Of rows with equal normalised texts the smallest id stays; ``keep`` is that id.
    Null and empty texts are equal to each other. A null id counts as larger than any
    other. Rows that share id and text each count in ``size`` and have the same ``keep``.
    An empty table gives an empty result. With ``whole_rows=False`` only the id and the
    three new columns come back, and the texts are read once.
    """
    sha, size, keep = fresh(docs, "sha", "size", "keep")
    slim = written(docs.select(doc_id, digest(text).alias(sha)), "digests")
    bits = min(max_bits, 1 << max(18, (slim.count() * bits_per_row).bit_length()))
    n_blocks = bits // BLOCK_BITS
    filter_blocks = written(repeated_filter(slim.select(F.xxhash64(sha).alias("h")), n_blocks), "bloom")
    noted, flag = _possible(slim, sha, filter_blocks, n_blocks)
    # Stored, so that the join below has two plain sides and Spark can split hot digests.
    groups = written(
        noted.where(flag).groupBy(sha).agg(F.count("*").alias(size), F.min(doc_id).alias(keep)), "groups"
    )
    rows = noted
    if whole_rows:
        rows, flag = _possible(docs.withColumn(sha, digest(text)), sha, filter_blocks, n_blocks)
    columns = docs.columns if whole_rows else [doc_id]
    alone = rows.where(~F.col(flag)).select(
        *columns, sha, F.lit(1).cast("bigint").alias(size), F.col(doc_id).alias(keep)
    )
    joined = rows.where(flag).join(groups, sha).select(*columns, sha, size, keep)
    return alone.unionAll(joined), {"sha": sha, "size": size, "keep": keep}


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group of equal texts, in the columns of ``docs``.

    Rows that repeat the smallest id of a group are one document listed again; one of
    them stays.
    """
    rows, names = mark_duplicates(docs, doc_id, text, **options)
    kept = rows.where(F.col(doc_id).eqNullSafe(F.col(names["keep"])))
    alone = kept.where(F.col(names["size"]) == 1)
    again = kept.where(F.col(names["size"]) > 1).dropDuplicates([names["sha"]])
    return alone.unionAll(again).select(*docs.columns)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document row: which row of its group stays."""
    rows, names = mark_duplicates(docs, doc_id, text, whole_rows=False, **options)
    return rows.select(
        F.col(doc_id).alias("doc_id"),
        F.col(names["keep"]).alias("keep_id"),
        F.col(names["size"]).alias("group_size"),
        F.col(doc_id).eqNullSafe(F.col(names["keep"])).alias("kept"),
        F.col(names["sha"]).alias("text_sha256"),
    )
