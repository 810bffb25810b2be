"""Merkle manifest of a dataset, with a persistent version per tampered row.

Every row is a leaf. The leaves of a group, in the order of their ids, are hashed in runs
of ``RUN`` nodes until one is left; the groups' roots, ordered by group, are hashed in the
same way to the root of the dataset.

The tree is worked out in aligned blocks of ``RUN ** BLOCK_LEVELS`` nodes: a task hashes
the levels inside its blocks, and only the top of each block goes on, so every pass leaves
a 256th of the rows and a group of any size spreads over many tasks. Going back down, each
block is sent the path above it, the siblings of its top up to the root, as one row.

A tampered leaf makes a version of the tree by path copying: all untouched nodes are
shared with the stored tree, only the ancestors of the leaf are copied. The copies inside
the leaf's block are made from the block's own nodes; the version then continues over the
upper levels with the path its block was sent, in the same task, so versions of one block
never meet in a task of the upper tree.

Defined results: a null field hashes as ``-``, a null group is a group and comes first, a
null id comes before all others and counts as empty where a number is drawn from ids.
Rows that share an id are ordered by their digest; equal rows are equal leaves. A group of
one leaf has that leaf as its root. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paroxys.llm.common import ascii_lower, crc32_of, written

#: Nodes hashed into one parent.
RUN = 16
#: Levels a task works out inside one block.
BLOCK_LEVELS = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value with its length in bytes, ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def _joined(nodes: Sequence[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def _levels(nodes: list[str], size: int) -> list[list[str]]:
    """The levels of a block, its own nodes first; ``size`` counts the nodes of the group."""
    levels = [nodes]
    whole = size <= RUN**BLOCK_LEVELS
    for _ in range(BLOCK_LEVELS):
        if whole and len(levels[-1]) == 1:
            break
        below = levels[-1]
        levels.append([_joined(below[i : i + RUN]) for i in range(0, len(below), RUN)])
    return levels


def _path(levels: list[list[str]], place: int) -> list[tuple[str, str]]:
    """What stands left and right of a node and of its ancestors below the block's top."""
    steps = []
    for nodes in levels[:-1]:
        begin = place - place % RUN
        steps.append(("".join(nodes[begin:place]), "".join(nodes[place + 1 : begin + RUN])))
        place //= RUN
    return steps


def _rows(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _block() -> Column:
    return F.floor(F.col("pos") / F.lit(RUN**BLOCK_LEVELS)).cast("bigint")


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "pos")


def placed(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows``, a stored table with ``key``, with ``pos`` and ``size`` of each key in an order.

    Rows are sorted over ranges of key and order, so a key of any size spreads over
    ranges; a place is the one within the range plus the rows of the ranges before.
    """
    sort = [F.col("key"), *order]
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    stored = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "placed")
    stored = stored.withColumn("_part", F.shiftright("_at", 33))
    by_key = W.partitionBy("key").orderBy("_part")
    # One row per key and range.
    parts = stored.groupBy("key", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = parts.select(
        "key",
        "_part",
        (F.coalesce(F.sum("_n").over(by_key.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(W.partitionBy("key")).alias("size"),
    )
    found = stored.join(starts, ["key", "_part"])
    return written(found.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift"), "leaves")


def _up(nodes: DataFrame) -> DataFrame:
    """The tops of the blocks of ``(key, pos, size, digest)``, as nodes of the next pass."""
    schema = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("digest", pa.binary())])
    block = RUN**BLOCK_LEVELS

    def hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tops() -> Iterator[tuple]:
            rows = _rows(batches, ("key", "block", "size", "digest"))
            for (key, at), group in groupby(rows, lambda r: r[:2]):
                own = list(group)
                size = own[0][2]
                top = _levels([r[3].hex() for r in own], size)[-1][0]
                yield key, at, -(-size // block), bytes.fromhex(top)

        yield from _batches(tops(), schema)

    rows = _by_block(nodes.select("key", _block().alias("block"), "pos", "size", "digest"))
    return rows.mapInArrow(hash_blocks, "key string, pos bigint, size bigint, digest binary")


def _passes(nodes: DataFrame) -> list[DataFrame]:
    """Tables of nodes, pass by pass, until every key has one node."""
    tables = [nodes]
    left = nodes.agg(F.max("size")).first()[0] or 0
    while left > 1:
        tables.append(written(_up(tables[-1]), "nodes"))
        left = -(-left // RUN**BLOCK_LEVELS)
    return tables


def _with_paths(nodes: DataFrame, paths: DataFrame, extra: Sequence[str]) -> DataFrame:
    """The nodes of each block after one row with the path above it and its group's root."""
    own = nodes.select(
        "key", _block().alias("block"), "pos", "size", "digest", *extra,
        F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("top"),
    )
    kinds = {f.name: f.dataType for f in nodes.schema.fields}
    above = paths.select(
        "key", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"),
        F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("binary").alias("digest"),
        *[F.lit(None).cast(kinds[c]).alias(c) for c in extra], "path", "top",
    )
    return _by_block(own.unionAll(above))


def _down(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """``(key, pos, path, top)`` of every node, from the paths of the blocks' tops."""
    schema = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("path", _STEPS), ("top", pa.string())])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            rows = _rows(batches, ("key", "block", "pos", "size", "digest", "path", "top"))
            for (key, _), group in groupby(rows, lambda r: r[:2]):
                above, *own = group
                levels = _levels([r[4].hex() for r in own], own[0][3])
                upper = [(s["left"], s["right"]) for s in above[5]]
                for place, r in enumerate(own):
                    steps = [*_path(levels, place), *upper]
                    yield key, r[2], [{"left": a, "right": b} for a, b in steps], above[6]

        yield from _batches(found(), schema, 64)

    return _with_paths(nodes, paths, ()).mapInArrow(extend, f"key string, pos bigint, path {PATH}, top string")


def _descend(tables: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths of the nodes of the first pass's blocks, from those of the last pass's nodes."""
    for nodes in reversed(tables[1:-1]):
        paths = written(_down(nodes, paths), "paths")
    return paths


class Manifest:
    """The stored tree of a table.

    ``leaves``: ``(key, pos, size, id, digest, changed)``, ``changed`` the digest of a
    tampered leaf; ``groups``: ``(key, pos, size, digest)`` of the groups' roots; ``root``.
    """

    def __init__(self, leaves: DataFrame, tables: list[DataFrame], groups: DataFrame, upper: list[DataFrame]) -> None:
        self.leaves, self.tables, self.groups, self.upper = leaves, tables, groups, upper
        top = upper[-1].select("digest").first()
        self.root: str | None = top[0].hex() if top else None

    def paths(self) -> DataFrame:
        """Path from every block of leaves to the root: ``(key, pos, path, top)``."""
        start = self.upper[-1].select(
            "key", "pos", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("top")
        )
        # The groups' own paths, then those of the blocks inside the groups.
        to_root = _down(self.upper[0], _descend(self.upper, start)) if len(self.upper) > 1 else start
        named = self.groups.select(F.col("name").alias("key"), F.col("pos").alias("_pos"), "digest")
        groups = written(
            named.join(to_root.select(F.col("pos").alias("_pos"), "path"), "_pos").select(
                "key", F.lit(0).cast("bigint").alias("pos"), "path", F.lower(F.hex("digest")).alias("top")
            ),
            "group-paths",
        )
        return _descend(self.tables, groups)

    def verified(self) -> DataFrame:
        """Each leaf with its proof and, if it was tampered with, its version of the tree.

        ``(id, key, pos, leaf, subroot, root, proof_sha256, copies, folded_root,
        verified)``; ``copies`` are the digests of the nodes the version copied, from
        the leaf to the root, and null for untouched leaves.
        """
        schema = pa.schema(
            [
                ("id", self.leaves.select("id").limit(0).toArrow().schema.field("id").type),
                *[("key", pa.string()), ("pos", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string())],
                *[("proof_sha256", pa.string()), ("copies", pa.list_(pa.string())), ("folded_root", pa.string())],
            ]
        )

        def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def found() -> Iterator[tuple]:
                names = ("key", "block", "pos", "size", "digest", "path", "top", "id", "changed")
                for (key, _), group in groupby(_rows(batches, names), lambda r: r[:2]):
                    above, *own = group
                    levels = _levels([r[4].hex() for r in own], own[0][3])
                    upper = [(s["left"], s["right"]) for s in above[5]]
                    rest = "".join(a + b for a, b in upper).encode()
                    folded = levels[-1][0]
                    for a, b in upper:
                        folded = _joined((a, folded, b))
                    for place, r in enumerate(own):
                        steps = _path(levels, place)
                        proof = sha256("".join(a + b for a, b in steps).encode())
                        proof.update(rest)
                        copies = None
                        if r[8] is not None:
                            copies = [r[8].hex()]
                            for a, b in (*steps, *upper):
                                copies.append(_joined((a, copies[-1], b)))
                        leaf, end = r[4].hex(), copies[-1] if copies else folded
                        yield r[7], key, r[2], leaf, above[6], proof.hexdigest(), copies, end

            yield from _batches(found(), schema, 512)

        kind = self.leaves.schema["id"].dataType.simpleString()
        rows = _with_paths(self.leaves, self.paths(), ("id", "changed")).mapInArrow(
            prove,
            f"id {kind}, key string, pos bigint, leaf string, subroot string, proof_sha256 string, "
            "copies array<string>, folded_root string",
        )
        root = F.lit(self.root).cast("string")
        return rows.withColumn("root", root).withColumn("verified", F.col("folded_root") == root)

    def versions(self) -> DataFrame:
        """The nodes each version copied: ``(id, key, pos, level, digest)``; level 0 is the leaf."""
        rows = self.verified().where(F.col("copies").isNotNull())
        return rows.select("id", "key", "pos", F.posexplode("copies").alias("level", "digest"))


def build(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    group: str = "source",
    order: str = "doc_id",
    tampered: Column | None = None,
    changes: Mapping[str, Column] | None = None,
) -> Manifest:
    """Hash every row's ``fields`` and build the tree of all rows.

    Where ``tampered`` is true, a second digest is taken with ``changes`` in place of the
    named fields.
    """
    changes = dict(changes or {})
    touched = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    changed = row_digest([changes.get(c, F.col(c)) for c in fields])
    name = F.col(group).cast("string")
    rows = docs.select(
        F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), name)).alias("key"),
        F.col(order).alias("id"),
        row_digest([F.col(c) for c in fields]).alias("digest"),
        F.when(touched, changed).alias("changed"),
    )
    leaves = placed(written(rows, "rows"), [F.col("id").asc_nulls_first(), F.col("digest")])
    tables = _passes(leaves.select("key", "pos", "size", "digest"))
    names = tables[-1].select(F.lit("").alias("key"), F.col("key").alias("name"), "digest")
    groups = placed(written(names, "group-roots"), [F.col("name")])
    return Manifest(leaves, tables, groups, _passes(groups.select("key", "pos", "size", "digest")))


def lower_cased(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 5) -> dict:
    """The tampering of the standing check: A-Z of the text in every fifth id, by CRC-32."""
    return {
        "tampered": F.pmod(crc32_of(doc_id), F.lit(every)) == 0,
        "changes": {text: ascii_lower(F.col(text))},
    }


def report(docs: DataFrame) -> DataFrame:
    """One row per document: leaf, roots, proof, and the root its tampered version folds to."""
    rows = build(docs, **lower_cased(docs)).verified()
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )
