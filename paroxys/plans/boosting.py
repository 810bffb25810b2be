"""Boosted trees for all folds of a leave-one-out evaluation at once.

Every fold has its own trees, but all folds grow side by side: a fold is a column of the
work, not a loop around it. The number of jobs follows the depth and number of trees and
is the same for one fold and for fifty.

Features are cut into bins at quantiles of all rows. One job per tree level adds up
gradients by (fold, leaf, feature, bin): tasks send sparse sums of the cells they have
rows in, cells of one block of features meet in one group, and a group answers with its
best split. A leaf of at most ``LOCAL_ROWS`` rows sends its rows instead, and what grows
below it is found in one task by the same rule. The driver sees one row per fold, leaf and
feature block, and keeps the trees. Margins of all folds stand beside the binned rows and are stored anew every
``STORED`` rounds; in between, tasks add the trees grown since.

Up to ``WHOLE_LEAVES * LOCAL_ROWS`` rows a job per level would wait longer than it works: there
one job grows all rounds, a task for each fold, by the rule for small leaves.

Trees grow by level to ``depth``, or by the best leaf to ``leaves``. In the latter case
the splits that might still be chosen are tried level by level too, and the order of
gains decides afterwards, so the result is that of splitting one leaf at a time.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paroxys.session import shared_folder

#: Bins of a feature, features of one block, rounds between stored margins.
BINS = 64
BLOCK = 32
STORED = 16
#: Rows of a leaf that one task splits to the end.
LOCAL_ROWS = 4096
_LOCAL = 0xFFFF
#: Small leaves whose rows a table has at most for its folds to grow all trees in one task each.
WHOLE_LEAVES = 32
#: Bytes of sums a task holds before it sends them on.
HELD_BYTES = 256 << 20
#: Smallest gain that makes a split, and what two gains may differ and still count as equal:
#: sums come together in any order.
MIN_GAIN = 1e-6
EQUAL_GAIN = 1e-10
#: Training rows a task has at least, if there are that many.
TASK_ROWS = 20_000
#: Rows per cell of two features' joint bins from which sums take two features at once, and
#: rows whose sums are taken together below that.
PAIRED = 2
SUMMED = 512
#: Where both sides of a split need at least this weight and no more than a row, weights tell
#: an empty side from others and rows are not counted by bin.
LEAST_WEIGHT = 1e-3


@dataclass(frozen=True)
class Boosting:
    """How trees are grown. ``rows`` and ``columns`` are the shares drawn per tree."""

    rounds: int = 100
    rate: float = 0.1
    depth: int | None = 6
    leaves: int | None = None
    rows: float = 1.0
    columns: float = 1.0
    l2: float = 1.0
    min_weight: float = 1.0
    min_rows: int = 1
    bins: int = BINS
    seed: int = 42


@dataclass
class Node:
    """A node of a growing tree with the sums of its rows."""

    g: float
    h: float
    n: float
    depth: int
    #: (gain, feature, bin, g, h, n of the left side) once looked for; None if no split is worth it.
    best: tuple | None = None
    children: tuple[int, int] | None = None


@dataclass
class Tree:
    """Nodes as arrays: ``feature`` -1 marks a leaf; bins up to ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf(self, columns: np.ndarray) -> np.ndarray:
        """The leaf each row falls into; ``columns`` has a row of bin numbers per feature."""
        at = np.zeros(columns.shape[1], np.int64)
        todo = [(0, np.arange(len(at)))]
        while todo:
            node, rows = todo.pop()
            feature = self.feature[node]
            if feature < 0:
                at[rows] = node
            elif len(rows):
                sides = _sides(rows, columns[feature].take(rows) > self.cut[node])
                todo += zip((self.left[node], self.right[node]), sides)
        return at


def _sides(rows: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that go left and those that go right."""
    return rows.take(np.flatnonzero(~right)), rows.take(np.flatnonzero(right))


def _paired(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Gradient and curvature as one complex number."""
    values = np.empty(len(g), complex)
    values.real, values.imag = g, h
    return values


@dataclass
class Bins:
    """Bin numbers of rows, and sums over them. ``by_row`` has a row per row, a column per feature."""

    by_row: np.ndarray
    number: int

    @cached_property
    def columns(self) -> np.ndarray:
        return np.ascontiguousarray(self.by_row.T)

    def sums(self, rows: np.ndarray, values: np.ndarray, features: np.ndarray, counted: bool) -> np.ndarray:
        """Gradient, curvature and, if ``counted``, rows by feature and bin, for some rows.

        ``values`` are gradient and curvature of all rows as one complex number: one pass adds up
        both. Many rows are summed over the joint bins of two features, which the sums of each follow from.
        """
        own = values if len(rows) == len(values) else values.take(rows)
        if len(rows) < PAIRED * self.number**2:
            total, counts = self._few(rows, own, features, counted)
        else:
            total, counts = self._many(rows, own, features, counted)
        return np.stack([total.real, total.imag, counts] if counted else [total.real, total.imag])

    def _few(self, rows, own, features, counted):
        shape, offsets = (len(features), self.number), np.arange(len(features)) * self.number
        total, counts = np.zeros(shape, complex), np.zeros(shape)
        for begin in range(0, len(rows), SUMMED):
            part = slice(begin, begin + SUMMED)
            cells = (self.by_row.take(rows[part], axis=0).take(features, axis=1) + offsets).ravel()
            np.add.at(total.reshape(-1), cells, np.repeat(own[part], len(features)))
            if counted:
                counts += np.bincount(cells, minlength=counts.size).reshape(shape)
        return total, counts

    def _many(self, rows, own, features, counted):
        shape, square = (len(features), self.number), (self.number, self.number)
        total, counts = np.zeros(shape, complex), np.zeros(shape)
        whole = len(rows) == self.columns.shape[1]
        for at in range(0, len(features), 2):
            first, *second = [self.columns[f] if whole else self.columns[f].take(rows) for f in features[at : at + 2]]
            cells = first * np.int64(self.number)
            if second:
                cells += second[0]
            joint = np.zeros(square, complex)
            np.add.at(joint.reshape(-1), cells, own)
            parts = [(total, joint)]
            if counted:
                parts.append((counts, np.bincount(cells, minlength=joint.size).reshape(square)))
            for out, sums in parts:
                sums.sum(axis=1, out=out[at], dtype=out.dtype)
                if second:
                    sums.sum(axis=0, out=out[at + 1], dtype=out.dtype)
        return total, counts


def _tree(nodes: Sequence[Node], split: set[int], params: Boosting) -> Tree:
    """The tree in which exactly the nodes of ``split`` are split."""
    n = len(nodes)
    out = Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n))
    for i, node in enumerate(nodes):
        out.value[i] = -params.rate * node.g / (node.h + params.l2) if node.h + params.l2 > 0 else 0.0
        if i in split:
            _, out.feature[i], out.cut[i] = node.best[:3]
            out.left[i], out.right[i] = node.children
    return out


#: The tree of a fold without training rows.
_EMPTY = _tree([Node(0.0, 0.0, 0.0, 0)], set(), Boosting())


@dataclass
class Growing:
    """One fold's tree while it grows."""

    params: Boosting
    nodes: list[Node] = field(default_factory=list)

    def can_split(self, node: Node) -> bool:
        p = self.params
        return (
            (p.depth is None or node.depth < p.depth)
            and node.n >= 2 * p.min_rows
            and node.h >= 2 * p.min_weight
        )

    def chosen(self) -> tuple[set[int], list[int]]:
        """The splits of the final tree as far as known, and worthy nodes not yet split."""
        open_ = [i for i, node in enumerate(self.nodes) if node.best and not node.children]
        if self.params.leaves is None:
            return {i for i, node in enumerate(self.nodes) if node.children}, open_
        # The best leaf first, an earlier node before a later one of equal gain.
        split: set[int] = set()
        queue = [(-self.nodes[0].best[0], 0)] if self.nodes and self.nodes[0].best else []
        blocked = False
        while queue and len(split) < self.params.leaves - 1:
            _, i = heapq.heappop(queue)
            if not self.nodes[i].children:
                blocked = True
                break
            split.add(i)
            for child in self.nodes[i].children:
                if self.nodes[child].best:
                    heapq.heappush(queue, (-self.nodes[child].best[0], child))
        if not blocked:
            return split, []
        left = self.params.leaves - 1 - len(split)
        open_.sort(key=lambda i: (-self.nodes[i].best[0], i))
        return split, open_[:left]

    def expand(self) -> list[int]:
        """Split the open nodes; the new nodes whose own split has to be looked for."""
        fresh = []
        for i in self.chosen()[1]:
            node = self.nodes[i]
            _, _, _, g, h, n = node.best
            node.children = (len(self.nodes), len(self.nodes) + 1)
            for own in ((g, h, n), (node.g - g, node.h - h, node.n - n)):
                self.nodes.append(Node(*own, node.depth + 1))
            fresh += [c for c in node.children if self.can_split(self.nodes[c])]
        return fresh

    def speculative(self) -> Tree:
        return _tree(self.nodes, {i for i, node in enumerate(self.nodes) if node.children}, self.params)

    def final(self) -> Tree:
        return _tree(self.nodes, self.chosen()[0], self.params)


def drawn(hashes: np.ndarray, share: float, number: int) -> np.ndarray:
    """A repeatable share of the rows, by their hash and the number of the draw."""
    if share >= 1:
        return np.ones(len(hashes), bool)
    z = hashes.view(np.uint64) + np.uint64(((number + 1) * 0x9E3779B97F4A7C15) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def quantile_cuts(features: DataFrame, bins: int = BINS, x: str = "features") -> np.ndarray:
    """Upper ends of all bins but the last, one row per feature.

    Quantiles of all rows, as one row per feature; equal cuts leave bins between them empty.
    """
    shares = [k / bins for k in range(1, bins)]
    points = features.select(F.posexplode(F.col(x).cast("array<double>")).alias("place", "v"))
    found = points.groupBy("place").agg(
        F.percentile_approx("v", F.array(*[F.lit(s) for s in shares]), 10_000).alias("cuts")
    )
    return np.array([r["cuts"] for r in found.orderBy("place").collect()]).reshape(-1, bins - 1)


def binned(features: DataFrame, cuts: np.ndarray, folds: Sequence, key: str, subject: str, label: str, x: str) -> DataFrame:
    """``(key, label, fold, hash, bins, margins)``: ``fold`` is the place of the row's subject
    in ``folds``, -1 if it is none of them; one margin per fold, all zero."""
    spark = features.sparkSession
    kind = features.schema[subject].dataType.simpleString()
    numbers = spark.createDataFrame([(f, i) for i, f in enumerate(folds)], f"_subject {kind}, fold int")
    named = features.select(
        F.col(key).alias("key"),
        F.col(label).cast("int").alias("y"),
        F.col(subject).alias("_own"),
        F.xxhash64(key).alias("hash"),
        F.col(x).cast("array<double>").alias("x"),
    )
    rows = named.join(F.broadcast(numbers), F.col("_own").eqNullSafe(F.col("_subject")), "left").select(
        "key",
        "y",
        F.coalesce("fold", F.lit(-1)).alias("fold"),
        "hash",
        "x",
        F.array_repeat(F.lit(0.0), len(folds)).alias("margins"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            places = np.empty(values.shape, np.uint8)
            for j in range(values.shape[1]):
                places[:, j] = np.searchsorted(cuts[j], values[:, j], side="left")
            blobs = pa.array([row.tobytes() for row in places], pa.binary())
            keep = [batch.column(c) for c in ("key", "y", "fold", "hash")]
            yield pa.RecordBatch.from_arrays(
                [*keep, blobs, batch.column("margins")], ["key", "y", "fold", "hash", "bins", "margins"]
            )

    kind = features.schema[key].dataType.simpleString()
    return rows.mapInArrow(cut, f"key {kind}, y int, fold int, hash bigint, bins binary, margins array<double>")


def _unpacked(batch: pa.RecordBatch, n_features: int, n_folds: int) -> tuple[np.ndarray, np.ndarray]:
    blobs = batch.column("bins")
    joined = b"".join(blobs.to_pylist())
    bins = np.frombuffer(joined, np.uint8).reshape(batch.num_rows, n_features)
    margins = batch.column("margins").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_folds)
    return bins, margins


def _moved(margins: np.ndarray, fold: int, columns: np.ndarray, pending: Sequence[Sequence[Tree]]) -> np.ndarray:
    """One fold's margins with the trees grown since they were stored."""
    out = margins[:, fold].copy()
    for trees in pending:
        out += trees[fold].value[trees[fold].leaf(columns)]
    return out


_PARTIAL = "cell_key bigint, cells binary, sums binary"
_SPLIT = (
    "cell_key bigint, place int, child int, gain double, feature int, bin int, "
    "gl double, hl double, nl double, g double, h double, n double"
)
#: Columns of ``_SPLIT`` after the key.
_SPLIT_NAMES = tuple(c.split()[0] for c in _SPLIT.split(", "))[1:]


def best_split(total: np.ndarray, params: Boosting) -> tuple:
    """``(gain, feature, bin, g, h, n of the left side, g, h, n of all)`` of sums by feature
    and bin. The largest gain wins, among equal ones the first feature, then the lowest cut.
    Where rows are not counted, all features hold the same rows and both ``n`` are 0."""
    g, h, *counts = np.cumsum(total, axis=2)
    # All features hold the same rows, but for those not drawn.
    some = int(np.argmax(counts[0][:, -1] > 0)) if counts else 0
    all_g, all_h = g[some, -1], h[some, -1]
    gl, hl = g[:, :-1], h[:, :-1]
    sound = (hl >= params.min_weight) & (all_h - hl >= params.min_weight)
    if counts:
        n, all_n = counts[0], counts[0][some, -1]
        nl = n[:, :-1]
        sound &= (nl >= params.min_rows) & (all_n - nl >= params.min_rows) & (n[:, -1:] > 0)
    l2 = params.l2
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl / (hl + l2) + (all_g - gl) * (all_g - gl) / (all_h - hl + l2) - all_g * all_g / (all_h + l2)
    gain = np.where(sound, gain, -np.inf)
    top = gain.max()
    near = gain >= top - EQUAL_GAIN * max(abs(top), 1.0) if np.isfinite(top) else gain == top
    f, b = np.unravel_index(int(np.argmax(near)), gain.shape)
    left = nl[f, b] if counts else 0.0
    return float(gain[f, b]), int(f), int(b), gl[f, b], hl[f, b], left, all_g, all_h, all_n if counts else 0.0


def grow_leaf(
    bins: Bins, every: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, columns: np.ndarray, params: Boosting
) -> list[tuple]:
    """All that grows below one leaf with the rows ``every``, as rows of ``_SPLIT`` without their
    key; ``g`` and ``h`` go with all rows of ``bins``.

    With a limit of leaves, the leaf's own best splits up to that limit: no more of them
    can be among the best of the whole tree.
    """
    values = _paired(g, h)
    counted = params.min_rows > 1 or params.min_weight < LEAST_WEIGHT
    tree = Growing(params)
    found: list[tuple] = []
    queue: list[tuple] = []
    #: Rows of both sides and sums of the nodes that may still be split; a node's larger side is
    #: what its smaller one leaves.
    open_nodes: dict[int, tuple] = {}

    def look(rows: np.ndarray, total: np.ndarray | None, node: Node) -> None:
        place = len(found)
        tree.nodes.append(node)
        if total is None:
            found.append((-1, -np.inf, -1, -1, 0.0, 0.0, 0.0, node.g, node.h, node.n))
            return
        gain, feature, cut, gl, hl, _, all_g, all_h, _ = best_split(total, params)
        feature, left = int(columns[feature]), 0.0
        if gain > MIN_GAIN:
            sides = _sides(rows, bins.columns[feature].take(rows) > cut)
            left = float(len(sides[0]))
            open_nodes[place] = (sides, total)
            heapq.heappush(queue, (-gain, place))
        else:
            gain = -np.inf
        found.append((-1, gain, feature, cut, gl, hl, left, all_g, all_h, node.n))

    def node_of(rows: np.ndarray, at_depth: int) -> Node:
        return Node(float(g[rows].sum()), float(h[rows].sum()), float(len(rows)), at_depth)

    root = node_of(every, depth)
    look(every, bins.sums(every, values, columns, counted) if tree.can_split(root) else None, root)
    splits = 0
    while queue and (params.leaves is None or splits < params.leaves - 1):
        _, place = heapq.heappop(queue)
        sides, total = open_nodes.pop(place)
        found[place] = (len(found), *found[place][1:])
        splits += 1
        below = tree.nodes[place].depth + 1
        nodes = [node_of(side, below) for side in sides]
        open_ = [tree.can_split(node) for node in nodes]
        totals: list[np.ndarray | None] = [None, None]
        if any(open_):
            less = int(len(sides[1]) < len(sides[0]))
            totals[less] = bins.sums(sides[less], values, columns, counted)
            totals[1 - less] = total - totals[less]
        for side, node, own, may in zip(sides, nodes, totals, open_):
            look(side, own if may else None, node)
    return [(place, *row) for place, row in enumerate(found)]


@dataclass
class Level:
    """What one job looks for: the trees so far, and per fold the leaves to be split, by slot."""

    trees: list[Tree]
    slots: list[dict[int, int]]
    #: Depth of the leaf of each slot, and whether its rows go to one task.
    depths: list[list[int]]
    local: list[list[bool]]
    columns: list[np.ndarray]
    round_: int


def _sums(
    rows: DataFrame,
    params: Boosting,
    n_features: int,
    weights: Sequence[tuple[float, float]],
    pending: Sequence[Sequence[Tree]],
    level: Level,
) -> DataFrame:
    """Sparse sums of gradient, curvature and rows by (fold, leaf, feature block), or the
    rows themselves of small leaves."""
    n_folds, bins_n = len(weights), params.bins
    width = n_features * bins_n

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def batch_of(parts: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.binary(), pa.binary())
            columns = list(zip(*parts)) or [[], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["cell_key", "cells", "sums"]
            )

        def send() -> pa.RecordBatch:
            parts = []
            for (fold, slot), total in held.items():
                for block, begin in enumerate(range(0, width, BLOCK * bins_n)):
                    part = total[:, begin : begin + BLOCK * bins_n]
                    used = np.flatnonzero(part[2])
                    if len(used):
                        key = fold << 40 | slot << 16 | block
                        parts.append((key, used.astype(np.int32).tobytes(), part[:, used].tobytes()))
            held.clear()
            return batch_of(parts)

        for batch in batches:
            bins, margins = _unpacked(batch, n_features, n_folds)
            own = batch.column("fold").to_numpy()
            y = batch.column("y").to_numpy()
            hashes = batch.column("hash").to_numpy()
            every = Bins(bins, bins_n)
            for fold in range(n_folds):
                if not level.slots[fold]:
                    continue
                tree = level.trees[fold]
                use = np.flatnonzero((own != fold) & drawn(hashes, params.rows, level.round_ * n_folds + fold))
                slot_of = np.full(len(tree.feature), -1)
                slot_of[list(level.slots[fold])] = list(level.slots[fold].values())
                slot = slot_of[tree.leaf(every.columns)[use]]
                use, slot = use[slot >= 0], slot[slot >= 0]
                mine = bins[use]
                chance = 1 / (1 + np.exp(-_moved(margins, fold, every.columns, pending)[use]))
                weight = np.where(y[use] == 1, weights[fold][1], weights[fold][0])
                g, h = weight * (chance - y[use]), weight * chance * (1 - chance)
                columns = level.columns[fold]
                cells, values = Bins(mine, bins_n), _paired(g, h)
                small = []
                for s in np.unique(slot):
                    at = slot == s
                    if level.local[fold][s]:
                        key = fold << 40 | int(s) << 16 | _LOCAL
                        small.append((key, mine[at].tobytes(), np.stack([g[at], h[at]]).tobytes()))
                        continue
                    total = held.setdefault((fold, int(s)), np.zeros((3, width))).reshape(3, n_features, bins_n)
                    total[:, columns] += cells.sums(np.flatnonzero(at), values, columns, True)
                if small:
                    yield batch_of(small)
                if len(held) * width * 24 > HELD_BYTES:
                    yield send()
        if held:
            yield send()

    return rows.mapInArrow(add, _PARTIAL)


def _best(partial: DataFrame, params: Boosting, n_features: int, level: Level) -> DataFrame:
    """The best split of every (fold, leaf, feature block), and the leaf's own sums; for a
    small leaf all splits below it, one row per node."""

    def block_rows(key: int, parts: list[tuple[bytes, bytes]]) -> Iterator[tuple]:
        block = key & 0xFFFF
        if block == _LOCAL:
            fold, slot = key >> 40, (key >> 16) & 0xFFFFFF
            bins = np.frombuffer(b"".join(p[0] for p in parts), np.uint8).reshape(-1, n_features)
            g, h = np.concatenate([np.frombuffer(p[1]).reshape(2, -1) for p in parts], axis=1)
            depth, leaf = level.depths[fold][slot], Bins(bins, params.bins)
            for row in grow_leaf(leaf, np.arange(len(g)), g, h, depth, level.columns[fold], params):
                yield key, *row
            return
        size = min(BLOCK, n_features - block * BLOCK)
        total = np.zeros((3, size * params.bins))
        for cells, sums in parts:
            total[:, np.frombuffer(cells, np.int32)] += np.frombuffer(sums).reshape(3, -1)
        gain, feature, *rest = best_split(total.reshape(3, size, params.bins), params)
        yield key, 0, -1, gain, feature + block * BLOCK, *rest

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns]))
        found = [
            row
            for key, group in groupby(parts, lambda r: r[0])
            for row in block_rows(key, [r[1:] for r in group])
        ]
        arrow = {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}
        names, kinds = zip(*[c.split() for c in _SPLIT.split(", ")])
        columns = list(zip(*found)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(columns, kinds)], list(names))

    return partial.repartition("cell_key").sortWithinPartitions("cell_key").mapInArrow(find, _SPLIT)


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _with_trees(rows: DataFrame, pending: Sequence[Sequence[Tree]], n_features: int, n_folds: int) -> DataFrame:
    """The rows with the pending trees added to their margins."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, margins = _unpacked(batch, n_features, n_folds)
            columns = np.ascontiguousarray(bins.T)
            new = np.stack([_moved(margins, f, columns, pending) for f in range(n_folds)], axis=1)
            ends = np.arange(0, new.size + 1, n_folds, dtype=np.int32)
            keep = [batch.column(c) for c in ("key", "y", "fold", "hash", "bins")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.ListArray.from_arrays(pa.array(ends), pa.array(new.ravel()))],
                ["key", "y", "fold", "hash", "bins", "margins"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(move, f"key {kind}, y int, fold int, hash bigint, bins binary, margins array<double>")


def _attach(tree: Growing, place: int, rows: list) -> None:
    """Note a leaf's best split, or all that was grown below a small leaf."""
    rows.sort(key=lambda r: r["place"])
    if len(rows) > 1 and rows[1]["place"] == 0:  # one row per feature block
        top = max(r["gain"] for r in rows)
        near = [r for r in rows if r["gain"] >= top - EQUAL_GAIN * max(abs(top), 1.0)]
        rows = [min(near or rows, key=lambda r: r["feature"])]
    numbers = {0: place}
    for r in rows:
        node = tree.nodes[numbers[r["place"]]]
        node.g, node.h, node.n = r["g"], r["h"], r["n"]
        if r["gain"] > MIN_GAIN:
            node.best = (r["gain"], r["feature"], r["bin"], r["gl"], r["hl"], r["nl"])
        if r["child"] >= 0:
            at = len(tree.nodes)
            node.children = (at, at + 1)
            numbers |= {r["child"]: at, r["child"] + 1: at + 1}
            tree.nodes += [Node(0.0, 0.0, 0.0, node.depth + 1) for _ in range(2)]


def _drawn_columns(params: Boosting, n_features: int, n_folds: int, round_: int) -> list[np.ndarray]:
    """The features that each fold's tree of a round may use."""
    rng = np.random.default_rng((params.seed, round_))
    number = max(1, round(params.columns * n_features))
    return [np.sort(rng.permutation(n_features)[:number]) for _ in range(n_folds)]


def grow_folds(
    rows: DataFrame, params: Boosting, n_features: int, weights: Sequence[tuple[float, float]]
) -> list[list[Tree]]:
    """The trees of every round, one per fold, in one job: each fold's rows meet in one task."""
    n_folds = len(weights)
    parts = ("feature", "cut", "left", "right", "value")

    def trees(fold: int, batches: list[pa.RecordBatch]) -> Iterator[Tree]:
        joined = b"".join(blob for batch in batches for blob in batch.column("bins").to_pylist())
        bins = Bins(np.frombuffer(joined, np.uint8).reshape(-1, n_features), params.bins)
        y, hashes = (np.concatenate([batch.column(c).to_numpy() for batch in batches]) for c in ("y", "hash"))
        weight = np.where(y == 1, weights[fold][1], weights[fold][0])
        margin = np.zeros(len(y))
        for round_ in range(params.rounds):
            use = np.flatnonzero(drawn(hashes, params.rows, round_ * n_folds + fold))
            growing = Growing(params, [Node(0.0, 0.0, float(len(use)), 0)])
            if len(use):
                chance = 1 / (1 + np.exp(-margin))
                g, h = weight * (chance - y), weight * chance * (1 - chance)
                columns = _drawn_columns(params, n_features, n_folds, round_)[fold]
                found = grow_leaf(bins, use, g, h, 0, columns, params)
                _attach(growing, 0, [dict(zip(_SPLIT_NAMES, row)) for row in found])
            tree = growing.final()
            margin += tree.value[tree.leaf(bins.columns)]
            yield tree

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, own in groupby(_by_task(batches), lambda part: part[0]):
            grown = list(trees(fold, [batch for _, batch in own]))
            blobs = [pa.array([getattr(tree, name).tobytes() for tree in grown], pa.binary()) for name in parts]
            place = [pa.array([fold] * len(grown), pa.int32()), pa.array(range(len(grown)), pa.int32())]
            yield pa.RecordBatch.from_arrays([*place, *blobs], ["task", "round", *parts])

    # Ranges in plenty, so that no two folds share a task; rows in one order, so that sums repeat.
    dealt = rows.select("fold", "y", "hash", "bins", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("task"))
    dealt = dealt.where("fold <> task").repartitionByRange(4 * n_folds, "task").sortWithinPartitions("task", "hash", "bins", "y")
    grown = [[_EMPTY] * n_folds for _ in range(params.rounds)]
    kinds = "task int, round int, " + ", ".join(f"{name} binary" for name in parts)
    for r in dealt.select("task", "y", "hash", "bins").mapInArrow(grow, kinds).collect():
        arrays = [np.frombuffer(r[name], np.float64 if name == "value" else np.int64) for name in parts]
        grown[r["round"]][r["task"]] = Tree(*arrays)
    return grown


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches sorted by ``task``, cut where it changes."""
    for batch in batches:
        task = batch.column("task").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
        for begin, end in zip(cuts, cuts[1:]):
            if end > begin:
                yield int(task[begin]), batch.slice(begin, end - begin)


def grow_round(
    rows: DataFrame,
    params: Boosting,
    n_rows: int,
    n_features: int,
    weights: Sequence[tuple[float, float]],
    pending: Sequence[Sequence[Tree]],
    round_: int,
) -> list[Growing]:
    """One tree per fold: a job per level, until no fold has a leaf left to look at."""
    n_folds = len(weights)
    columns = _drawn_columns(params, n_features, n_folds, round_)
    growing = [Growing(params, [Node(0.0, 0.0, float(n_rows), 0)]) for _ in range(n_folds)]
    todo = [[0] for _ in range(n_folds)]
    while any(todo):
        nodes = [[g.nodes[i] for i in places] for g, places in zip(growing, todo)]
        level = Level(
            [g.speculative() for g in growing],
            [{place: s for s, place in enumerate(places)} for places in todo],
            [[node.depth for node in own] for own in nodes],
            [[node.n <= LOCAL_ROWS for node in own] for own in nodes],
            columns,
            round_,
        )
        partial = _sums(rows, params, n_features, weights, pending, level)
        answers = defaultdict(list)
        # One row per fold, leaf and feature block, or per node below a small leaf.
        for r in _best(partial, params, n_features, level).collect():
            answers[r["cell_key"] >> 16].append(r)
        for key, found in answers.items():
            _attach(growing[key >> 24], todo[key >> 24][key & 0xFFFFFF], found)
        todo = [g.expand() for g in growing]
    return growing


def boost(
    features: DataFrame,
    folds: Sequence,
    weights: Sequence[tuple[float, float]],
    params: Boosting,
    key: str = "window_id",
    subject: str = "subject",
    label: str = "y",
    x: str = "features",
) -> tuple[DataFrame, list[list[Tree]], np.ndarray]:
    """Margins of all rows in all folds, the trees of every round, and the cuts.

    The trees of fold ``i`` are grown without the rows whose subject is ``folds[i]``, with
    ``weights[i]`` for the two classes. Rows of other subjects than ``folds`` train every
    fold. Every row needs vectors of one length without missing numbers.
    """
    cuts = quantile_cuts(features, params.bins, x)
    n_features, n_folds = len(cuts), len(folds)
    table = binned(features, cuts, folds, key, subject, label, x)
    n_rows = features.count()
    rows = _stored(table.coalesce(-(-n_rows // TASK_ROWS) or 1), "boosting").persist()
    if n_rows <= WHOLE_LEAVES * LOCAL_ROWS:
        grown = grow_folds(rows, params, n_features, weights) if folds else [[] for _ in range(params.rounds)]
        result = _stored(_with_trees(rows, grown, n_features, n_folds), "boosting")
        rows.unpersist()
        return result, grown, cuts
    grown: list[list[Tree]] = []
    pending: list[list[Tree]] = []
    for round_ in range(params.rounds):
        trees = [g.final() for g in grow_round(rows, params, n_rows, n_features, weights, pending, round_)]
        grown.append(trees)
        pending.append(trees)
        if len(pending) == STORED:
            moved = _stored(_with_trees(rows, pending, n_features, n_folds), "boosting").persist()
            rows.unpersist()
            rows, pending = moved, []
    result = _stored(_with_trees(rows, pending, n_features, n_folds), "boosting")
    rows.unpersist()
    return result, grown, cuts


def held_out_scores(margins: DataFrame, folds: Sequence, fold_type: str = "int", key: str = "window_id") -> DataFrame:
    """``(fold, key, y, prob, pred)`` of the rows that a fold held out."""
    spark = margins.sparkSession
    names = spark.createDataFrame([(i, f) for i, f in enumerate(folds)], f"_place int, _name {fold_type}")
    prob = 1 / (1 + F.exp(-F.get("margins", F.col("fold"))))
    rows = margins.where("fold >= 0").withColumn("prob", prob).join(F.broadcast(names), F.col("fold") == F.col("_place"))
    return rows.select(
        F.col("_name").alias("fold"),
        F.col("key").alias(key),
        "y",
        "prob",
        (F.col("prob") >= 0.5).cast("int").alias("pred"),
    )


def first_splits(
    features: DataFrame, folds: Sequence, weights: Sequence[tuple[float, float]], params: Boosting, **names
) -> DataFrame:
    """The splits of the first tree of every fold: where it cuts, what it gains, what goes left.

    Nodes are numbered as in a heap, the root is 1.
    """
    x = names.get("x", "features")
    cuts = quantile_cuts(features, params.bins, x)
    table = binned(
        features, cuts, folds, names.get("key", "window_id"), names.get("subject", "subject"), names.get("label", "y"), x
    )
    out = []
    rows = _stored(table, "boosting")
    for fold, tree in zip(folds, grow_round(rows, params, rows.count(), len(cuts), weights, [], 0)):
        number = {0: 1}
        for i, node in enumerate(tree.nodes):
            if node.children:
                number |= {node.children[0]: 2 * number[i], node.children[1]: 2 * number[i] + 1}
                gain, feature, cut, _, _, left = node.best
                out.append((fold, number[i], feature, float(cuts[feature][cut]), gain, int(left), int(node.n - left)))
    kind = features.schema[names.get("subject", "subject")].dataType.simpleString()
    return features.sparkSession.createDataFrame(
        out, f"fold {kind}, node bigint, feature int, cut double, gain double, n_left bigint, n_right bigint"
    )
