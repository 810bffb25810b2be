"""Exact k-nearest-neighbour vote between two sets of vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paroxys.session import shared_folder

# Training rows compared at once, and distances held at once while two blocks meet.
BLOCK_ROWS = 4096
CELLS = 1 << 22
MAX_PIVOTS = 1024
CELL_ROWS = 1024
#: Training rows and test rows that meet in one task. Small tables are cut into up to
#: ``UNITS`` units, if each has ``LEAST_ROWS`` rows.
UNIT_ROWS = 65_536
VISITORS = 65_536
UNITS, LEAST_ROWS = 16, 4096
#: Test rows of a batch that are copied to their units at once.
_SENT = 1 << 15


def _squared(test: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Squared distances summed coordinate by coordinate (no cancellation)."""
    out = np.zeros((len(test), len(train)))
    for a, b in zip(test.T, train.T):
        out += np.subtract.outer(a, b) ** 2
    return out


def _finite(x: str) -> Column:
    """The vector as doubles; the job fails on NaN or infinite coordinates."""
    values = F.col(x).cast("array<double>")
    sound = F.forall(values, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    broken = F.raise_error(F.lit("a vector has a coordinate that is no finite number"))
    return F.when(sound, values).otherwise(broken.cast("array<double>"))


class _Best:
    """The k nearest rows found so far for each row of a block, by distance, then place."""

    def __init__(self, rows: int, k: int) -> None:
        self.d2, self.place = np.full((rows, k), np.inf), np.full((rows, k), -1)

    def add(self, row: np.ndarray, place: np.ndarray, d2: np.ndarray) -> None:
        k = self.d2.shape[1]
        better = d2 <= self.d2[row, -1]
        better &= np.isfinite(d2)
        row, place, d2 = row[better], place[better], d2[better]
        if not len(row):
            return
        own, at = np.unique(row, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(len(own)), k), at])
        place = np.concatenate([self.place[own].ravel(), place])
        d2 = np.concatenate([self.d2[own].ravel(), d2])
        order = np.lexsort((place, d2, at))
        at, place, d2 = at[order], place[order], d2[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        first = rank < k
        self.d2[own[at[first]], rank[first]] = d2[first]
        self.place[own[at[first]], rank[first]] = place[first]


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of rows ``a[i]`` and ``b[j]``, summed as ``_squared`` does."""
    out = np.zeros(len(i))
    for c in range(a.shape[1]):
        out += (a[i, c] - b[j, c]) ** 2
    return out


def _meet(
    a: np.ndarray, b: np.ndarray, place: np.ndarray, rows: np.ndarray, bound: np.ndarray, best: _Best, same
) -> None:
    """Compare rows ``a[rows]`` with the rows ``b``, whose places are ``place``.

    A matrix product gives distances up to rounding; only pairs that may be among the k
    nearest are then summed without cancellation. ``same(i, place)`` tells pairs that must
    stay apart, ``bound`` a squared distance beyond which nothing is looked for.
    """
    k = best.d2.shape[1]
    mine = a[rows]
    aa, bb = (mine * mine).sum(axis=1), (b * b).sum(axis=1)
    slack = (a.shape[1] + 8) * 1e-15 * (aa + bb.max())
    most = np.minimum(bound[rows], best.d2[rows, -1])
    if np.isfinite(slack).all():
        free = ~np.isfinite(most)
        if free.any():
            # Nothing known yet: the k-th smallest of these distances is the bound.
            at = np.flatnonzero(free)
            near = aa[at, None] + bb - 2 * (mine[at] @ b.T)
            near[same(rows[at][:, None], place)] = np.inf
            if len(b) > k:
                most[at] = np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * slack[at]
            i, j = np.nonzero(near <= np.minimum(most[at], np.finfo(float).max)[:, None])
            i = at[i]
            best.add(rows[i], place[j], _exact(mine, b, i, j))
            if free.all():
                return
            rows, mine, aa, slack, most = (v[~free] for v in (rows, mine, aa, slack, most))
        # Distance less bound in one product.
        left = np.column_stack([-2 * mine, aa - most * (1 + 1e-12) - 2 * slack, np.ones(len(mine))])
        i, j = np.nonzero(left @ np.column_stack([b, np.ones(len(b)), bb]).T <= 0)
    else:
        i, j = (v.ravel() for v in np.indices((len(mine), len(b))))
    apart = ~same(rows[i], place[j])
    i, j = i[apart], j[apart]
    best.add(rows[i], place[j], _exact(mine, b, i, j))


def _first_copies(x: np.ndarray, part: np.ndarray, k: int) -> np.ndarray:
    """Whether a row is one of the first k with its vector and part: no other copy can be
    among k nearest rows."""
    whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    code = np.unique(whole, return_inverse=True)[1]
    if code.max() + 1 == len(x):
        return np.ones(len(x), bool)
    return (pd.DataFrame({"x": code, "part": part}).groupby(["x", "part"], dropna=False).cumcount() < k).to_numpy()


def _k_nearest(a: pd.DataFrame, b: pd.DataFrame, k: int, apart: bool, cells: Cells, block_rows: int) -> pd.DataFrame:
    """``(id, neighbour, label, d2)`` of the k nearest rows of ``b`` for each row of ``a``, among
    the cells it has to meet; where ``bound`` is given only rows up to it."""
    if not len(a) or not len(b):
        return pd.DataFrame({"id": [], "neighbour": [], "label": [], "d2": []})
    b = b.sort_values("t_id", ignore_index=True)
    x, vectors = np.stack(a["x"].to_numpy()), np.stack(b["t_x"].to_numpy())
    kept = np.flatnonzero(_first_copies(vectors, b["t_part"].to_numpy(), k))
    b, vectors = b.iloc[kept], vectors[kept]
    part, t_part = a["part"].to_numpy(), b["t_part"].to_numpy()
    same = (lambda i, j: part[i] == t_part[j]) if apart else (lambda i, j: np.zeros(np.broadcast(i, j).shape, bool))
    home, reach = a["home"].to_numpy(), a["bound"].to_numpy(dtype=float)
    first = bool(a["first"].iloc[0])
    bound = np.full(len(a), np.inf) if first else np.where(np.isnan(reach), np.inf, reach)
    best = _Best(len(a), k)
    cell = b["cell"].to_numpy()
    for own in np.unique(cell):
        rows = np.flatnonzero(home == own) if first else np.flatnonzero(
            (home != own) & cells.only(own).reachable(cells.only(own).distances(x), bound)[:, 0]
        )
        places = np.flatnonzero(cell == own)
        for begin in range(0, len(places), block_rows):
            block = places[begin : begin + block_rows]
            step = max(1, CELLS // len(block))
            for at in range(0, len(rows), step):
                _meet(x, vectors[block], block, rows[at : at + step], bound * bound, best, same)
    row, rank = np.nonzero(best.place >= 0)
    place = best.place[row, rank]
    return pd.DataFrame(
        {
            "id": a["id"].to_numpy()[row],
            "neighbour": b["t_id"].to_numpy()[place],
            "label": b["t_label"].to_numpy()[place],
            "d2": best.d2[row, rank],
        }
    )


class Cells:
    """Training rows around pivots: how many rows a cell has and how far they lie from its pivot."""

    def __init__(self, pivots: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.pivots, self.rows, self.low, self.high = pivots, rows, low, high

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(_squared(x, self.pivots))

    def reachable(self, dist: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Cells that may hold a row within ``bound``, by the triangle inequality.

        A row at distance r from the pivot is at least ``|dist - r|`` away; rounding is
        allowed for, so no cell is missed.
        """
        slack = 1e-9 * (1 + dist)
        least = np.maximum(dist - self.high, self.low - dist)
        return (least <= bound[:, None] + slack) & (self.rows > 0)

    def only(self, cell: int) -> Cells:
        return Cells(*(v[cell : cell + 1] for v in (self.pivots, self.rows, self.low, self.high)))


def _units(cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """First unit and number of units of each cell. Small cells share a unit, those near the
    same pivot first; a large cell is spread over units of its own."""
    total = int(cells.rows.sum())
    size = -(-total // max(1, min(UNITS, total // LEAST_ROWS), -(-total // UNIT_ROWS))) or 1
    centres = cells.pivots[:: max(1, math.isqrt(len(cells.pivots)))]
    pieces = np.maximum(-(-cells.rows // size), 1)
    first, unit, filled = np.zeros(len(cells.rows), np.int64), 0, 0
    for c in np.argsort(_squared(cells.pivots, centres).argmin(axis=1), kind="stable"):
        if filled and (filled + cells.rows[c] > size or pieces[c] > 1):
            unit, filled = unit + 1, 0
        first[c] = unit
        if pieces[c] > 1:
            unit += int(pieces[c])
        else:
            filled += int(cells.rows[c])
    return first, pieces


def _arrays(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nearest(
    test: DataFrame,
    train: DataFrame,
    k: int = 3,
    key: str = "window_id",
    x: str = "x",
    label: str = "y",
    apart: str | None = None,
    pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
    report: dict | None = None,
) -> DataFrame:
    """``(key, neighbour, label, distance)`` of the k nearest training rows.

    Exact, by pivots: training rows belong to the cell of their nearest pivot. Every test
    row first meets its own cell; the distance of its k-th neighbour there then rules out
    all cells that the triangle inequality puts farther away, and only the others are
    met. Pivots are the training rows with the smallest key hashes, about the root of
    their number, at most ``MAX_PIVOTS`` and one per ``CELL_ROWS`` rows; they decide the work, not the result. Cells
    travel in units of at most about ``UNIT_ROWS`` rows: a test row is sent once to each unit
    that has a cell it must meet. There it meets these cells ``block_rows`` rows at a time.
    Copies of one vector do not gather in a task, and a task hands on only its k best per
    test row. The first round runs now.

    ``apart`` names a column whose equal values must not be neighbours (the held-out
    subject). ``report`` receives the number of compared pairs and of all pairs.
    """
    kind = dict(test.dtypes)[key]
    own = {"id": F.col(key), "part": F.col(apart) if apart else F.lit(None).cast("int")}
    # Every column is renamed: test and training rows may come from the same table.
    left = test.select(*[c.alias(n) for n, c in own.items()], _finite(x).alias("x"))
    right = train.select(
        *[c.alias(f"t_{n}") for n, c in own.items()], F.col(label).cast("int").alias("t_label"), _finite(x).alias("t_x")
    )
    n_train = train.count()
    wanted = pivots or max(1, min(MAX_PIVOTS, math.isqrt(n_train), n_train // CELL_ROWS))
    centres = right.orderBy(F.xxhash64("t_id"), "t_id").limit(wanted).select("t_x").collect()
    if not centres:
        schema = f"{key} {kind}, neighbour {kind}, label int, rank int, distance double"
        return test.sparkSession.createDataFrame([], schema)
    points = np.unique(np.array([r[0] for r in centres]), axis=0)
    cells = Cells(points, *np.zeros((3, len(points))))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dist = cells.distances(_arrays(batch, "t_x"))
                cell = dist.argmin(axis=1)
                radius = np.take_along_axis(dist, cell[:, None], axis=1)[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int32()), pa.array(radius)], [*batch.schema.names, "cell", "radius"]
                )

    kinds = {f.name: f.dataType.simpleString() for f in right.schema.fields}
    columns = ", ".join(f"{n} {t}" for n, t in kinds.items())
    settled = _stored(right.mapInArrow(settle, f"{columns}, cell int, radius double"), "cells")
    sizes = settled.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high"))
    counts, low, high = np.zeros(len(points), np.int64), np.zeros(len(points)), np.zeros(len(points))
    for r in sizes.collect():  # one row per pivot
        counts[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    cells = Cells(points, counts, low, high)
    first_unit, pieces = _units(cells)
    n_units = int((first_unit + pieces).max())
    ints = lambda values: F.array(*[F.lit(int(v)) for v in values])
    of_cell = lambda values: F.element_at(ints(values), F.col("cell") + 1)
    placed = settled.withColumn("unit", of_cell(first_unit) + F.pmod(F.xxhash64("t_id"), of_cell(pieces)).cast("int"))
    # Rows of each cell in each unit.
    shares = np.zeros((len(points), n_units))
    for c, (begin, times) in enumerate(zip(first_unit, pieces)):
        shares[c, begin : begin + times] = max(counts[c], 1) / times

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Test rows for every unit of the cells they have to meet."""
        for batch in batches:
            if not batch.num_rows:
                continue
            dist = cells.distances(_arrays(batch, "x"))
            home = np.where(cells.rows > 0, dist, np.inf).argmin(axis=1)
            again = "bound" in batch.schema.names
            if again:
                bound = batch.column("bound").to_numpy(zero_copy_only=False)
                goes = cells.reachable(dist, np.where(np.isnan(bound), np.inf, bound))
                goes[np.arange(len(home)), home] = False
            else:
                bound = np.full(len(home), np.nan)
                goes = np.zeros(dist.shape, bool)
                goes[np.arange(len(home)), home] = True
            pairs = goes @ shares
            rows, units = np.nonzero(pairs)
            for begin in range(0, len(rows), _SENT):
                row, unit = rows[begin : begin + _SENT], units[begin : begin + _SENT]
                taken = batch.select(["id", "part", "x"]).take(pa.array(row))
                made = [pa.array(home[row], pa.int32()), pa.array(bound[row]), pa.array(np.full(len(row), not again))]
                made += [pa.array(unit, pa.int32()), pa.array(pairs[row, unit])]
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, *made], ["id", "part", "x", "home", "bound", "first", "unit", "pairs"]
                )

    test_kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    visiting = ", ".join(f"{n} {t}" for n, t in test_kinds.items())
    visiting += ", home int, bound double, first boolean, unit int, pairs double"
    outputs = f"id {kind}, neighbour {kind}, label int, d2 double"

    def met(rows: DataFrame) -> DataFrame:
        """The k best of every visit; a unit has as many copies as its visitors need tasks."""
        visits = _stored(rows.mapInArrow(visit, visiting), "visits")
        visitors, pairs = np.zeros(n_units, np.int64), 0.0
        for r in visits.groupBy("unit").agg(F.count("*").alias("m"), F.sum("pairs").alias("p")).collect():  # one row per unit
            visitors[r["unit"]] = r["m"]
            pairs += r["p"]
        if report is not None:
            report["pairs"] = report.get("pairs", 0) + round(pairs)
        salts = F.element_at(ints(-(-m // VISITORS) or 1 for m in visitors), F.col("unit") + 1)
        copies = F.explode(F.sequence(F.lit(0), salts - 1))
        meet = lambda a, b: _k_nearest(a, b, k, apart is not None, cells, block_rows)
        return (
            visits.drop("pairs")
            .withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
            .groupBy("unit", "salt")
            .cogroup(placed.drop("radius").withColumn("salt", copies).groupBy("unit", "salt"))
            .applyInPandas(meet, outputs)
        )

    first = _stored(met(left), "own-cells")
    order = W.partitionBy("id").orderBy("d2", "neighbour")
    found = first
    if len(points) > 1:
        bounds = first.withColumn("place", F.row_number().over(order)).where(F.col("place") == k)
        bounds = bounds.select(F.col("id").alias("_id"), F.sqrt("d2").alias("bound"))
        found = first.unionAll(met(left.join(bounds, F.col("id") == F.col("_id"), "left").drop("_id")))
    if report is not None:
        report["all"] = test.count() * n_train
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("id").alias(key), "neighbour", "label", "rank", F.sqrt("d2").alias("distance"))
    )


def distance_vote(neighbours: DataFrame, key: str = "window_id") -> DataFrame:
    """``prob`` and ``pred`` by inverse distance; exact hits outvote everything else."""
    exact = F.max((F.col("distance") == 0).cast("int"))
    inverse = F.try_divide(F.lit(1.0), F.col("distance"))
    hits = (F.col("distance") == 0).cast("double")
    y = F.col("label")
    sums = neighbours.groupBy(key).agg(
        exact.alias("_exact"),
        F.sum(hits * y).alias("_h1"),
        F.sum(hits).alias("_h"),
        F.sum(inverse * y).alias("_w1"),
        F.sum(inverse).alias("_w"),
    )
    prob = F.when(F.col("_exact") == 1, F.try_divide("_h1", "_h")).otherwise(
        F.try_divide("_w1", "_w")
    )
    return sums.select(key, prob.alias("prob")).withColumn(
        "pred", (F.col("prob") > 0.5).cast("int")
    )


def knn_vote(test: DataFrame, train: DataFrame, keep: Sequence[str] = (), **options) -> DataFrame:
    """Every test row with ``prob`` and ``pred``, null where it has no neighbour."""
    key = options.get("key", "window_id")
    votes = distance_vote(nearest(test, train, **options), key)
    # Renamed, so that test and training rows of one table do not clash in the join.
    votes = votes.select(F.col(key).alias("_key"), "prob", "pred")
    rows = test.select(F.col(key).alias(key), *[F.col(c).alias(c) for c in keep])
    return rows.join(votes, F.col(key) == F.col("_key"), "left").drop("_key")
