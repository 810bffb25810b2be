"""Class weights, cross-validation splits and sampling.

Random choices are orders by a hash of the row key, so retries and reruns agree. A
class may hold nearly all rows: positions within a class come from chunked counts over
ranges of the hash, never from one sorted class.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paroxys.functions.hashing import MODULUS, replayable_key, uniform
from paroxys.operators.ordered import chunk_count, dense_index, hashed_bucket


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """``total / (classes * count)`` per class: one row per label value."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())
    classes = F.count(F.lit(1)).over(W.partitionBy())
    return counts.withColumns({"_total": total, "_classes": classes}).select(
        label,
        "n",
        (F.col("_total").cast("double") / (F.col("_classes") * F.col("n"))).alias("weight"),
    )


def _per_class(df: DataFrame, figures: DataFrame, label: str) -> DataFrame:
    """Attach one row per class; Spark broadcasts the figures if they are small."""
    return df.join(figures, label)


def sample_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """Every row with its class weight."""
    return _per_class(df, class_weights(df, label).drop("n"), label)


def binary_weights(df: DataFrame, label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Inverse-frequency weights of both classes and the negative to positive ratio."""
    y = F.col(label)
    counts = df.groupBy(*by).agg(
        F.count(F.when(y == 0, 1)).alias("n_neg"), F.count(F.when(y == 1, 1)).alias("n_pos")
    )
    total = (F.col("n_neg") + F.col("n_pos")).cast("double")
    return counts.withColumns(
        {
            "w_neg": F.try_divide(total, 2 * F.col("n_neg")),
            "w_pos": F.try_divide(total, 2 * F.col("n_pos")),
            "neg_pos_ratio": F.col("n_neg") / F.greatest("n_pos", F.lit(1)).cast("double"),
        }
    )


def class_position(
    df: DataFrame, key: str = "window_id", label: str = "y", seed: int = 42
) -> DataFrame:
    """Add ``pos``, the row's place in the hash order of its class, from 0."""
    hashed = df.withColumn("_hash", replayable_key(key, seed)).withColumn(
        "_chunk", hashed_bucket("_hash", MODULUS, chunk_count(df))
    )
    return dense_index(hashed, [label], "_chunk", ["_hash", key], "pos").drop("_hash", "_chunk")


def loso_folds(df: DataFrame, subject: str = "subject", label: str = "y") -> DataFrame:
    """One row per usable leave-one-subject-out fold with its train and test counts.

    Folds whose held-out subject has no positive window are left out. Training counts
    are totals minus the subject's own, so rows are counted once, not once per fold.
    """
    counts = df.groupBy(subject).agg(
        F.count(F.lit(1)).alias("n_test"), F.sum(label).cast("bigint").alias("pos_test")
    )
    total = counts.agg(F.sum("n_test").alias("n"), F.sum("pos_test").alias("pos"))
    return (
        counts.withColumns(
            {
                "n_train": total.select("n").scalar() - F.col("n_test"),
                "pos_train": total.select("pos").scalar() - F.col("pos_test"),
            }
        )
        .where("pos_test > 0")
        .select(F.col(subject).alias("fold"), "n_train", "n_test", "pos_train", "pos_test")
    )


def trainable(folds: DataFrame) -> DataFrame:
    """Folds that can be fitted: some positive and some negative training windows."""
    return folds.where("pos_train > 0 and pos_train < n_train")


def loso_split(df: DataFrame, held_out, subject: str = "subject") -> tuple[DataFrame, DataFrame]:
    """Training and test rows of one fold; both are plain filters on the subject."""
    return df.where(F.col(subject) != held_out), df.where(F.col(subject) == held_out)


#: Ranges of the hash in which rows are counted before a cut is looked for in one of them.
RANGES = 4096


class _Cuts:
    """Where the first ``n`` rows of each class end in hash order.

    Rows are counted per class and range of the hash, then only the range that holds the
    cut is ranked, by hash and key alone. What comes back is one hash and key per cut, so
    the rows themselves, with their arrays, are filtered where they are. Keys are unique.
    """

    def __init__(self, df: DataFrame, key: str, label: str | None, seed: int) -> None:
        self.key, self.label, self.seed = key, label, seed
        own = F.col(label) if label else F.lit(0)
        hashed = df.select(own.alias("_class"), replayable_key(key, seed).alias("_hash"), F.col(key).alias("_key"))
        self.hashed = hashed.withColumn("_range", hashed_bucket("_hash", MODULUS, RANGES))
        self.counts: dict = {}
        # At most RANGES rows per class.
        for r in self.hashed.groupBy("_class", "_range").count().collect():
            self.counts.setdefault(r["_class"], {})[r["_range"]] = r["count"]
        self.total = {c: sum(ranges.values()) for c, ranges in self.counts.items()}

    def _class(self, value) -> Column:
        return F.col(self.label).eqNullSafe(F.lit(value)) if self.label else F.lit(True)

    def first(self, wanted: Mapping) -> Column:
        """Condition that holds for the first ``wanted[class]`` rows of every class."""
        kind = self.hashed.schema["_class"].dataType.simpleString()
        places, whole = [], []
        for value, n in wanted.items():
            if n >= self.total.get(value, 0):
                whole.append(value)
                continue
            before = 0
            for at, count in sorted(self.counts[value].items()):
                if before < n <= before + count:
                    places.append((value, at, n - before))
                before += count
        spots = self.hashed.sparkSession.createDataFrame(places, f"_own {kind}, _at bigint, _place int")
        met = self.hashed.join(
            F.broadcast(spots), F.col("_class").eqNullSafe(F.col("_own")) & (F.col("_range") == F.col("_at"))
        )
        rank = F.row_number().over(W.partitionBy("_own", "_at").orderBy("_hash", "_key"))
        ends = met.withColumn("_rank", rank).where("_rank = _place").select("_own", "_hash", "_key").collect() if places else []
        found = F.lit(False)
        for value in whole:
            found = found | self._class(value)
        own_hash = replayable_key(self.key, self.seed)
        for end in ends:
            at_end = (own_hash == end["_hash"]) & (F.col(self.key) <= F.lit(end["_key"]))
            found = found | (self._class(end["_own"]) & ((own_hash < end["_hash"]) | at_end))
        return found


def stratified_kfold(
    df: DataFrame,
    n_splits: int = 5,
    key: str = "window_id",
    label: str = "y",
    seed: int = 42,
) -> DataFrame:
    """Add ``fold``: every class is dealt out to the folds in hash order."""
    return (
        class_position(df, key, label, seed)
        .withColumn("fold", F.pmod("pos", F.lit(n_splits)).cast("int"))
        .drop("pos")
    )


def stratified_split(
    df: DataFrame,
    test_size: float = 0.2,
    val_size: float = 0.1,
    key: str = "window_id",
    label: str = "y",
    seed: int = 42,
) -> DataFrame:
    """Add ``role``: test, val or train, cut per class at the given shares."""
    cuts = _Cuts(df, key, label, seed)
    n_test = {c: math.floor(n * test_size + 0.5) for c, n in cuts.total.items()}
    n_val = {c: n_test[c] + math.floor(n * val_size + 0.5) for c, n in cuts.total.items()}
    role = F.when(cuts.first(n_test), "test").when(cuts.first(n_val), "val").otherwise("train")
    return df.withColumn("role", role)


def inner_split(
    train: DataFrame, n_train: int, val_size: float = 0.1, min_rows: int = 20, **options
) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows inside a fold.

    Folds of at most ``min_rows`` rows validate on themselves; 0 always splits.
    """
    if n_train <= min_rows:
        return train, train
    cut = stratified_split(train, 0.0, val_size, **options)
    return cut.where("role = 'train'").drop("role"), cut.where("role = 'val'").drop("role")


def first_subjects(df: DataFrame, n: int, subject: str = "subject") -> DataFrame:
    """Rows of the first ``n`` subjects in order."""
    chosen = df.select(subject).distinct().orderBy(subject).limit(n)
    return df.join(chosen, subject, "left_semi")


def random_rows(df: DataFrame, n: int, key: str = "window_id", seed: int = 42) -> DataFrame:
    """``n`` rows without replacement."""
    return df.where(_Cuts(df, key, None, seed).first({0: n}))


def per_class(
    df: DataFrame, n: int, key: str = "window_id", label: str = "y", seed: int = 42
) -> DataFrame:
    """Up to ``n`` rows of every class."""
    cuts = _Cuts(df, key, label, seed)
    return df.where(cuts.first({c: n for c in cuts.total}))


def undersample(
    df: DataFrame, ratio: float = 3.0, key: str = "window_id", label: str = "y", seed: int = 42
) -> DataFrame:
    """All positives and at most ``ratio`` negatives per positive, chosen by hash order."""
    cuts = _Cuts(df, key, label, seed)
    most = math.floor(cuts.total.get(1, 0) * ratio)
    return df.where(cuts.first({c: n if c == 1 else min(n, most) for c, n in cuts.total.items()}))


def weighted_sample(
    df: DataFrame, key: str = "window_id", label: str = "y", seed: int = 42
) -> DataFrame:
    """As many draws as rows, with replacement, by class weight: ``(draw, key, label)``.

    Class weights make every class equally likely and the rows of a class equal among
    themselves. So draw number ``d`` picks class and position from two uniforms, and an
    equality join on ``(class, position)`` fetches the row.
    """
    placed = class_position(df.select(key, label), key, label, seed)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    classes = counts.agg(F.array_sort(F.collect_list(F.struct(label, "n")))).scalar()
    draws = (
        dense_index(
            df.select(key).withColumn("_h", replayable_key(key, seed)).withColumn(
                "_chunk", hashed_bucket("_h", MODULUS, chunk_count(df))
            ),
            [],
            "_chunk",
            ["_h", key],
            "draw",
        )
        .select("draw")
        .withColumn("_classes", classes)
    )
    pick = F.floor(uniform(F.col("draw"), seed + 1) * F.size("_classes")).cast("int")
    draws = draws.withColumn("_class", F.get("_classes", pick)).select(
        "draw",
        F.col(f"_class.{label}").alias(label),
        F.floor(uniform(F.col("draw"), seed + 2) * F.col("_class.n")).cast("bigint").alias("pos"),
    )
    return draws.join(placed, [label, "pos"]).select("draw", key, label)
