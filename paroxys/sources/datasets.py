"""Stored window datasets, feature tables and experiment results."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_windows(windows: DataFrame, path: str) -> None:
    """Overwrite the dataset, one folder per subject.

    Files are cut by size within a subject, so a large subject spreads over tasks.
    """
    writer = windows.hint("rebalance", "subject").write.mode("overwrite")
    writer.partitionBy("subject").parquet(path)


def read_windows(
    spark: SparkSession,
    path: str,
    label: str = "y",
    only: DataFrame | None = None,
    key: Sequence[str] = ("recording", "k"),
) -> DataFrame:
    """Windows with the chosen label as ``y``; ``only`` keeps the listed keys.

    The other label columns are not read. A dataset without subjects gets subject 0.
    """
    stored = spark.read.parquet(path)
    if label not in stored.columns:
        raise ValueError(f"dataset has no label column {label!r}")
    labels = [c for c in stored.columns if c == "y" or c.startswith("y_")]
    rows = stored.withColumn("y", F.col(label)).drop(*[c for c in labels if c != "y"])
    if "subject" not in rows.columns:
        rows = rows.withColumn("subject", F.lit(0))
    return rows if only is None else rows.join(only.select(*key), list(key), "left_semi")


def write_metadata(metadata: DataFrame, path: str) -> None:
    """One JSON document describing the dataset (a single small row)."""
    metadata.coalesce(1).write.mode("overwrite").json(path)


def append_results(results: DataFrame, path: str, experiment: str, run: str = "all") -> None:
    """Add a run to the results table; new metric columns may appear over time.

    A run that is written again replaces its own rows, so a retry doubles nothing.
    """
    tagged = results.withColumns({"experiment": F.lit(experiment), "run": F.lit(run)})
    writer = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("experiment", "run").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def write_loso(folds: DataFrame, summary: DataFrame, path: str, by: str = "model") -> None:
    """Folds nested under their model beside mean and deviation, as JSON."""
    nested = folds.groupBy(by).agg(
        F.sort_array(F.collect_list(F.struct(*[c for c in folds.columns if c != by]))).alias("folds")
    )
    means = [c for c in summary.columns if c.startswith("mean_")]
    stds = [c for c in summary.columns if c.startswith("std_")]
    packed = summary.select(
        by,
        "n_folds",
        F.struct(*[F.col(c).alias(c[5:]) for c in means]).alias("mean"),
        F.struct(*[F.col(c).alias(c[4:]) for c in stds]).alias("std"),
    )
    nested.join(packed, by).write.mode("overwrite").json(path)


def validate(
    dataset: DataFrame, labels: Sequence[str], required: Sequence[str], min_subjects: int = 1
) -> DataFrame:
    """One row: missing columns, subjects, and positives and share per label."""
    missing = [c for c in required if c not in dataset.columns]
    present = [c for c in labels if c in dataset.columns]
    counted = dataset.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_distinct("subject").alias("subjects"),
        *[F.sum(c).cast("bigint").alias(f"{c}_positive") for c in present],
        *[F.avg(c).alias(f"{c}_ratio") for c in present],
    )
    return counted.withColumns(
        {
            "missing": F.lit(",".join(missing)),
            "valid": F.lit(not missing) & (F.col("subjects") >= min_subjects) & (F.col("samples") > 0),
        }
    )


#: Buckets of stored tables that are to meet without a shuffle.
BUCKETS = 64


def write_bucketed(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> str:
    """Store rows by hash of their keys, one file per bucket; the name of the new table."""
    name = f"bucketed_{uuid.uuid4().hex}"
    writer = rows.repartition(buckets, *keys).write.option("path", path)
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return name


def merge_dataset(
    spark: SparkSession,
    signals: str,
    labels: Mapping[str, str],
    keys: Sequence[str],
    features: str | None = None,
    label: str = "y",
) -> DataFrame:
    """One row per window from bucketed tables: signals, a label column per variant, features.

    Tables bucketed alike by ``keys`` meet bucket by bucket, nothing is shuffled. A key that
    a table lists twice, or that one of them lacks, makes the job fail.
    """

    def once(table: str, *columns: str) -> DataFrame:
        rows = spark.table(table)
        times = F.count(F.lit(1)).over(W.partitionBy(*keys))
        twice = F.raise_error(F.lit("a window is listed twice")).cast("boolean")
        return rows.select(*keys, *columns, F.when(times == 1, True).otherwise(twice).alias("_here"))

    others = {**labels, **({"features": features} if features else {})}
    # Keys are listed once and those of the signals are found everywhere: equal counts mean equal keys.
    if len({spark.table(t).count() for t in (signals, *others.values())}) > 1:
        raise ValueError("the tables cover different windows")
    merged = once(signals, *[c for c in spark.table(signals).columns if c not in keys])
    complete = F.col("_here")
    for n, (name, table) in enumerate(others.items()):
        column = "features" if table == features else label
        part = once(table, column).withColumnsRenamed({column: name, "_here": f"_here_{n}"})
        merged = merged.join(part, list(keys), "left")
        complete = complete & F.col(f"_here_{n}").isNotNull()
    lacking = F.raise_error(F.lit("the tables cover different windows")).cast("boolean")
    checked = merged.where(F.when(complete, True).otherwise(lacking))
    return checked.drop("_here", *[f"_here_{n}" for n in range(len(others))])
