"""Recordings on shared storage: discovery, index, samples and annotation files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paroxys import schemas
from paroxys.operators.ordered import dense_index, ordered_bucket


def discover_records(spark: SparkSession, root: str, pattern: str = "*.edf") -> DataFrame:
    """``(path, length)`` of the recordings below ``root``; empty if it does not exist.

    Only the listing is read: the content column is pruned. Spark leaves out files of
    zero bytes.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        return reader.option("pathGlobFilter", pattern).load(root).select("path", "length")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, length bigint")


def record_index(paths: DataFrame, dataset: str, path: str = "path") -> DataFrame:
    """``{dataset}_{number:06d}`` per path, numbered in path order."""
    ranged = ordered_bucket(paths.select(path).distinct(), path)
    numbered = dense_index(ranged, [], "chunk", [path], "n")
    number = F.format_string("%06d", "n")
    return numbered.select(F.concat(F.lit(f"{dataset}_"), number).alias("record_id"), path)


def read_samples(
    spark: SparkSession, path: str, channels: Sequence[str] | None = None
) -> DataFrame:
    """Long samples from Parquet; the channel filter reaches the scan."""
    samples = spark.read.schema(schemas.SAMPLES).parquet(path)
    return samples if channels is None else samples.where(F.col("channel").isin(*channels))


def read_texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Annotation files as ``(path, subject, txt)``; the subject is the parent folder."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    files = reader.text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(
        path.alias("path"),
        F.element_at(F.split(path, "/"), -2).alias("subject"),
        F.col("value").alias("txt"),
    )


def siena_texts(spark: SparkSession, root: str) -> DataFrame:
    """Seizure lists below ``root``; no file gives no rows."""
    return read_texts(spark, root, "Seizures-list-*.txt")


def chbmit_texts(spark: SparkSession, root: str) -> DataFrame:
    """Summaries below ``root``; raises when there is none (one look at the listing)."""
    texts = read_texts(spark, root, "*-summary.txt")
    if texts.isEmpty():
        raise FileNotFoundError(f"no *-summary.txt files under {root}")
    return texts
