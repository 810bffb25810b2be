"""A training corpus in five steps; each reads what the step before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame, which is stored as
Parquet before the next stage reads it. The first four return the columns of
``documents``; the mixture adds the domain, the token count and the epoch of each use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paroxys.llm import decontaminate, exact_dedup, language, mixing, simhash
from paroxys.llm.common import table, written
from paroxys.llm.queries import MIX_WEIGHTS, domain_of


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows; drop undetermined and ambiguous texts."""
    model = language.fit(docs)
    rows, names = language.predict(docs, model)
    sure = (F.col(names["lang"]) != language.UNDETERMINED) & ~F.col(names["ambiguous"])
    return rows.where(sure).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with similar five-word shingles."""
    return simhash.drop_near(docs)


def drop_test_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a test item occurs."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole epochs and seeded prefixes of each source by target weights."""
    return mixing.mix(docs, domain_of(), MIX_WEIGHTS)[0]


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_test_passages),
    ("mixing sources", mix_sources),
]

#: Fitted classifiers and similarity groups have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
