"""The operators as named queries over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paroxys.llm import (
    chat,
    decontaminate,
    exact_dedup,
    importance,
    katz,
    language,
    manifest,
    mixing,
    quality,
    simhash,
    suffix,
    surrogates,
    warc,
)
from paroxys.llm.common import crc32_of, table

#: Production weights of the mixture; names that are not listed weigh 1.
MIX_WEIGHTS = {
    "domain": {"web": 4, "books": 3, "code": 2, "forum": 1},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 2},
}
DOMAINS = ("web", "books", "code", "forum")


def domain_of(source: str = "source") -> Column:
    """Domain of a numbered source: the number modulo four; other sources are unknown."""
    number = F.regexp_extract(F.col(source), "([0-9]+)$", 1)
    names = F.array(*[F.lit(d) for d in DOMAINS])
    return F.when(number != "", names[(number.cast("bigint") % len(DOMAINS)).cast("int")])


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, names = mixing.mix(docs, domain_of(), MIX_WEIGHTS)
    return rows.select(
        "doc_id",
        F.col(names["domain"]).alias("domain"),
        "lang",
        "source",
        F.col(names["tokens"]).alias("n_tokens"),
        F.col(names["epoch"]).alias("epoch"),
    )


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(crc32_of("doc_id"), F.lit(7)) == 2
    rows, model = katz.fit_and_score(table(spark, sf_dir, "documents"), ~held_out)
    return rows.select(
        "doc_id",
        (~F.col("trained")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model["n"]).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is public here; a real run passes its own."""
    rows = surrogates.replace(table(spark, sf_dir, "documents"), b"example key")
    kinds = F.transform(
        F.array_sort(F.map_entries("kinds")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    )
    return rows.select("doc_id", "text", "n_entities", F.array_join(kinds, ",").alias("kinds"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(table(spark, sf_dir, "documents"))


def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(crc32_of("doc_id"), F.lit(4)) == 2
    model = language.fit(docs.where(~held_out))
    rows, names = language.predict(docs.select("doc_id", "text"), model)
    return rows.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col(names["lang"]).alias("lang_pred"),
        F.col(names["score"]).alias("score"),
        F.col(names["ambiguous"]).alias("ambiguous"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).drop("word_spans")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_repeated_passages": op2_repeated_passages,
    "op3_source_mix": op3_source_mix,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_katz": op5_katz,
    "op6_surrogates": op6_surrogates,
    "op7_simhash": op7_simhash,
    "op8_chat_rotation": op8_chat_rotation,
    "op9_language": op9_language,
    "op10_decontamination": op10_decontamination,
    "op11_quality_rules": op11_quality_rules,
    "op12_importance": op12_importance,
    "op13_manifest": op13_manifest,
}
