"""The registered text queries against their SQL, and the pipeline."""

import brute
import pytest
from compare import connect, differences, duck_rows, spark_rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from paroxys.llm.common import table
from paroxys.llm.oracles import oracles
from paroxys.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles()))
def test_matches_sql(spark, name):
    got = spark_rows(QUERIES[name](spark, SF))
    assert got[1]
    assert not differences(got, duck_rows(connect(SF), oracles()[name]))


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("op2_repeated_passages", "doc_id n_bytes n_removed n_spans kept_sha256"),
        ("op5_katz", "doc_id held_out n_tokens n_known train_tokens base_score score"),
        ("op7_simhash", "doc_id fingerprint component_id"),
        ("op9_language", "doc_id held_out lang_pred score ambiguous"),
    ],
)
def test_columns(spark, name, columns):
    rows = QUERIES[name](spark, SF)
    assert rows.columns == columns.split()
    assert rows.select("doc_id").distinct().count() == rows.count() == table(spark, SF, "documents").count()


def test_language_model_beats_its_base_on_held_out_texts(spark):
    rows = QUERIES["op5_katz"](spark, SF).where("held_out")
    score, base = rows.agg(F.sum("score"), F.sum("base_score")).first()
    assert base < score < 0


def test_stages(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        rows = docs
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            rows = stage(spark, rows, SF)
            if number < 4:
                assert rows.columns == docs.columns
        assert rows.columns[: len(docs.columns)] == docs.columns


def test_pipeline_against_plain_steps(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = set(rows)
    first = corpus_pipeline.identify_language(spark, docs, SF)
    kept = {r.doc_id for r in first.collect()}
    assert len(kept) > 0.97 * len(rows)
    by = lambda ids: [(i, rows[i].text) for i in sorted(ids)]
    kept = {r[0] for r in brute.exact(by(kept)) if r[3]}
    kept = brute.near_kept(by(kept))
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    kept = {r[0] for r in brute.contamination(by(kept), items) if not r[5]}
    result = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in result.select("doc_id").collect()} <= kept
    tokens = sum(len(brute.words(rows[i].text)) for i in kept)
    used = result.agg(F.sum("_tokens")).first()[0]
    # Each leaf may leave less than its next document; the leaves are small here.
    assert 0.6 * 0.5 * tokens < used <= 0.5 * tokens
