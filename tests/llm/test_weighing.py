"""Quality rules, importance resampling and the manifest against plain restatements."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from paroxys.llm import importance, manifest, quality
from paroxys.llm.common import table

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.fixture(scope="module", params=["odd", "none", "driver"])
def docs(request, spark, odd_docs, no_docs):
    return {"odd": odd_docs, "none": no_docs}.get(request.param) or table(spark, SF, "documents")


@pytest.fixture(scope="module")
def items(spark):
    return table(spark, SF, "benchmark")


# --- quality rules ----------------------------------------------------------------------


def test_quality(docs):
    rows = quality.report(docs).collect()
    want = brute.quality(pairs(docs), quality.ROUNDS)
    same([tuple(r)[:-1] for r in rows], [r[:-1] for r in want])
    assert sorted(r.quality for r in rows) == pytest.approx(sorted(r[-1] for r in want), abs=2e-6)


def test_quality_keeps_columns_and_rows(docs):
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns
    want = [(r[0],) for r in brute.quality(pairs(docs), quality.ROUNDS) if r[-2]]
    same([tuple(r) for r in kept.select("doc_id").collect()], want)


def test_quality_with_columns_named_like_figures(spark, odd_docs):
    clash = odd_docs.withColumns({"n_words": F.lit(-5), "kept": F.lit("x"), "_n_words": F.lit(0)})
    same(
        [tuple(r) for r in quality.filter_quality(clash).select("doc_id").collect()],
        [tuple(r) for r in quality.filter_quality(odd_docs).select("doc_id").collect()],
    )


def test_repeated_words_of_random_sequences():
    rng = np.random.default_rng(5)
    for n in (0, 3, 8, 9, 40, 400):
        for kinds in (1, 2, 30):
            ids = rng.integers(0, kinds, n)
            text = " ".join(map(str, ids))
            assert quality.repeated_words(ids) == brute.figures(text)[4]


def test_estimation_finds_the_accuracies_of_made_up_rules():
    rng = np.random.default_rng(3)
    good = rng.random(60_000) < 0.7
    right = np.array([0.95, 0.8, 0.9, 0.7, 0.85])
    votes = np.where(rng.random((len(good), 5)) < right, 1, -1) * np.where(good, 1, -1)[:, None]
    votes[rng.random(votes.shape) < 0.3] = 0
    patterns, times = np.unique(votes, axis=0, return_counts=True)
    model = quality.estimate(patterns, times)
    assert model.good == pytest.approx(0.7, abs=0.02)
    assert model.right_on_good == pytest.approx(right, abs=0.03)
    assert model.right_on_bad == pytest.approx(right, abs=0.03)


def test_quality_agrees_with_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = quality.report(table(spark, sf, "documents")).where("not base_failed").join(labels, "doc_id")
    rates = {(r.kept, r.label): r["count"] for r in rows.groupBy("kept", "label").count().collect()}
    assert rates.get((True, 0), 0) <= 0.02 * sum(rates.values())
    assert rates.get((False, 1), 0) <= 0.02 * sum(rates.values())


# --- importance resampling --------------------------------------------------------------


@pytest.mark.parametrize(("piece", "bits"), [(importance.PIECE, importance.MAX_BITS), (40, 1 << 12)])
def test_importance(docs, items, piece, bits):
    """Lines cut short, and a filter that holds every line to be repeated, change nothing."""
    got = importance.report(docs, items, piece=piece, max_bits=bits)
    want = brute.importance(pairs(docs), [text for (text,) in items.select("text").collect()])
    # Rows that share an id and a score are interchangeable; nothing else is.
    same([tuple(r) for r in got.collect()], want)


def test_importance_of_lines_that_many_documents_share(spark, items):
    line = "the same long line of a licence that everybody copies again and again 12"
    rows = [(i, "\n".join([f"own words {i} of text {i % 7}", line, "", line, f"tail {i % 3}"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(7)
    texts = [text for (text,) in items.select("text").collect()]
    same([tuple(r) for r in importance.report(docs, items).collect()], brute.importance(rows, texts))
    parts = importance.take_apart(docs, "doc_id")
    # The shared line is counted once and used by every document.
    lines = {r.times for r in parts.lines.collect()}
    assert 600 in lines
    total = parts.counts().agg(F.sum("n")).first()[0]
    assert total == sum(2 * len(brute.ascii_words(text)) - 1 for _, text in rows)


def test_resample_returns_whole_rows(docs, items):
    got = importance.resample(docs, items, percent=50)
    assert got.columns == docs.columns
    ranked = importance.report(docs, items, percent=50).where("rank is not null")
    same([tuple(r) for r in got.select("doc_id").collect()], [tuple(r) for r in ranked.select("doc_id").collect()])


def test_resample_splits_a_group_of_equal_rows(spark, items):
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "x")] * 8, "doc_id long, text string, _id string")
    assert importance.resample(docs, items, percent=40).count() == 3


def test_no_target(spark, odd_docs, items):
    empty = items.limit(0)
    same([tuple(r) for r in importance.report(odd_docs, empty).collect()], brute.importance(pairs(odd_docs), []))


# --- manifest ---------------------------------------------------------------------------


def whole(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_manifest(docs):
    same([tuple(r) for r in manifest.report(docs).collect()], brute.manifest(whole(docs)))


def test_manifest_of_groups_of_all_sizes(spark):
    """One leaf, one run, borders of runs and blocks, and more than 4096 leaves."""
    rows = [
        (1000 * g + i if i % 11 else None, None if g == 0 else f"s{g}", "en", i, f"Text {g} {i}")
        for g, size in enumerate((17, 1, 16, 255, 256, 257, 4100))
        for i in range(size)
    ]
    rows += [(7, f"many {i}", None, None, None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    same([tuple(r) for r in manifest.report(docs.repartition(5)).collect()], brute.manifest(rows))


def test_versions_copy_only_the_ancestors(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    tree = manifest.build(docs, **manifest.lower_cased(docs))
    rows = tree.verified().where("copies is not null").collect()
    assert rows
    sizes = {r.key: r.n for r in tree.leaves.groupBy("key").agg(F.count("*").alias("n")).collect()}
    for r in rows:
        levels = sum(1 for k in range(9) if 16**k < sizes[r.key]) + sum(1 for k in range(9) if 16**k < len(sizes))
        assert len(r.copies) == levels + 1
        assert r.copies[-1] == r.folded_root
    assert tree.versions().count() == sum(len(r.copies) for r in rows)


def test_untouched_tables_verify(odd_docs, no_docs):
    assert manifest.build(odd_docs).verified().where("verified").count() == odd_docs.count()
    empty = manifest.build(no_docs)
    assert empty.root is None and empty.verified().count() == 0
