from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paroxys.functions.channels import channel_coverage, normal_name, wearable_channels
from paroxys.operators import neighbours, splits


@pytest.fixture(scope="module")
def rows(spark):
    """1 000 windows, one in ten positive; subject 0 holds a third and no positives."""
    data = [(i, 0 if i < 333 else 1 + i % 6, int(i >= 333 and i % 6 == 0)) for i in range(1000)]
    return spark.createDataFrame(data, "window_id bigint, subject int, y int")


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    assert dict(splits.class_weights(df).select("y", "weight").collect()) == {0: 4 / 6, 1: 2.0}
    spread = splits.sample_weights(df).collect()
    assert sum(r["weight"] for r in spread) == pytest.approx(4.0)
    row = splits.binary_weights(df).first()
    assert (row["w_pos"], row["neg_pos_ratio"]) == (2.0, 3.0)


def test_binary_weights_without_positives(spark):
    row = splits.binary_weights(spark.createDataFrame([(0,)], "y int")).first()
    assert row["w_pos"] is None and row["neg_pos_ratio"] == 1.0


def test_any_number_of_labels(spark):
    df = spark.range(1500).withColumnRenamed("id", "y")
    assert splits.sample_weights(df).agg(F.count("*"), F.avg("weight")).first()[:] == (1500, 1.0)


def test_loso_skips_subjects_without_positives(spark):
    df = spark.createDataFrame(
        [("A", 1), ("A", 0), ("B", 0), ("B", 0), ("C", 1)], "subject string, y int"
    )
    folds = {r["fold"]: r for r in splits.loso_folds(df).collect()}
    assert set(folds) == {"A", "C"}
    assert (folds["A"]["n_train"], folds["A"]["n_test"], folds["A"]["pos_train"]) == (3, 2, 1)
    train, test = splits.loso_split(df, "A")
    assert {r["subject"] for r in train.collect()} == {"B", "C"}
    assert {r["subject"] for r in test.collect()} == {"A"}
    only = spark.createDataFrame([("A", 1), ("B", 0)], "subject string, y int")
    assert splits.trainable(splits.loso_folds(only)).count() == 0


def test_kfold_is_stratified_and_complete(rows):
    folds = splits.stratified_kfold(rows, 5).collect()
    assert len({r["window_id"] for r in folds}) == 1000
    for label, total in Counter(r["y"] for r in folds).items():
        sizes = Counter(r["fold"] for r in folds if r["y"] == label)
        assert len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) <= 1
        assert sum(sizes.values()) == total
    again = {r["window_id"]: r["fold"] for r in splits.stratified_kfold(rows.repartition(7), 5).collect()}
    assert again == {r["window_id"]: r["fold"] for r in folds}
    other = {r["window_id"]: r["fold"] for r in splits.stratified_kfold(rows, 5, seed=1).collect()}
    assert other != again


def test_stratified_split_shares(rows):
    counted = Counter((r["y"], r["role"]) for r in splits.stratified_split(rows).collect())
    for label in (0, 1):
        total = sum(n for (y, _), n in counted.items() if y == label)
        assert abs(counted[(label, "test")] - 0.2 * total) <= 1
        assert abs(counted[(label, "val")] - 0.1 * total) <= 1


def test_inner_split(rows):
    train, val = splits.inner_split(rows, 1000)
    assert train.count() + val.count() == 1000 and 90 <= val.count() <= 110
    same = splits.inner_split(rows, 20)
    assert same[0] is rows and same[1] is rows


def test_caps(rows):
    assert {r["subject"] for r in splits.first_subjects(rows, 2).collect()} == {0, 1}
    assert splits.random_rows(rows, 25).count() == 25
    picked = Counter(r["y"] for r in splits.per_class(rows, 30).collect())
    assert picked == {0: 30, 1: 30}


def test_undersample_keeps_every_positive(rows):
    positives = rows.where("y = 1").count()
    kept = Counter(r["y"] for r in splits.undersample(rows, 3.0).collect())
    assert kept == {1: positives, 0: 3 * positives}


def test_weighted_sample_balances_classes(rows):
    drawn = splits.weighted_sample(rows).collect()
    assert sorted(r["draw"] for r in drawn) == list(range(1000))
    share = sum(r["y"] for r in drawn) / 1000
    assert 0.42 < share < 0.58
    labels = dict(rows.select("window_id", "y").collect())
    assert all(labels[r["window_id"]] == r["y"] for r in drawn)
    assert len({r["window_id"] for r in drawn}) < 1000


def test_channel_names(spark):
    raw = ["EEG T3", "eeg f7 ", " EKG  x", "T4", "EEGT5", "T6", "EOG T5"]
    df = spark.createDataFrame([(r,) for r in raw], "c string")
    got = [r["n"] for r in df.select(normal_name("c").alias("n")).collect()]
    assert got == ["T7", "F7", "X", "T8", "EEGT5", "P8", "P7"]


def test_wearable_priority(spark):
    df = spark.createDataFrame(
        [(1, c) for c in ("F8", "CZ", "P8", "F7", "T8", "T7", "T7")] + [(2, "CZ")],
        "user_id int, channel string",
    )
    best = wearable_channels(df, 4).orderBy("priority").collect()
    assert [r["channel"] for r in best] == ["T7", "T8", "F7", "F8"]
    rows = {r["user_id"]: r for r in channel_coverage(df, ["T7", "T8"]).collect()}
    assert rows[1]["complete"] and rows[2]["skipped"] and rows[2]["n_channels"] == 0


def naive_vote(test, train, k):
    out = {}
    for key, x in test:
        near = sorted((float(np.sqrt(((x - t) ** 2).sum())), tk, y) for tk, t, y in train)[:k]
        exact = [y for d, _, y in near if d == 0]
        out[key] = np.mean(exact) if exact else sum(y / d for d, _, y in near) / sum(1 / d for d, _, y in near)
    return out


@pytest.mark.parametrize(("pivots", "block_rows", "visitors"), [(None, 4096, 16_384), (1, 7, 5), (20, 3, 4)])
def test_neighbours_equal_all_pairs(spark, pivots, block_rows, visitors, monkeypatch):
    monkeypatch.setattr(neighbours, "VISITORS", visitors)
    rng = np.random.default_rng(0)
    train = [(i, rng.normal(size=4), int(i % 3 == 0)) for i in range(60)]
    test = [(100 + i, rng.normal(size=4)) for i in range(20)] + [(200, train[5][1])]
    a = spark.createDataFrame([(k, x.tolist()) for k, x in test], "window_id bigint, x array<double>")
    b = spark.createDataFrame([(k, x.tolist(), y) for k, x, y in train], "window_id bigint, x array<double>, y int")
    got = {r["window_id"]: r["prob"] for r in neighbours.knn_vote(a, b, k=3, pivots=pivots, block_rows=block_rows).collect()}
    assert got == pytest.approx(naive_vote(test, train, 3))


def test_neighbours_of_other_subjects(spark):
    df = spark.createDataFrame(
        [(1, 0, 1, [0.0]), (2, 0, 1, [0.1]), (3, 1, 0, [5.0])],
        "window_id bigint, subject int, y int, x array<double>",
    )
    near = neighbours.nearest(df, df, k=2, apart="subject").where("window_id = 1").collect()
    assert [r["neighbour"] for r in near] == [3]


def test_ties_and_copies_are_taken_in_key_order(spark):
    """Many copies of few vectors, more than k at one distance, in many small blocks."""
    rows = [(i, i % 4, i % 2, [float(i % 5), 0.0]) for i in range(120)]
    df = spark.createDataFrame(rows, "window_id bigint, subject int, y int, x array<double>")
    got = neighbours.nearest(df, df, k=4, apart="subject", block_rows=6).collect()
    want = set()
    for key, part, _, x in rows:
        near = sorted((abs(x[0] - v[0]), k) for k, p, _, v in rows if p != part)[:4]
        want |= {(key, k, i + 1) for i, (_, k) in enumerate(near)}
    assert {(r["window_id"], r["neighbour"], r["rank"]) for r in got} == want


def test_far_cells_are_not_met(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(0, 100, (12, 6))
    rows = [(i, (centre[i % 12] + rng.normal(size=6)).tolist(), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "window_id bigint, x array<double>, y int")
    report: dict = {}
    got = neighbours.nearest(df, df, k=3, pivots=24, report=report)
    near = {(r["window_id"], r["neighbour"]) for r in got.collect()}
    x = np.array([r[1] for r in rows])
    dist = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert near == {(i, int(j)) for i in range(600) for j in np.argsort(dist[i], kind="stable")[:3]}
    assert report["all"] == 360_000 and report["pairs"] < 0.5 * report["all"]


@pytest.mark.parametrize(("pivots", "block_rows"), [(5, 3), (12, 40)])
def test_a_test_row_travels_once_to_a_unit(spark, pivots, block_rows, monkeypatch):
    """However small the blocks; results are those of all pairs, with ties, copies and far values."""
    for name, value in (("UNIT_ROWS", 32), ("LEAST_ROWS", 16), ("VISITORS", 50), ("CELLS", 64)):
        monkeypatch.setattr(neighbours, name, value)
    paths = {}
    fresh = neighbours.shared_folder
    monkeypatch.setattr(neighbours, "shared_folder", lambda s, p: paths.setdefault((p, len(paths)), fresh(s, p)))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, 6)).round(1) + 1e4
    x[40:80] = x[3]
    rows = [(i, i % 3, i % 2, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "window_id bigint, subject int, y int, x array<double>")
    got = neighbours.nearest(df, df, k=3, apart="subject", pivots=pivots, block_rows=block_rows).collect()
    want = set()
    for i in range(160):
        near = sorted((((x[i] - x[j]) ** 2).sum(), j) for j in range(160) if j % 3 != i % 3)[:3]
        want |= {(i, j, r + 1) for r, (_, j) in enumerate(near)}
    found = {(r["window_id"], r["neighbour"], r["rank"]) for r in got}
    assert found == want
    for (purpose, _), path in paths.items():
        if purpose == "visits":
            visits = spark.read.parquet(path)
            assert visits.count() == visits.select("id", "unit").distinct().count()


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, 0, [1.0])], "window_id bigint, y int, x array<double>")
    got = neighbours.knn_vote(df, df.limit(0), k=3).collect()
    assert len(got) == 1 and got[0]["prob"] is None


def test_hash_is_spread(spark):
    from paroxys.functions.hashing import uniform

    row = spark.range(20_000).select(uniform("id").alias("u")).agg(
        F.avg("u").alias("m"), F.min("u").alias("lo"), F.max("u").alias("hi"), F.stddev("u").alias("s")
    ).first()
    assert abs(row["m"] - 0.5) < 0.01 and abs(row["s"] - 0.2887) < 0.01
    assert 0 <= row["lo"] and row["hi"] < 1


def test_draws_of_different_seeds_and_lags_are_independent(spark):
    from paroxys.functions.hashing import uniform

    rows = spark.range(40_000).select(
        *[uniform("id", s).alias(f"s{s}") for s in (1, 2, 3)], *[uniform(F.col("id") + d, 1).alias(f"l{d}") for d in (1, 2, 1000)]
    )
    names = rows.columns
    found = rows.agg(*[F.corr(a, b).alias(f"{a}{b}") for i, a in enumerate(names) for b in names[:i]]).first()
    assert max(abs(v) for v in found) < 0.02
    assert spark.range(1).select(uniform(F.lit("text key"), 1)).first()[0] < 1


def test_neighbours_on_stored_plain_tables(spark, tmp_path):
    rows = [(i, i % 3, i % 2, [float(i), float(i * i % 7)]) for i in range(30)]
    path = str(tmp_path / "plain")
    spark.createDataFrame(rows, "window_id bigint, subject int, y int, x array<double>").write.parquet(path)
    stored = spark.read.parquet(path)
    got = neighbours.knn_vote(stored, stored, keep=["y"], k=1, pivots=4, block_rows=4).collect()
    assert len(got) == 30 and all(r["pred"] == r["y"] for r in got)


def test_every_row_is_answered_and_bad_vectors_fail(spark):
    schema = "window_id bigint, subject int, y int, x array<double>"
    one = spark.createDataFrame([(i, 7, 1, [float(i)]) for i in range(10)], schema)
    got = neighbours.knn_vote(one, one, k=3, apart="subject").collect()
    assert len(got) == 10 and all(r["prob"] is None and r["pred"] is None for r in got)
    bad = spark.createDataFrame([(1, 1, 1, [float("nan")])], schema)
    with pytest.raises(Exception, match="finite"):
        neighbours.knn_vote(bad, one).collect()


def test_selection_moves_no_arrays(spark):
    """Only hashes and keys are exchanged to find the cuts; rows are filtered where they are."""
    rows = spark.createDataFrame([(i, i % 3, [float(i)]) for i in range(500)], "window_id bigint, y int, x array<double>")
    for df in (
        splits.random_rows(rows, 100),
        splits.per_class(rows, 30),
        splits.undersample(rows, 0.5),
        splits.stratified_split(rows),
    ):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ranges", [1, 7, 4096])
def test_cuts_are_exact_in_any_ranges(spark, ranges, monkeypatch):
    from paroxys.functions.hashing import replayable_key

    monkeypatch.setattr(splits, "RANGES", ranges)
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(300)], "window_id bigint, y int")
    order = {}
    for r in rows.withColumn("h", replayable_key("window_id")).orderBy("h", "window_id").collect():
        order.setdefault(r["y"], []).append(r["window_id"])
    for n in (0, 1, 17, 59, 1000):
        got = {r["window_id"] for r in splits.per_class(rows, n).collect()}
        assert got == {i for ids in order.values() for i in ids[:n]}
    assert splits.random_rows(rows, 0).count() == 0 and splits.random_rows(rows.limit(0), 5).count() == 0
