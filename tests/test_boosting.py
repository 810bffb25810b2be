"""Boosted trees against a plain restatement that grows one fold at a time."""

from dataclasses import replace

import numpy as np
import pytest

from paroxys.plans import boosting
from paroxys.plans.boosting import Boosting

FOLDS = [0, 1, 2]
WEIGHTS = [(1.0, 3.0), (1.0, 2.5), (0.7, 2.0)]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 7)).round(2)
    x[:, 3] = rng.integers(0, 3, 300)  # ties
    subject = np.arange(300) % 4
    y = ((x[:, 0] + x[:, 3] * x[:, 1] + rng.normal(0, 0.5, 300)) > 1.2).astype(int)
    return x, subject, y


@pytest.fixture(scope="module")
def features(spark, data):
    x, subject, y = data
    rows = [(i, int(s), int(t), list(map(float, v))) for i, (v, s, t) in enumerate(zip(x, subject, y))]
    return spark.createDataFrame(rows, "window_id bigint, subject int, y int, features array<double>").repartition(4)


def split(bins, g, h, rows, p):
    """The best (gain, feature, bin) of some rows, by trying every cut."""
    best = None
    for f in range(bins.shape[1]):
        for b in range(p.bins - 1):
            left = rows[bins[rows, f] <= b]
            right = rows[bins[rows, f] > b]
            if min(len(left), len(right)) < p.min_rows or min(h[left].sum(), h[right].sum()) < p.min_weight or not len(left):
                continue
            score = lambda at: g[at].sum() ** 2 / (h[at].sum() + p.l2)
            gain = score(left) + score(right) - score(rows)
            if gain > boosting.MIN_GAIN and (best is None or gain > best[0] + boosting.EQUAL_GAIN):
                best = (gain, f, b, left, right)
    return best


def leaf_values(bins, g, h, use, p):
    """What one tree adds to every row."""
    leaves = [(np.flatnonzero(use), np.arange(len(bins)), 0)]
    looked = {}
    splits = 0
    while p.leaves is None or splits < p.leaves - 1:
        options = []
        for i, (rows, _, depth) in enumerate(leaves):
            if p.depth is not None and depth >= p.depth:
                continue
            key = tuple(rows)
            if key not in looked:
                looked[key] = split(bins, g, h, rows, p)
            if looked[key]:
                options.append((-looked[key][0], i))
        if not options:
            break
        i = min(options)[1]
        rows, all_rows, depth = leaves.pop(i)
        _, f, b, left, right = looked[tuple(rows)]
        go = bins[all_rows, f] <= b
        leaves += [(left, all_rows[go], depth + 1), (right, all_rows[~go], depth + 1)]
        splits += 1
    out = np.zeros(len(bins))
    for rows, all_rows, _ in leaves:
        out[all_rows] = -p.rate * g[rows].sum() / (h[rows].sum() + p.l2)
    return out


def plain_margins(data, cuts, p):
    x, subject, y = data
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    out = []
    for fold, (w0, w1) in zip(FOLDS, WEIGHTS):
        margin = np.zeros(len(x))
        for _ in range(p.rounds):
            chance = 1 / (1 + np.exp(-margin))
            w = np.where(y == 1, w1, w0)
            margin = margin + leaf_values(bins, w * (chance - y), w * chance * (1 - chance), subject != fold, p)
        out.append(margin)
    return np.stack(out, axis=1)


@pytest.mark.parametrize("local", [0, 60, 4096])
@pytest.mark.parametrize(
    "params",
    [Boosting(rounds=3, depth=4, bins=8), Boosting(rounds=2, depth=None, leaves=7, bins=8, l2=0.0, min_weight=1e-3, min_rows=9)],
    ids=["by level", "by leaf"],
)
def test_trees_are_those_of_plain_growth(features, data, params, local, monkeypatch):
    """Whether leaves are summed over all tasks or finished in one."""
    monkeypatch.setattr(boosting, "LOCAL_ROWS", local)
    monkeypatch.setattr(boosting, "STORED", 2)
    monkeypatch.setattr(boosting, "BLOCK", 3)
    monkeypatch.setattr(boosting, "TASK_ROWS", 100)
    margins, trees, cuts = boosting.boost(features, FOLDS, WEIGHTS, params)
    assert len(trees) == params.rounds
    got = np.array([r["margins"] for r in margins.orderBy("key").collect()])
    assert np.allclose(got, plain_margins(data, cuts, params), atol=1e-9)


@pytest.mark.parametrize("params", [Boosting(rounds=4, depth=3, rows=0.8, columns=0.8, bins=16), Boosting(rounds=3, depth=None, leaves=6, bins=8)])
def test_folds_in_one_task_each_need_few_jobs(spark, features, params, monkeypatch):
    """Trees of a table of moderate size are those of a job per level, from a fixed number of jobs."""

    def boost(name, params=params):
        spark.sparkContext.setJobGroup(name, name)
        rows = boosting.boost(features, FOLDS, WEIGHTS, params)[0].orderBy("key").collect()
        spark.sparkContext.setJobGroup("", "")
        return np.array([r["margins"] for r in rows]), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    monkeypatch.setattr(boosting, "LOCAL_ROWS", 60)
    whole, jobs = boost("whole")
    assert boost("more", replace(params, rounds=2 * params.rounds))[1] == jobs
    monkeypatch.setattr(boosting, "WHOLE_LEAVES", 0)
    levels, _ = boost("levels")
    assert np.allclose(whole, levels, atol=1e-9)


def test_a_fold_does_not_see_its_own_rows(spark, features):
    """Other labels in the held-out rows leave their scores alone."""
    from pyspark.sql import functions as F

    params = Boosting(rounds=4, depth=3, rows=0.8, columns=0.8, bins=16)
    turned = features.withColumn("y", F.when(F.col("subject") == 1, 1 - F.col("y")).otherwise(F.col("y")))
    scores = [
        boosting.held_out_scores(boosting.boost(t, [1], [(1.0, 2.0)], params)[0], [1]).orderBy("window_id").collect()
        for t in (features, turned)
    ]
    assert [r["prob"] for r in scores[0]] == [r["prob"] for r in scores[1]]
    assert len(scores[0]) == 75 and {r["fold"] for r in scores[0]} == {1}


def test_drawn_shares_are_repeatable_and_independent():
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    first, again, other = (boosting.drawn(hashes, 0.8, n) for n in (3, 3, 4))
    assert (first == again).all()
    assert abs(first.mean() - 0.8) < 0.01 and abs((first & other).mean() - 0.64) < 0.01
    assert boosting.drawn(hashes, 1.0, 1).all()


def test_held_out_rows_are_ranked_well(features):
    from paroxys.plans import models

    scores = models.loso_scores(features.where("subject < 3"), ["xgboost"], {"xgboost": {"rounds": 30}})
    rows = models.fold_metrics(scores).collect()
    assert len(rows) == 3 and np.mean([r["auc_roc"] for r in rows]) > 0.85


def table_of(n, features, bins=64, seed=5):
    rng = np.random.default_rng(seed)
    table = boosting.Bins(rng.integers(0, bins, (n, features)).astype(np.uint8), bins)
    return table, rng.normal(size=n), rng.random(n), rng


@pytest.mark.parametrize("counted", [True, False])
def test_sums_of_two_features_at_once_are_those_of_each(counted, monkeypatch):
    """Joint bins of a pair, an odd last feature and few rows give plain sums by feature and bin."""
    table, g, h, rng = table_of(3000, 9, 8)
    features = np.array([0, 2, 3, 5, 8])
    for rows in (np.arange(3000), np.sort(rng.permutation(3000)[:1100])):
        plain = [
            [np.bincount(table.by_row[rows, f], w, 8) for f in features] for w in (g[rows], h[rows], np.ones(len(rows)))
        ]
        for paired in (0, 10**6):
            monkeypatch.setattr(boosting, "PAIRED", paired)
            got = table.sums(rows, g + 1j * h, features, counted)
            assert np.allclose(got, plain if counted else plain[:2], atol=1e-9)


@pytest.mark.parametrize(
    "params", [Boosting(depth=4, rows=0.8), Boosting(depth=None, leaves=16, l2=0.0, min_weight=1e-3, min_rows=20)], ids=["by level", "by leaf"]
)
def test_a_tree_takes_few_bytes_per_row_and_feature(params):
    """Cells of all rows and features as whole numbers, with their weights, took 24 bytes and the time to fill them."""
    import tracemalloc

    n, features = 20_000, 60
    table, g, h, rng = table_of(n, features)
    used = np.flatnonzero(rng.random(n) < params.rows)
    tracemalloc.start()
    found = boosting.grow_leaf(table, used, g, h, 0, np.arange(features), params)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) > 15 and found[0][-1] == len(used)
    assert peak < 8 * n * features


def test_left_rows_are_counted_where_bins_are_not():
    """Without counts by bin, the rows of a split's left side still are those below the cut."""
    table, g, h, _ = table_of(500, 4, 8)
    params = Boosting(depth=2, bins=8)
    place, child, gain, feature, cut, _, _, left, _, _, n = boosting.grow_leaf(table, np.arange(500), g, h, 0, np.arange(4), params)[0]
    assert gain > boosting.MIN_GAIN and n == 500 and left == (table.by_row[:, feature] <= cut).sum()
