import numpy as np
import pytest
from pyspark.sql import functions as F

from paroxys.operators import alarms, metrics


def frame(spark, preds, ys=None, probs=None):
    ys = ys or [0] * len(preds)
    probs = probs or [float(p) for p in preds]
    rows = [(1, k, y, float(q), p) for k, (p, y, q) in enumerate(zip(preds, ys, probs))]
    return spark.createDataFrame(rows, "user_id bigint, k bigint, y int, prob double, pred int")


def column(df, name="pred"):
    return [r[name] for r in df.orderBy("k").collect()]


def per_user(df, name):
    out = {}
    for r in df.select("user_id", "k", name).orderBy("user_id", "k").collect():
        out.setdefault(r["user_id"], []).append(r[name])
    return out


@pytest.mark.parametrize(
    "preds,n,k,want",
    [
        ([0, 0, 1, 0, 0], 3, 2, [0, 0, 0, 0, 0]),
        ([0, 1, 1, 1, 0], 3, 2, [0, 1, 1, 1, 0]),
        ([1, 0], 5, 2, [1, 0]),
        ([0, 1, 0, 1, 1, 0], 3, 2, [0, 0, 1, 1, 1, 0]),
    ],
)
@pytest.mark.parametrize("size", [5, 1 << 16])
def test_majority_vote(spark, preds, n, k, want, size):
    assert column(alarms.majority_vote(frame(spark, preds), n, k, size=size)) == want


@pytest.mark.parametrize(
    "preds,collar,want",
    [
        ([1, 1, 0, 0, 1, 1], 3, [1] * 6),
        ([1, 0, 0, 0, 0, 1], 2, [1, 0, 0, 0, 0, 1]),
        ([0, 0, 1, 0, 0], 3, [0, 0, 1, 0, 0]),
        ([0, 0, 0], 3, [0, 0, 0]),
    ],
)
@pytest.mark.parametrize("size", [3, 1 << 16])
def test_collar_merge(spark, preds, collar, want, size):
    assert column(alarms.collar_merge(frame(spark, preds), collar, size=size)) == want


@pytest.mark.parametrize("n,k,collar", [(41, 20, 20), (7, 4, 5)])
@pytest.mark.parametrize("size", [64, 1 << 16])
def test_wide_vote_and_collar(spark, sequences, n, k, collar, size):
    preds = per_user(sequences, "pred")
    voted = per_user(alarms.majority_vote(sequences, n, k, size=size), "pred")
    merged = per_user(alarms.collar_merge(sequences, collar, size=size), "pred")
    for user, p in preds.items():
        half = n // 2
        want = [int(sum(p[max(i - half, 0) : i + half + 1]) >= k) for i in range(len(p))]
        assert voted[user] == (want if len(p) >= n else p)
        runs, filled = naive_runs(p), list(p)
        for (_, a), (b, _) in zip(runs, runs[1:]):
            if b - a - 1 <= collar:
                filled[a:b] = [1] * (b - a)
        assert merged[user] == filled


def test_collar_zero_changes_nothing(spark):
    assert column(alarms.collar_merge(frame(spark, [1, 0, 1]), 0)) == [1, 0, 1]


def test_ema_of_one_follows_the_scores(spark):
    df = frame(spark, [0] * 5, probs=[0, 0, 0.8, 0, 0])
    assert column(alarms.ema_smooth(df, 1.0, 0.5), "ema_pred") == [0, 0, 1, 0, 0]


def test_ema_rejects_bad_alpha(spark):
    with pytest.raises(ValueError):
        alarms.ema_smooth(frame(spark, [0]), 0.0)


@pytest.mark.parametrize("alpha,size", [(0.3, 130), (0.9, 20), (0.05, 1 << 16)])
def test_ema_in_chunks_equals_recursion(spark, sequences, alpha, size):
    got = per_user(alarms.ema_smooth(sequences, alpha, size=size), "ema")
    for user, probs in per_user(sequences, "prob").items():
        value, want = probs[0], [probs[0]]
        for p in probs[1:]:
            value = alpha * p + (1 - alpha) * value
            want.append(value)
        np.testing.assert_allclose(got[user], want, rtol=0, atol=1e-14)


def test_runs(spark):
    runs = alarms.alarm_runs(frame(spark, [1, 0, 0, 1, 1]), size=2).orderBy("start_k").collect()
    assert [(r["start_k"], r["end_k"]) for r in runs] == [(0, 0), (3, 4)]


def naive_runs(values):
    runs, start = [], None
    for i, v in enumerate([*values, 0]):
        if v and start is None:
            start = i
        if not v and start is not None:
            runs.append((start, i - 1))
            start = None
    return runs


def naive_events(ys, preds, credit):
    trues, hits, false = naive_runs(ys), set(), 0
    for a, b in naive_runs(preds):
        met = [i for i, (c, d) in enumerate(trues) if a <= d and b >= c]
        false += not met
        hits.update(met[:1] if credit == "first" else met)
    return len(hits), len(trues), false


@pytest.mark.parametrize("credit", ["first", "any"])
@pytest.mark.parametrize("size", [7, 1 << 16])
def test_event_metrics_against_pairs(spark, sequences, credit, size):
    got = {
        r["user_id"]: r
        for r in alarms.event_metrics(sequences, 1.0, credit, size=size).collect()
    }
    ys, preds = per_user(sequences, "y"), per_user(sequences, "pred")
    for user, row in got.items():
        want = naive_events(ys[user], preds[user], credit)
        assert (row["n_detected"], row["n_seizures"], row["n_false_alarms"]) == want
        assert row["hours"] == pytest.approx(len(ys[user]) / 3600)


def test_event_metrics_exact(spark):
    row = alarms.event_metrics(
        frame(spark, [1, 0, 0, 0, 0, 1], [1, 1, 0, 0, 1, 1]), by=()
    ).first()
    assert (row["n_detected"], row["n_seizures"]) == (2, 2)
    hours = frame(spark, [0, 0, 0, 1, 0], [0, 0, 0, 0, 0])
    assert alarms.event_metrics(hours, 3600.0, by=()).first()["fp_per_hour"] == 0.2


def test_event_metrics_rejects_unknown_credit(spark, sequences):
    with pytest.raises(ValueError):
        alarms.event_metrics(sequences, credit="some")


@pytest.mark.parametrize("size", [11, 1 << 16])
def test_chunking_does_not_change_alarms(spark, sequences, size):
    plain = alarms.collar_merge(alarms.majority_vote(sequences))
    fused = alarms.vote_and_merge(sequences, size=size)
    assert per_user(fused, "pred") == per_user(plain, "pred")
    only_vote = alarms.vote_and_merge(sequences, merge=False, size=size)
    assert per_user(only_vote, "pred") == per_user(alarms.majority_vote(sequences), "pred")


@pytest.mark.parametrize("n,k,collar", [(3, 2, 3), (5, 3, 0), (3, 1, 2)])
@pytest.mark.parametrize("size", [9, 1 << 16])
def test_vote_level_equals_a_run_per_threshold(spark, sequences, n, k, collar, size):
    grid = metrics.even_thresholds(11)
    level = alarms.vote_level(sequences, n, k, collar, size=size)
    swept = metrics.threshold_sweep(level, grid, level="level")

    def post(df, group):
        return alarms.vote_and_merge(df, n, k, collar, group=group, size=size)

    cut = alarms.per_threshold(sequences, grid, post)
    naive = metrics.segment_metrics(cut, ["threshold"])
    columns = ["threshold", "tp", "tn", "fp", "fn"]
    key = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert key(swept) == key(naive)
    assert len(key(swept)) == 11


def test_sequences_have_several_chunks(sequences):
    assert sequences.agg(F.max("k")).first()[0] > 100
