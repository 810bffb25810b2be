import numpy as np
import pytest

from paroxys.operators import labels

HOUR = 3600.0


def windows(spark, starts, user=1):
    return spark.createDataFrame(
        [(user, i, float(s)) for i, s in enumerate(starts)],
        "user_id bigint, window_id bigint, start_sec double",
    )


def seizures(spark, spans, user=1):
    return spark.createDataFrame(
        [(user, float(a), float(b)) for a, b in spans],
        "user_id bigint, onset_sec double, offset_sec double",
    )


def ys(df):
    return [r["y"] for r in df.orderBy("window_id").collect()]


@pytest.mark.parametrize("onset,want", [(2.8, 0), (2.0, 1)])
def test_detection_share(spark, onset, want):
    got = labels.label_detection(windows(spark, [0]), seizures(spark, [(onset, 10)]), 4.0, 0.5)
    assert ys(got) == [want]


@pytest.mark.parametrize(
    "spans,start,want",
    [
        ([(1000, 1030)], 700, 1),
        ([(1000, 1030)], 950, -1),
        ([(100, 130)], 100, -1),
        ([(100, 130)], 140, -1),
        ([(1000, 1030)], 100, 0),
    ],
)
def test_prediction_zones(spark, spans, start, want):
    got = labels.label_prediction(
        windows(spark, [start]), seizures(spark, spans), 4.0, 300.0, 60.0, 120.0
    )
    assert ys(got) == [want]


def naive_prediction(starts, spans, win, sop, sph, gap):
    out = []
    for s in starts:
        e = s + win
        bad = any(
            (s < b and e > a) or (s < a and e > a - sph) or (s < b + gap and e > b)
            for a, b in spans
        )
        good = any(s >= a - sph - sop and e <= a - sph for a, _ in spans)
        out.append(-1 if bad else int(good))
    return out


def naive_detection(starts, spans, win, share):
    return [
        int(any(max(0.0, min(s + win, b) - max(s, a)) / win >= share for a, b in spans))
        for s in starts
    ]


@pytest.mark.parametrize("chunk_sec", [64.0, 86_400.0])
@pytest.mark.parametrize("seed", [0, 1])
def test_against_all_pairs(spark, chunk_sec, seed):
    """Overlapping, nested and touching seizures on a grid where bounds coincide."""
    rng = np.random.default_rng(seed)
    starts = np.arange(0, 3000, 2).astype(float)
    onsets = rng.integers(0, 3000, 12) * 1.0
    spans = [(a, a + float(d)) for a, d in zip(onsets, rng.integers(0, 40, 12))]
    wins, seiz = windows(spark, starts), seizures(spark, spans)
    got = labels.label_prediction(wins, seiz, 4.0, 128.0, 32.0, 64.0, chunk_sec=chunk_sec)
    assert ys(got) == naive_prediction(starts, spans, 4.0, 128.0, 32.0, 64.0)
    got = labels.label_detection(wins, seiz, 4.0, 0.25, chunk_sec=chunk_sec)
    assert ys(got) == naive_detection(starts, spans, 4.0, 0.25)


def test_recordings_do_not_mix(spark):
    wins = windows(spark, [0.0], 1).unionByName(windows(spark, [0.0], 2))
    got = labels.label_detection(wins, seizures(spark, [(0, 10)], 1), 4.0)
    assert {(r["user_id"], r["y"]) for r in got.collect()} == {(1, 1), (2, 0)}


def test_periods_share_one_scan(spark):
    starts = np.arange(0, 1200, 4).astype(float)
    wins, seiz = windows(spark, starts), seizures(spark, [(1000, 1030)])
    both = labels.label_prediction(wins, seiz, 4.0, {"a": 300.0, "b": 600.0}, 60.0, 120.0)
    rows = both.orderBy("window_id").collect()
    for name, sop in (("a", 300.0), ("b", 600.0)):
        assert [r[name] for r in rows] == naive_prediction(starts, [(1000, 1030)], 4.0, sop, 60.0, 120.0)


def test_modes(spark):
    wins, seiz = windows(spark, [0.0, 100.0]), seizures(spark, [(100, 130)])
    kept = labels.label_windows(
        wins, seiz, "prediction", 4.0, sop_sec=60.0, sph_sec=10.0, postictal_sec=10.0
    )
    assert ys(kept) == [0]
    assert labels.label_windows(wins, seiz, "detection", 4.0).count() == 2
    with pytest.raises(ValueError):
        labels.label_windows(wins, seiz, "other", 4.0)


def test_detection_needs_a_share(spark):
    with pytest.raises(ValueError):
        labels.label_detection(windows(spark, [0]), seizures(spark, []), 4.0, -0.1)


def test_merge_labels(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "w int, y int")
    b = spark.createDataFrame([(1, 1), (2, 1)], "w int, y int")
    rows = labels.merge_labels({"y5": a, "y10": b}, ["w"]).orderBy("w").collect()
    assert [(r["y5"], r["y10"]) for r in rows] == [(0, 1), (1, 1)]


def test_merge_labels_refuses_other_windows(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "w int, y int")
    b = spark.createDataFrame([(1, 1)], "w int, y int")
    with pytest.raises(Exception, match="different windows"):
        labels.merge_labels({"y5": a, "y10": b}, ["w"]).collect()


def test_detection_at_fraction_zero_marks_the_recording(spark):
    spots = spark.createDataFrame([(1, 0.0), (1, 4.0), (2, 0.0)], "user_id bigint, start_sec double")
    seizures = spark.createDataFrame([(1, 100.0, 110.0), (1, 200.0, 201.0)], "user_id bigint, onset_sec double, offset_sec double")
    got = labels.label_detection(spots, seizures, 4.0, 0.0).collect()
    assert sorted((r["user_id"], r["y"]) for r in got) == [(1, 1), (1, 1), (2, 0)]
