"""Streams over several micro-batches give the batch results."""

import pytest
from pyspark.sql import functions as F

from paroxys.operators import alarms
from paroxys.streaming import online

SCHEMA = "user_id bigint, ts timestamp, event_id bigint, prob double, pred int, value double"


@pytest.fixture(scope="module")
def folder(spark, sequences, tmp_path_factory):
    """The sequences as three files that follow each other in time."""
    import os

    path = str(tmp_path_factory.mktemp("stream"))
    rows = sequences.select(
        "user_id",
        F.timestamp_seconds(F.col("k") * 2).alias("ts"),
        F.col("k").alias("event_id"),
        "prob",
        "pred",
        F.col("prob").alias("value"),
    )
    for n, (low, high) in enumerate(((0, 40), (40, 200), (200, 10_000))):
        part = rows.where((F.col("event_id") >= low) & (F.col("event_id") < high))
        part.coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            if name.startswith("part-"):
                os.rename(f"{path}/{name}", f"{path}/batch{n}.parquet")
                os.utime(f"{path}/batch{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return path


@pytest.fixture
def stream(spark, folder):
    size = 1  # one file per micro-batch
    return online.read_events(spark, folder, "batch*.parquet", SCHEMA, size)


def table(df, column):
    return {(r["user_id"], r["k"]): r[column] for r in df.collect()}


ORDER = online.Ordering(late=10, slot=4, idle=60)
PATIENT = online.Ordering(late=86_400, slot=10, idle=60)


def ordered(rows, operator, order=ORDER, **options):
    return online.run_ordered(rows, lambda r: operator(r, order=order), "ordered", order=order, **options)


def test_ema_continues_across_batches(stream, sequences):
    got, late = ordered(stream, online.online_ema)
    assert table(got, "ema") == pytest.approx(table(alarms.ema_smooth(sequences), "ema"))
    assert late.count() == 0


@pytest.mark.parametrize(("n", "k"), [(5, 3), (3, 2), (4, 2)])
def test_vote_equals_batch_to_the_last_window(stream, sequences, n, k):
    got, _ = ordered(stream, lambda r, order: online.online_vote(r, n, k, order=order))
    assert table(got, "pred") == table(alarms.majority_vote(sequences, n, k), "pred")


def test_alarm_after_consecutive_detections(stream, sequences):
    got, _ = ordered(stream, lambda r, order: online.online_alarm(r, 3, order=order))
    preds = table(sequences, "pred")
    want = {(u, k): int(all(preds.get((u, k - j)) == 1 for j in range(3))) for u, k in preds}
    assert table(got, "alarm") == want


def test_nothing_is_answered_before_the_watermark(stream, sequences):
    """Without a closing row the slots behind the last watermark stay open."""
    got, late = ordered(stream, online.online_ema, finish=False)
    rows = table(got, "ema")
    last = max(k for _, k in rows)
    # Two seconds a window; the watermark is ten seconds back, slots are four seconds long.
    assert 399 - 10 <= last < 399 - 4
    assert len(rows) == sum(1 for r in sequences.collect() if r["k"] <= last) and late.count() == 0


def test_a_silent_recording_is_closed_and_goes_on_as_a_new_stretch(spark, tmp_path):
    """Idle for longer than allowed: open windows are answered, later ones vote among themselves."""
    import os

    rows = [(1, k * 2, 1) for k in range(6)] + [(1, 500 + k * 2, 0) for k in range(2)] + [(2, 900, 1)]
    folder = str(tmp_path / "in")
    for n, (low, high) in enumerate(((0, 100), (850, 1000), (100, 850))):
        own = [(u, t, p, t) for u, t, p in rows if low <= t < high]
        frame = spark.createDataFrame(own, "user_id bigint, t int, pred int, event_id bigint")
        frame = frame.select("user_id", F.timestamp_seconds("t").alias("ts"), "event_id", "pred")
        frame.coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.startswith("part-"):
                os.rename(f"{folder}/{name}", f"{folder}/batch{n}.parquet")
                os.utime(f"{folder}/batch{n}.parquet", (1_700_000_000 + n,) * 2)
    events = online.read_events(spark, folder, "batch*.parquet", "user_id bigint, ts timestamp, event_id bigint, pred int", 1)
    got, late = ordered(events, lambda r, order: online.online_vote(r, 3, 2, order=order))
    assert table(got, "pred") == {**{(1, k): 1 for k in range(6)}, (1, 6): 0, (1, 7): 0, (2, 0): 1}
    assert late.count() == 0


def test_closed_windows_equal_batch(spark, stream, folder):
    got = online.run_available(online.window_stats(stream), "windows")
    batch = spark.read.schema(SCHEMA).parquet(folder)
    whole = (
        batch.groupBy("user_id", F.window("ts", "4 seconds", "1 second").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
        .select("user_id", F.col("w.start").cast("timestamp_ntz").alias("w_start"), F.col("w.end").alias("e"), "n", "mean")
    )
    limit = batch.agg(F.max("ts") - F.expr("interval 10 seconds")).first()[0]
    want = {(r["user_id"], r["w_start"]): r["n"] for r in whole.where(F.col("e") <= F.lit(limit)).collect()}
    assert {(r["user_id"], r["w_start"]): r["n"] for r in got.collect()} == want


@pytest.fixture(scope="module")
def backwards(spark, folder, tmp_path_factory):
    """The same files, newest first."""
    import os
    import shutil

    path = str(tmp_path_factory.mktemp("backwards"))
    for n in range(3):
        shutil.copy(f"{folder}/batch{n}.parquet", path)
        os.utime(f"{path}/batch{n}.parquet", (1_700_000_000 - n, 1_700_000_000 - n))
    return online.read_events(spark, path, "batch*.parquet", SCHEMA, 1)


def test_files_in_reverse_order_equal_batch(backwards, sequences):
    got, late = ordered(backwards, online.online_ema, PATIENT)
    assert table(got, "ema") == pytest.approx(table(alarms.ema_smooth(sequences), "ema"))
    got, more = ordered(backwards, lambda r, order: online.online_vote(r, 5, 3, order=order), PATIENT)
    assert table(got, "pred") == table(alarms.majority_vote(sequences, 5, 3), "pred")
    assert late.count() == more.count() == 0


def test_late_rows_are_kept_apart(backwards, sequences):
    """Without patience the oldest file comes too late for all that was answered before."""
    got, late = ordered(backwards, online.online_ema)
    lost = {(r["user_id"], r["event_id"]) for r in late.collect()}
    everything = {(r["user_id"], r["k"]) for r in sequences.collect()}
    assert lost and got.count() + len(lost) == len(everything)
    assert lost == {(u, k) for u, k in everything if u == 1 and k < 40}


def test_windows_of_late_files(spark, backwards, folder):
    """Rows in are rows windowed and rows late; the windows are those of the rows kept."""
    closed, rows, late = online.run_windows(backwards, "late-windows", order=ORDER)
    every = spark.read.schema(SCHEMA).parquet(folder)
    assert rows.count() + late.count() == every.count() and late.count() > 0
    kept = every.join(late.select("user_id", "event_id"), ["user_id", "event_id"], "left_anti")
    want = kept.groupBy("user_id", F.window("ts", "4 seconds", "1 second").alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    limit = kept.agg(F.max("ts") - F.expr("interval 10 seconds")).first()[0]
    want = want.where(F.col("w.end") <= F.lit(limit)).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("s"), "n", "m")
    assert {(r[0], r[1]): (r[2], pytest.approx(r[3])) for r in want.collect()} == {
        (r["user_id"], r["w_start"]): (r["n"], r["mean"]) for r in closed.collect()
    }


def test_late_rows_are_counted_over_all_batches(spark, backwards):
    """Also those of micro-batches whose reports are no longer held."""
    name = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        with pytest.raises(online.LateRows):
            online.run_available(online.window_stats(backwards), "windows-reports")
    finally:
        spark.conf.set(name, before)


def test_late_rows_are_not_lost_silently(backwards):
    windows = online.window_stats(backwards)
    with pytest.raises(online.LateRows):
        online.run_available(windows, "windows-backwards")
    patient = online.window_stats(backwards, late="1 day")
    assert online.run_available(patient, "windows-patient").count() == 0


def test_a_second_run_in_the_same_folder_goes_on(stream, sequences, tmp_path):
    folder = str(tmp_path / "run")
    first, _ = ordered(stream, online.online_ema, folder=folder, finish=False)
    some = first.count()
    again, late = ordered(stream, online.online_ema, folder=folder)
    assert some < again.count() == sequences.count() and late.count() == 0
    assert table(again, "ema") == pytest.approx(table(alarms.ema_smooth(sequences), "ema"))


def test_state_calls_follow_micro_batches_not_slots():
    """Rows of thirty slots wait as one entry behind one timer."""
    from unittest.mock import MagicMock

    import pandas as pd

    handle = MagicMock()
    handle.getValueState.return_value.get.return_value = None
    processor = online.OnlineEma(0.3, 0.5, "user_id", online.Ordering(late=1.0, slot=1.0))
    processor.init(handle)
    rows = pd.DataFrame({"at": [s * 1_000_000 for s in range(29, -1, -1)], "event_id": range(30), "value": 0.5, online.FLUSH: False})
    assert list(processor.handleInputRows((1,), iter([rows]), None)) == []
    handle.registerTimer.assert_called_once_with(1000)
    assert handle.getListState.return_value.appendList.call_count == 1
