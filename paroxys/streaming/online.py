"""The window, smoothing and alarm operators on unbounded event streams.

Ordered operators buffer rows by event time. A row waits in its recording's state, in
the time slot it belongs to, until the watermark has passed the slot; a timer then hands
the slot's rows to the operator in time order. Files may so arrive in any order within
the allowed lateness. A row whose slot has been answered is late: it is kept, marked, in
the same output table as the results, so that rows in are rows answered and rows late.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from paroxys.session import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def read_events(
    spark: SparkSession, folder: str, pattern: str, schema: str, max_bytes: int = 1 << 28
) -> DataFrame:
    """Stream of the Parquet files matching ``pattern``.

    ``max_bytes`` bounds a micro-batch, and with it what one recording can bring to a
    task at a time. Event time becomes a TIMESTAMP, which watermarks need.
    """
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxBytesPerTrigger", max_bytes)
        .parquet(folder)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def window_stats(
    events: DataFrame,
    length: str = "4 seconds",
    slide: str = "1 second",
    late: str = "10 seconds",
    by: str = "user_id",
    value: str = "value",
) -> DataFrame:
    """Statistics of sliding event-time windows per recording.

    Windows are closed, and their state freed, once the watermark passes their end.
    """
    return (
        events.withWatermark("ts", late)
        .groupBy(by, F.window("ts", length, slide).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("mean"),
            F.stddev_pop(value).alias("std"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
        )
        .select(
            by,
            F.col("w.start").cast("timestamp_ntz").alias("w_start"),
            F.col("w.end").cast("timestamp_ntz").alias("w_end"),
            "n",
            "mean",
            "std",
            "low",
            "high",
        )
    )


#: Marks the row that ends a stream; added by ``run_ordered``.
FLUSH = "ends_stream"


@dataclass(frozen=True)
class Ordering:
    """How rows are put in order: how long a file may be late, how long the slots are whose
    rows are answered together, and after what silence a recording is closed; in seconds."""

    late: float = 10.0
    slot: float = 60.0
    idle: float = 3600.0


class _Sequence(StatefulProcessor):
    """Feeds one recording's rows, in time order, to ``step``.

    Rows wait as they came; a timer at the end of the earliest slot answers all slots the
    watermark has passed, so calls for state follow recordings and micro-batches, not slots. After ``idle`` seconds without rows ``finish`` answers what is open; rows
    that come later go on with the numbering, as a new stretch.
    """

    state_schema: str
    order: Ordering
    key_name: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.state_schema)
        # Last slot answered, time of the last row answered.
        self.clock = handle.getValueState("clock", "slot bigint, last bigint")
        # Rows of slots not yet answered, one entry per micro-batch that brought some.
        self.waiting = handle.getListState("waiting", "at array<bigint>, event_id array<bigint>, value array<double>")
        self.slot_us = int(self.order.slot * 1_000_000)
        # Recordings whose due slots were answered at the present watermark.
        self.seen_at, self.seen_keys = None, set()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        batch = batch[~batch[FLUSH].astype(bool)]
        if not len(batch):
            return
        slots = batch["at"] // self.slot_us
        clock = self.clock.get()
        if clock is not None:
            behind = slots <= clock[0]
            if behind.any():
                yield self._marked(key, batch[behind])
            batch, slots = batch[~behind], slots[~behind]
        timed = slots.notna()
        if timed.any():
            own = batch[timed]
            rows = own["at"].astype("int64").tolist(), own["event_id"].tolist(), own["value"].tolist()
            self.waiting.appendList([rows])
            self._wake(int(slots.min()))

    def _wake(self, slot: int) -> None:
        """Come back when the watermark has passed the earliest slot that waits; it tells the next one then."""
        self.handle.registerTimer((slot + 1) * self.slot_us // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if now != self.seen_at:
            self.seen_at, self.seen_keys = now, set()
        if key[0] in self.seen_keys:  # timers come after the rows of a micro-batch: nothing new is due
            return
        self.seen_keys.add(key[0])
        waiting = list(self.waiting.get())
        clock, left = None, []
        if waiting:
            at, event, value = (np.array([v for row in waiting for v in row[i]]) for i in range(3))
            order = np.lexsort((event, at))
            at, event, value = at[order], event[order], value[order]
            slots = at // self.slot_us
            n_due = int(np.searchsorted((slots + 1) * self.slot_us, now, side="right"))
            left = at[n_due:]
            if n_due:
                if len(left):
                    self.waiting.put([(left.tolist(), event[n_due:].tolist(), value[n_due:].tolist())])
                else:
                    self.waiting.clear()
                clock = (int(slots[n_due - 1]), int(at[n_due - 1]))
                self.clock.update(clock)
                self.handle.registerTimer((clock[1] + int(self.order.idle * 1_000_000)) // 1000 + 1)
                batch = pd.DataFrame({"at": at[:n_due], "event_id": event[:n_due], "value": value[:n_due]})
                out, state = self.step(batch, self._state())
                self.kept.update(state)
                yield self._answered(key, out)
            if len(left):
                self._wake(int(left[0]) // self.slot_us)
        if not len(left):
            clock = clock or self.clock.get()
            if clock is not None and clock[1] + self.order.idle * 1_000_000 <= now:
                out, state = self.finish(self._state())
                self.kept.update(state)
                yield self._answered(key, out)

    def _state(self):
        return self.kept.get()

    def finish(self, state) -> tuple[pd.DataFrame, tuple]:
        """What is open when a recording ends, and the state to go on with."""
        empty, state = self.step(pd.DataFrame({"at": [], "event_id": [], "value": []}), state)
        return empty, state

    def _answered(self, key, out: pd.DataFrame) -> pd.DataFrame:
        out.insert(0, self.key_name, key[0])
        out["late"], out["late_at"], out["late_event"] = False, None, None
        return out

    def _marked(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        late = {"late": True, "late_at": rows["at"], "late_event": rows["event_id"]}
        none = {name: None for name in ("k", *self.columns)}
        return pd.DataFrame({self.key_name: key[0], **none, **late}, index=rows.index)[
            [self.key_name, "k", *self.columns, *late]
        ]

    def close(self) -> None:
        pass


class OnlineEma(_Sequence):
    state_schema = "seen bigint, ema double"
    columns = ("ema", "ema_pred")

    def __init__(self, alpha: float, threshold: float, key_name: str, order: Ordering) -> None:
        self.alpha, self.threshold, self.key_name, self.order = alpha, threshold, key_name, order

    def step(self, batch: pd.DataFrame, state):
        seen, ema = state if state else (0, None)
        smoothed = []
        for p in batch["value"].tolist():
            ema = p if ema is None else self.alpha * p + (1 - self.alpha) * ema
            smoothed.append(ema)
        out = pd.DataFrame({"k": range(seen, seen + len(batch)), "ema": smoothed})
        out["ema_pred"] = (out["ema"] >= self.threshold).astype("int32")
        return out, (seen + len(batch), ema)

    def finish(self, state):
        """A new stretch starts its average anew."""
        return self.step(pd.DataFrame({"value": []}), (state[0], None))


class OnlineVote(_Sequence):
    """Centred vote, answered once the windows it looks ahead to have arrived, the last
    ones when the recording is closed."""

    state_schema = "seen bigint, begin bigint, recent array<int>"
    columns = ("pred",)

    def __init__(self, n: int, k: int, key_name: str, order: Ordering) -> None:
        self.n, self.k, self.key_name, self.order = n, k, key_name, order

    def _votes(self, preds: list[int], first: int, begin: int, ks: range) -> pd.DataFrame:
        """Votes of the windows ``ks``; ``preds`` start at window ``first``, the stretch at ``begin``."""
        half = self.n // 2
        votes = [int(sum(preds[max(k - half, begin) - first : k + half + 1 - first]) >= self.k) for k in ks]
        return pd.DataFrame({"k": pd.Series(list(ks), dtype="int64"), "pred": pd.Series(votes, dtype="int32")})

    def step(self, batch: pd.DataFrame, state):
        seen, begin, recent = (state[0], state[1], list(state[2])) if state else (0, 0, [])
        half = self.n // 2
        preds = recent + [int(p) for p in batch["value"]]
        first = seen - len(recent)
        total = seen + len(batch)

        def answered(count: int) -> int:
            return max(count - half, begin) if count - begin >= self.n else begin

        out = self._votes(preds, first, begin, range(answered(seen), answered(total)))
        keep_from = max(answered(total) - half, begin)
        return out, (total, begin, preds[keep_from - first :])

    def finish(self, state):
        """The last windows vote over what there is; a stretch below ``n`` windows keeps its decisions."""
        seen, begin, recent = state[0], state[1], [int(p) for p in state[2]]
        first = seen - len(recent)
        if seen - begin >= self.n:
            out = self._votes(recent, first, begin, range(max(seen - self.n // 2, begin), seen))
        else:
            out = pd.DataFrame(
                {"k": pd.Series(range(first, seen), dtype="int64"), "pred": pd.Series(recent, dtype="int32")}
            )
        return out, (seen, seen, [])


class OnlineAlarm(_Sequence):
    """Alarm at every window that ends ``need`` positive windows in a row."""

    state_schema = "seen bigint, streak bigint"
    columns = ("alarm",)

    def __init__(self, need: int, key_name: str, order: Ordering) -> None:
        self.need, self.key_name, self.order = need, key_name, order

    def step(self, batch: pd.DataFrame, state):
        seen, streak = state if state else (0, 0)
        alarms = []
        for p in batch["value"].tolist():
            streak = streak + 1 if p else 0
            alarms.append(int(streak >= self.need))
        out = pd.DataFrame({"k": range(seen, seen + len(batch)), "alarm": alarms})
        out["alarm"] = out["alarm"].astype("int32")
        return out, (seen + len(batch), streak)

    def finish(self, state):
        return self.step(pd.DataFrame({"value": []}), (state[0], 0))


class Admission(_Sequence):
    """Passes rows on in time order; what is left out is only what is late."""

    state_schema = "seen bigint"
    columns = ("at", "event_id", "value")

    def __init__(self, key_name: str, order: Ordering) -> None:
        self.key_name, self.order = key_name, order

    def step(self, batch: pd.DataFrame, state):
        seen = state[0] if state else 0
        out = batch[["at", "event_id", "value"]].reset_index(drop=True)
        out.insert(0, "k", range(seen, seen + len(batch)))
        return out, (seen + len(batch),)


def _span(seconds: float) -> str:
    return f"{round(seconds * 1000)} milliseconds"


LATE = "late boolean, late_at bigint, late_event bigint"


def _stateful(rows: DataFrame, by: str, value: str, processor: _Sequence, columns: str) -> DataFrame:
    kind = dict(rows.dtypes)[by]
    flush = F.col(FLUSH) if FLUSH in rows.columns else F.lit(False)
    # Time goes on as a number: a column that carries the watermark would make Spark drop
    # late rows before the processor sees them.
    timed = rows.withWatermark("ts", _span(processor.order.late)).select(
        by,
        F.unix_micros("ts").alias("at"),
        "event_id",
        F.col(value).cast("double").alias("value"),
        flush.alias(FLUSH),
    )
    return timed.groupBy(by).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=f"{by} {kind}, k bigint, {columns}, {LATE}",
        outputMode="Append",
        timeMode="EventTime",
    )


def online_ema(
    scored: DataFrame, alpha: float = 0.3, threshold: float = 0.5, by: str = "user_id", order: Ordering = Ordering()
) -> DataFrame:
    """Exponential average that continues across micro-batches; needs ``(ts, event_id, prob)``."""
    processor = OnlineEma(alpha, threshold, by, order)
    return _stateful(scored, by, "prob", processor, "ema double, ema_pred int")


def online_vote(
    scored: DataFrame, n: int = 3, k: int = 2, by: str = "user_id", order: Ordering = Ordering()
) -> DataFrame:
    """Majority vote with a delay of ``n // 2`` windows; needs ``(ts, event_id, pred)``."""
    return _stateful(scored, by, "pred", OnlineVote(n, k, by, order), "pred int")


def online_alarm(scored: DataFrame, need: int = 3, by: str = "user_id", order: Ordering = Ordering()) -> DataFrame:
    """Delayed alarm after ``need`` consecutive detections; needs ``(ts, event_id, pred)``."""
    return _stateful(scored, by, "pred", OnlineAlarm(need, by, order), "alarm int")


def admitted(events: DataFrame, by: str = "user_id", value: str = "value", order: Ordering = Ordering()) -> DataFrame:
    """The rows of an event stream in time order, late ones marked; needs ``(ts, event_id, value)``."""
    return _stateful(events, by, value, Admission(by, order), "at bigint, event_id bigint, value double")


class LateRows(RuntimeError):
    """Rows behind the watermark were left out of the result."""


def _moment(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


class _Reports(StreamingQueryListener):
    """Over all micro-batches of a query: rows its operators dropped, and the latest event time."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.latest: dict[str, datetime] = {}
        self.ended = threading.Condition()
        self.done: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        dropped = sum(int(o.numRowsDroppedByWatermark) for o in event.progress.stateOperators)
        self.rows[run] = self.rows.get(run, 0) + dropped
        found = [_moment(event.progress.eventTime[n]) for n in ("max", "watermark") if n in event.progress.eventTime]
        if found:
            self.latest[run] = max([*found, *filter(None, [self.latest.get(run)])])

    def onQueryTerminated(self, event) -> None:
        with self.ended:
            self.done.add(str(event.runId))
            self.ended.notify_all()

    def of(self, run: str, seconds: float = 60.0) -> tuple[int, datetime | None]:
        """The figures of a run that has ended; its last reports are waited for."""
        with self.ended:
            if not self.ended.wait_for(lambda: run in self.done, seconds):
                raise RuntimeError("the reports of a stream did not arrive")
        return self.rows.get(run, 0), self.latest.get(run)


def _start(stream: DataFrame, folder: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/rows")
    )


def _run(stream: DataFrame, folder: str) -> tuple[int, datetime | None]:
    """Process what is there now; the rows dropped, and the latest event time or watermark seen."""
    spark = stream.sparkSession
    # The provider has to be set while the query starts; it is a setting of this session.
    own = spark.conf.get(PROVIDER, None)
    listener = _Reports()
    spark.streams.addListener(listener)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        run = _start(stream, folder)
        run.awaitTermination()
        return listener.of(str(run.runId))
    finally:
        spark.streams.removeListener(listener)
        if own is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, own)


def run_available(stream: DataFrame, purpose: str, folder: str | None = None, late: str = "fail") -> DataFrame:
    """Process what is there now into a Parquet table, and read it.

    Offsets, state and rows live in ``folder``; a later call with the same folder goes on
    where the last one ended. Without it a fresh one is taken under the shared folder.
    Rows behind the watermark cannot enter closed windows; if there are any, the call
    fails and tells their number. ``late="drop"`` accepts the loss.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, purpose)
    dropped, _ = _run(stream, folder)
    if dropped and late == "fail":
        raise LateRows(f"{dropped} rows were behind the watermark; allow more lateness")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_ordered(
    rows: DataFrame,
    operator: Callable[[DataFrame], DataFrame],
    purpose: str,
    folder: str | None = None,
    order: Ordering = Ordering(),
    finish: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Process what is there now with an ordered operator: its results, and the late rows.

    Works in ``folder`` as ``run_available`` does. With ``finish`` a closing row moves the
    watermark past all that has arrived, so every row is answered and every recording
    closed; rows of a later call go on from there, and what is older than this is late.
    ``order`` is the one the operator was given.
    """
    spark = rows.sparkSession
    folder = folder or shared_folder(spark, purpose)
    control = f"{folder}/control"
    spark.createDataFrame([], rows.schema).write.mode("ignore").parquet(control)
    ends = spark.readStream.schema(rows.schema).parquet(control).withColumn(FLUSH, F.lit(True))
    stream = operator(rows.withColumn(FLUSH, F.lit(False)).unionByName(ends))
    _, latest = _run(stream, folder)
    # How far the stream has come, also for a call that only closes it.
    reached = spark.createDataFrame([(latest,)] if latest else [], "ts timestamp")
    reached.write.mode("append").parquet(f"{folder}/reached")
    latest = spark.read.schema(reached.schema).parquet(f"{folder}/reached").agg(F.date_format(F.max("ts"), TIME)).first()[0]
    if finish and latest is not None:
        past = timedelta(seconds=2 * order.late + order.slot + order.idle + 1)
        end = F.lit(latest).cast("timestamp") + F.lit(past)
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name != "ts"]
        closing = spark.range(1).select(*none, end.alias("ts")).select(*rows.columns)
        closing.write.mode("append").parquet(control)
        _run(stream, folder)
    table = spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    by = stream.columns[0]
    results = table.where(~F.col("late")).drop("late", "late_at", "late_event")
    late = table.where("late").select(
        by, F.timestamp_micros("late_at").alias("ts"), F.col("late_event").alias("event_id")
    )
    return results, late


def run_windows(
    events: DataFrame,
    purpose: str,
    folder: str | None = None,
    length: str = "4 seconds",
    slide: str = "1 second",
    by: str = "user_id",
    value: str = "value",
    order: Ordering = Ordering(),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows over files in any order: closed windows, rows they were made from, late rows.

    Rows are admitted in time order first, late ones set aside; the windows read the
    admitted rows as a second stream, whose watermark none of them can be behind: each
    call reads all that was admitted since the last one in one micro-batch. Rows in are
    rows admitted plus rows late.
    """
    spark = events.sparkSession
    folder = folder or shared_folder(spark, purpose)
    operator = lambda rows: admitted(rows, by, value, order)
    rows, late = run_ordered(events, operator, purpose, f"{folder}/admission", order)
    kept = (
        spark.readStream.schema(spark.read.parquet(f"{folder}/admission/rows").schema)
        .parquet(f"{folder}/admission/rows")
        .where(~F.col("late"))
        .select(by, F.timestamp_micros("at").alias("ts"), F.col("value").alias(value))
    )
    closed = run_available(
        window_stats(kept, length, slide, _span(order.late), by, value), purpose, f"{folder}/windows"
    )
    return closed, rows, late
