"""Views of the driver tables that play the parts of an EEG corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paroxys.operators.ordered import dense_index, time_chunk

MINUTE = 60.0

# Seizure zones scaled to the event spacing of the driver tables.
WINDOW_SEC = 4.0
SPH_SEC = 18_000.0
SOP_SEC = {15: 54_000.0, 10: 36_000.0, 5: 18_000.0}
POSTICTAL_SEC = 54_000.0

# Raw electrode names standing for each event type.
RAW_CHANNELS = {
    "view": "EEG T3",
    "click": "eeg F7",
    "error": "T8 ",
    "signup": "F8",
    "purchase": "EKG P7",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with seconds since the start of 2024."""
    seconds = F.expr(
        "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) / 1e6D"
    )
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", "event_type", "value", "ts", seconds.alias("t_sec")
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording per user, indexed by time; the channel follows the event type."""
    raw = F.create_map(*[F.lit(x) for pair in RAW_CHANNELS.items() for x in pair])
    rows = events(spark, sf_dir).withColumn("minute", time_chunk("t_sec", MINUTE))
    return (
        dense_index(rows, ["user_id"], "minute", ["t_sec", "event_id"])
        .withColumn("ch_raw", raw[F.col("event_type")])
        .select("user_id", "event_id", "event_type", "i", "t_sec", "ch_raw", "value")
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled-window candidate per event, starting at its time."""
    return events(spark, sf_dir).select(
        "user_id", F.col("event_id").alias("window_id"), F.col("t_sec").alias("start_sec")
    )


def seizures(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = events(spark, sf_dir).where("event_type = 'purchase' and value > 150")
    return big.select(
        "user_id",
        F.col("t_sec").alias("onset_sec"),
        (F.col("t_sec") + 60 * F.col("value")).alias("offset_sec"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction sequence per recording with truth, probability and decision."""
    prob = F.col("value") / (F.col("value") + 50)
    return (
        samples(spark, sf_dir)
        .select(
            "user_id",
            F.col("i").alias("k"),
            F.col("event_type").isin("error", "purchase").cast("int").alias("y"),
            prob.alias("prob"),
            ((F.col("value") - 50) / 50).alias("l1"),
        )
        .withColumn("l0", -F.col("l1"))
        .withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
    )


def flat_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored table without its order, for order-free metrics (no index shuffle)."""
    prob = F.col("value") / (F.col("value") + 50)
    return (
        table(spark, sf_dir, "events")
        .select(
            "user_id",
            (F.col("user_id") % 10).cast("int").alias("fold"),
            F.col("event_type").isin("error", "purchase").cast("int").alias("y"),
            prob.alias("prob"),
            ((F.col("value") - 50) / 50).alias("l1"),
        )
        .withColumn("l0", -F.col("l1"))
        .withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
    )


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of three models for every event."""
    members = F.array(
        F.col("value") / (F.col("value") + 50),
        (F.col("event_id") % 100) / 100.0,
        (F.col("user_id") % 10) / 10.0,
    )
    return table(spark, sf_dir, "events").select(
        "event_id", F.posexplode(members).alias("model", "prob")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One single-channel window of 64 samples per embedding."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("window_id"),
        (F.col("vec_id") % 10).cast("int").alias("subject"),
        (F.col("label") == 0).cast("int").alias("y"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


def channel_vectors(spark: SparkSession, sf_dir: str, channels: int = 4) -> DataFrame:
    """The same windows cut into channels of equal length, one row per channel."""
    width = F.size("x") / channels
    cut = F.transform(
        F.sequence(F.lit(0), F.lit(channels - 1)),
        lambda c: F.slice(F.col("x"), (c * width + 1).cast("int"), width.cast("int")),
    )
    return vectors(spark, sf_dir).select(
        "window_id", "subject", "y", F.posexplode(cut).alias("ch", "x")
    )


def long_vectors(spark: SparkSession, sf_dir: str, channels: int = 4, parts: int = 16) -> DataFrame:
    """Windows of ``parts`` embeddings per channel: four channels of 1024 samples."""
    per = channels * parts
    group, place = F.floor(F.col("vec_id") / per).cast("bigint"), F.pmod("vec_id", F.lit(per))
    rows = table(spark, sf_dir, "embeddings").select(
        group.alias("window_id"),
        F.floor(place / parts).cast("int").alias("ch"),
        "vec_id",
        F.col("embedding").cast("array<double>").alias("part"),
    )
    joined = rows.groupBy("window_id", "ch").agg(F.sort_array(F.collect_list(F.struct("vec_id", "part"))).alias("_p"))
    return joined.where(F.size("_p") == parts).select(
        "window_id",
        (F.col("window_id") % 10).cast("int").alias("subject"),
        (F.col("window_id") % 3 == 0).cast("int").alias("y"),
        "ch",
        F.flatten(F.transform("_p", lambda p: p["part"])).alias("x"),
    )


def siena_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seizure lists in wall-clock form, one file per user and minute."""
    rows = _seizure_rows(spark, sf_dir)
    clock_end = F.expr("ts + make_dt_interval(0, 0, 0, cast(floor(value) as decimal(18,6)))")
    block = F.concat_ws(
        "\n",
        F.concat(
            F.lit("File name: PNO"),
            (F.col("user_id") % 10).cast("string"),
            F.lit("-"),
            F.col("event_id").cast("string"),
            F.lit(".edf"),
        ),
        F.lit("Registration start time: 20.00.00"),
        F.concat(F.lit("Seizure start time: "), F.date_format("ts", "HH.mm.ss")),
        F.concat(F.lit("Seizure end time: "), F.date_format(clock_end, "HH:mm:ss")),
    )
    return _texts(rows.withColumn("block", block))


def chbmit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seizure summaries with numbered seizures, two per file block."""
    rows = _seizure_rows(spark, sf_dir)
    second = F.floor("value").cast("string")
    later = (F.floor("value") * 2).cast("string")
    last = (F.floor("value") * 3).cast("string")
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("File Name: chb"), F.col("event_id").cast("string"), F.lit(".edf")),
        F.lit("File Start Time: 13:43:04"),
        F.lit("File End Time: 14:43:04"),
        F.concat(
            F.lit("Number of Seizures in File: "),
            F.when(F.col("event_id") % 4 == 0, F.lit("0")).otherwise(F.lit("2")),
        ),
        F.concat(F.lit("Seizure 1 Start Time: "), second, F.lit(" seconds")),
        F.concat(F.lit("Seizure 1 End Time: "), later, F.lit(" seconds")),
        F.concat(F.lit("Seizure 2 Start Time: "), later, F.lit(" seconds")),
        F.concat(F.lit("Seizure 2 End Time: "), last, F.lit(" seconds")),
    )
    return _texts(rows.withColumn("block", block))


def _seizure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where("event_type = 'purchase' and value > 150")
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    )


def _texts(rows: DataFrame) -> DataFrame:
    minute = F.date_format("ts", "yyyyMMddHHmm")
    blocks = F.sort_array(F.collect_list(F.struct("event_id", "block")))
    return (
        rows.groupBy("user_id", minute.alias("minute"))
        .agg(blocks.alias("b"))
        .select(
            F.format_string("user%d/%s.txt", "user_id", "minute").alias("path"),
            F.format_string("user%d", "user_id").alias("subject"),
            F.concat_ws("\n", F.transform("b", lambda b: b["block"])).alias("txt"),
        )
    )
