"""Seizure annotation files to intervals.

Files arrive as ``(path, subject, txt)`` rows, one per file; a file is read whole by
Spark and stays small. Its lines become rows, each line is classified once, and the
state a line depends on is read from earlier lines by ordered windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400.0

# Line keys of the two annotation families and what they announce.
SIENA_KEYS = {
    "file name": "file",
    "registration start time": "begin",
    "seizure start time": "onset",
    "start time": "onset",
    "seizure end time": "offset",
    "end time": "offset",
}
CHBMIT_KEYS = {
    "file name": "file",
    "file start time": "begin",
    "file end time": "end",
    "number of seizures in file": "count",
    "seizure start time": "onset",
    "seizure end time": "offset",
    "seizure # start time": "onset",
    "seizure # end time": "offset",
}
#: What the value of a line must begin with; other lines of the kind are not recognised.
WHOLE, WORD, NUMBER, EDF = r"^.+", r"^\S+", r"^[0-9]+", r"(?i)^.+[.]edf"
SIENA_VALUES = {"file": WHOLE, "begin": WORD, "onset": WORD, "offset": WORD}
CHBMIT_VALUES = {"file": EDF, "begin": WORD, "end": WORD, "count": NUMBER, "onset": NUMBER, "offset": NUMBER}


def clock_seconds(text: Column) -> Column:
    """``HH.MM.SS`` or ``HH:MM:SS`` as seconds, else a plain number; null if neither."""
    parts = F.split(F.trim(text), "[.:]")
    whole = F.forall(parts, lambda p: p.rlike(r"^[+-]?\d+$"))
    hms = F.transform(parts, lambda p: p.try_cast("double"))
    triple = F.get(hms, F.lit(0)) * 3600 + F.get(hms, F.lit(1)) * 60 + F.get(hms, F.lit(2))
    return F.when(
        whole, F.when(F.size(parts) == 3, triple).otherwise(F.trim(text).try_cast("double"))
    )


def repair_name(name: Column) -> Column:
    """The letter O typed for the zero of a ``PN0x`` recording."""
    return F.regexp_replace(name, r"\bPNO(\d)", "PN0$1")


def _lines(texts: DataFrame, keys: dict[str, str], values: dict[str, str]) -> DataFrame:
    """Recognised ``key : value`` lines as ``(path, subject, pos, kind, arg)``.

    A key is compared without case, with single blanks, and with ``#`` for a number.
    """
    named = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
    key = F.regexp_replace(F.lower(F.trim(F.substring_index("line", ":", 1))), r"\s+", " ")
    key = F.regexp_replace(key, " [0-9]+ ", " # ")
    value = F.regexp_replace(F.expr("substring(line, instr(line, ':') + 1)"), r"^\s+", "")
    arg = None
    for kind, pattern in values.items():
        found = F.nullif(F.regexp_extract("value", pattern, 0), F.lit(""))
        arg = F.when(F.col("kind") == kind, found).otherwise(arg if arg is not None else F.lit(None))
    exploded = texts.select("path", "subject", F.posexplode(F.split("txt", r"\r\n|\r|\n")))
    return (
        exploded.select("path", "subject", "pos", F.trim("col").alias("line"))
        .where(F.instr("line", ":") > 0)
        .withColumns({"kind": F.try_element_at(named, key), "value": value})
        .withColumn("arg", F.trim(arg))
        .where("kind is not null and arg is not null")
        .drop("line", "value")
    )


def _since_file(kind: str, value: Column, keep_nulls: bool = True) -> Column:
    """Latest ``value`` of the given kind of line, forgotten at every file line."""
    upto = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    seen = F.col("kind") == kind
    if not keep_nulls:
        seen = seen & value.isNotNull()
    state = F.when(F.col("kind") == "file", F.struct(F.lit(None).cast("double").alias("v"))).when(
        seen, F.struct(value.cast("double").alias("v"))
    )
    return F.last(state, ignorenulls=True).over(upto)["v"]


def _pair(lines: DataFrame) -> DataFrame:
    """End lines whose latest file, onset or end line is an onset with a known time."""
    marks = lines.where(F.col("kind").isin("file", "onset", "offset"))
    before = W.partitionBy("path").orderBy("pos")
    return (
        marks.withColumn("_kind", F.lag("kind").over(before))
        .withColumn("onset", F.lag("sec").over(before))
        .where("kind = 'offset' and _kind = 'onset' and onset is not null")
    )


def siena_intervals(texts: DataFrame) -> DataFrame:
    """Intervals in seconds from the recording start out of wall-clock seizure lists."""
    upto = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    lines = _lines(texts, SIENA_KEYS, SIENA_VALUES).withColumn(
        "sec", F.when(F.col("kind") != "file", clock_seconds(F.col("arg")))
    )
    lines = lines.withColumns(
        {
            "recording": F.coalesce(
                F.last(
                    F.when(F.col("kind") == "file", repair_name(F.col("arg"))), ignorenulls=True
                ).over(upto),
                stem,
            ),
            "begin": _since_file("begin", F.col("sec")),
        }
    )
    ends = _pair(lines).where("sec is not null")
    onset = F.col("onset") - F.col("begin")
    onset = F.when(onset < 0, onset + DAY).otherwise(onset)
    relative = ends.withColumn("_on", onset).withColumn("_off", F.col("sec") - F.col("begin"))
    known = F.col("begin").isNotNull()
    return relative.select(
        "subject",
        "recording",
        F.when(known, F.col("_on")).otherwise(F.col("onset")).alias("onset_sec"),
        F.when(~known, F.col("sec"))
        .when(F.col("_off") < F.col("_on"), F.col("_off") + DAY)
        .otherwise(F.col("_off"))
        .alias("offset_sec"),
    )


def chbmit_intervals(texts: DataFrame) -> DataFrame:
    """Intervals out of per-file summaries, with the file's clock times.

    Seizure lines count only in blocks whose announced number of seizures is not 0.
    """
    upto = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    clock = F.transform(F.slice(F.split("arg", "[:.]"), 1, 3), lambda p: p.try_cast("int"))
    known = (F.size(clock) == 3) & F.forall(clock, lambda p: p.isNotNull())
    packed = F.when(
        known, F.get(clock, F.lit(0)) * 10_000 + F.get(clock, F.lit(1)) * 100 + F.get(clock, F.lit(2))
    )
    stem = F.regexp_replace(F.element_at(F.split("arg", "/"), -1), r"(?<=.)\.[^.]*$", "")
    lines = _lines(texts, CHBMIT_KEYS, CHBMIT_VALUES).withColumn(
        "sec", F.when(F.col("kind").isin("onset", "offset"), F.col("arg").try_cast("double"))
    )
    lines = lines.withColumns(
        {
            "recording": F.last(F.when(F.col("kind") == "file", stem), ignorenulls=True).over(upto),
            "n": _since_file("count", F.col("arg").try_cast("double")),
            "_begin": _since_file("begin", packed, keep_nulls=False),
            "_end": _since_file("end", packed, keep_nulls=False),
        }
    )
    active = (F.col("kind") == "file") | ((F.col("n") > 0) & F.col("recording").isNotNull())
    ends = _pair(lines.where(active))
    return ends.select(
        "subject",
        "recording",
        F.col("onset").alias("onset_sec"),
        F.col("sec").alias("offset_sec"),
        _hms("_begin").alias("file_start"),
        _hms("_end").alias("file_end"),
        (F.col("sec") - F.col("onset")).alias("duration_sec"),
    )


def _hms(packed: str) -> Column:
    col = F.col(packed).cast("int")
    return F.when(
        col.isNotNull(),
        F.struct(
            F.floor(col / 10_000).cast("int").alias("h"),
            F.pmod(F.floor(col / 100), F.lit(100)).cast("int").alias("m"),
            F.pmod(col, F.lit(100)).alias("s"),
        ),
    )


def seizure_counts(texts: DataFrame, intervals: DataFrame) -> DataFrame:
    """Seizures per subject, 0 for subjects whose files name none."""
    counted = intervals.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    return (
        texts.select("subject")
        .distinct()
        .join(counted, "subject", "left")
        .select("subject", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_seizures"))
    )
