"""Matching annotated recording names to recording stems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _with_pieces(names: DataFrame, name: str, sought: DataFrame, subject: str, piece: str) -> DataFrame:
    """Every name with those of its substrings that have a length found among ``sought``.

    ``sought`` has the strings looked for as ``piece``. A name meets the lengths of its
    subject, so it is cut into as many pieces as can match, not into all there are.
    """
    lengths = sought.where(F.length(piece) > 0).groupBy(subject).agg(F.collect_set(F.length(piece)).alias("_widths"))
    n = F.length(name)
    cut = F.transform(
        F.filter("_widths", lambda w: w <= n),
        lambda w: F.transform(F.sequence(F.lit(1), n - w + 1), lambda a: F.substr(F.col(name), a, w)),
    )
    pieces = F.explode(F.array_distinct(F.flatten(cut)))
    return names.join(lengths, subject).withColumn(piece, pieces).drop("_widths")


def _without_extension(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit(".edf"), F.lit("")), F.lit(".EDF"), F.lit(""))


def match_recordings(
    recordings: DataFrame, annotated: DataFrame, subject: str = "subject"
) -> DataFrame:
    """Pairs ``(subject, stem, recording)`` whose names match loosely.

    A stem matches when it occurs in the annotated name, when the annotated name
    without its extension occurs in the stem, or when the stem starts with that name
    stripped of trailing dashes. Containment becomes equality with the substrings of
    the longer name, so only matching pairs are ever formed. An empty annotated name
    matches every recording of its subject. Tables of substrings are merged, never sent
    whole to the driver: Spark judges them by the size of the names they come from.
    """
    stems = recordings.select(subject, "stem").distinct()
    names = annotated.select(subject, "recording").distinct()
    bare = _without_extension(F.col("recording"))
    keyed = names.withColumns({"bare": bare, "lead": F.rtrim(bare, F.lit("-"))})
    in_name = stems.join(_with_pieces(names, "recording", stems, subject, "stem").hint("merge"), [subject, "stem"])
    # A leading piece of a stem also occurs in it, so one exploded side serves both tests.
    as_piece = keyed.select(
        subject,
        "recording",
        F.explode(
            F.array(
                F.struct(F.col("bare").alias("piece"), F.lit(False).alias("leading")),
                F.struct(F.col("lead").alias("piece"), F.lit(True).alias("leading")),
            )
        ).alias("p"),
    ).select(subject, "recording", "p.*")
    pieces = _with_pieces(stems, "stem", as_piece, subject, "piece")
    in_stem = pieces.hint("merge").join(as_piece, [subject, "piece"]).where(
        ~F.col("leading") | F.startswith("stem", F.col("piece"))
    )
    anywhere = stems.join(keyed.where("lead = ''").select(subject, "recording"), subject)
    columns = [subject, "stem", "recording"]
    return (
        in_name.select(*columns)
        .unionByName(in_stem.select(*columns))
        .unionByName(anywhere.select(*columns))
        .distinct()
    )


def seizures_of_recordings(
    recordings: DataFrame,
    seizures: DataFrame,
    match: str = "exact",
    subject: str = "subject",
) -> DataFrame:
    """Seizures keyed by recording stem, by exact name (without extension) or loosely."""
    if match == "exact":
        named = seizures.withColumn("stem", _without_extension(F.col("recording")))
        return recordings.select(subject, "stem").distinct().join(named, [subject, "stem"])
    if match == "fuzzy":
        pairs = match_recordings(recordings, seizures, subject)
        return pairs.join(seizures, [subject, "recording"])
    raise ValueError(f"unknown match {match!r}")
