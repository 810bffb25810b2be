"""Render dialogues once for every participant, who then speaks as the assistant.

Native columns only. A turn becomes one row per perspective with its rendered text, its
place in the rendered dialogue and the mask that says which characters are learned.
Rows stay rows, so a dialogue of any length fits: places are running sums over chunks
of turns, and nothing gathers a dialogue in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paroxys.operators.ordered import running

#: The markers of the ChatML layout.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CHUNK_TURNS = 1024


def rotate(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    narrator: str = "system",
) -> DataFrame:
    """One row per turn and perspective.

    Every speaker but the narrator is a perspective. Seen from it, the own turns have
    role ``assistant`` and are learned (``mask`` is true), the narrator's keep role
    ``system``, all others have role ``user`` and carry the speaker's name. ``place``
    counts turns from 0 in order of turn, speaker and text (nulls first); ``start`` and
    ``end`` bound the rendered characters in the dialogue, ``learn_start`` the learned
    ones, which run to ``end`` with the closing marker; ``learn_start`` is null where
    nothing is learned. A null speaker is called ``unknown``, a null text is empty, null
    conversation ids form one dialogue. Equal turns given twice both stay. A dialogue of
    the narrator alone has no perspective and no rows. Extra columns are not carried.
    """
    said = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    joined = said.withColumn("conv_key", F.coalesce(F.col("conv").cast("string"), F.lit("\0null")))
    people = (
        joined.where(F.col("speaker") != narrator)
        .select("conv_key", F.col("speaker").alias("perspective"))
        .distinct()
    )
    # Long dialogues are cut by turn number; repeated or missing numbers stay together.
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(-(2**53))).cast("bigint")
    own = F.col("speaker") == F.col("perspective")
    seen = (
        F.when(own, "assistant").when(F.col("speaker") == narrator, "system").otherwise("user")
    )
    head = F.concat(
        F.lit(OPEN),
        F.col("seen_as"),
        F.when(F.col("seen_as") == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(""),
        F.lit("\n"),
    )
    rows = (
        joined.join(people, "conv_key")
        .withColumn("chunk", chunk)
        .withColumn("seen_as", seen)
        .withColumn("head", head)
        .withColumn("rendered", F.concat("head", "text", F.lit(CLOSE)))
        .withColumn("n", F.length("rendered").cast("bigint"))
    )
    order = [F.col("turn").asc_nulls_first(), "speaker", "text"]
    placed = running(
        rows,
        ["conv_key", "perspective"],
        "chunk",
        order,
        sums={"end": F.col("n"), "place": F.lit(1).cast("bigint")},
    )
    start = F.col("end") - F.col("n")
    return placed.select(
        F.col("conv").alias("conv_id"),
        "perspective",
        (F.col("place") - 1).alias("place"),
        "turn",
        "seen_as",
        F.when(F.col("seen_as") == "user", F.col("speaker")).alias("name"),
        "rendered",
        start.alias("start"),
        "end",
        (F.col("seen_as") == "assistant").alias("mask"),
        F.when(F.col("seen_as") == "assistant", start + F.length("head")).alias("learn_start"),
    )


def dialogues(rendered: DataFrame) -> DataFrame:
    """Whole dialogues as text with their learned spans, for dialogues that fit a row."""
    in_order = F.sort_array(F.collect_list(F.struct("place", "rendered", "learn_start", "end")))
    return (
        rendered.groupBy("conv_id", "perspective")
        .agg(in_order.alias("t"))
        .select(
            "conv_id",
            "perspective",
            F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("text"),
            F.transform(
                F.filter("t", lambda x: x["learn_start"].isNotNull()),
                lambda x: F.struct(x["learn_start"].alias("start"), x["end"].alias("end")),
            ).alias("learned"),
        )
    )
