"""Chat formatting by perspective rotation (operator 3); DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once with that
speaker as the assistant and the others as named users.  A rendered message is

    <|im_start|>assistant\\n{text}<|im_end|>\\n           (the participant's own)
    <|im_start|>user name={speaker}\\n{text}<|im_end|>\\n  (everyone else's)
    <|im_start|>system\\n{text}<|im_end|>\\n               (system messages)

and the loss mask covers the text and end tag of the participant's own messages.  The
result has one row per participant and message: its place, the rendered piece, where
the piece starts in the rendered dialogue and the masked characters.  Pieces in order
of ``seq`` are the dialogue, so a conversation with a third of all rows is never one
value or one task: places and offsets are prefix sums over ranges of turns.

Defined results: messages are ordered by turn (null last), then role and text; rows that
are equal in all of these each count; a null role speaks as "unknown", a null text is
empty; system messages are no participant, and a conversation of system messages only has no rows;
rows with a null conv_id are left out (they are no conversation); other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURNS_PER_RANGE = 1024


def perspectives(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", system: str = "system") -> DataFrame:
    """(conv_id, perspective, seq, speaker, piece, start, mask_start, mask_end, is_target)."""
    said = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # A participant of a conversation: one row each, however many messages it has.
    people = said.where(F.col("speaker") != system).groupBy("conv_id", "speaker").agg(F.count("*").alias("n")).select("conv_id", F.col("speaker").alias("perspective"))
    rendered = said.join(people, "conv_id")
    own = F.col("speaker") == F.col("perspective")
    head = F.concat(F.lit(OPEN), F.when(F.col("speaker") == system, F.lit("system")).when(own, F.lit("assistant"))
                    .otherwise(F.concat(F.lit("user name="), F.col("speaker"))), F.lit("\n"))
    rendered = rendered.select("conv_id", "perspective", "turn", "speaker", F.floor(F.coalesce("turn", F.lit(2**62)) / TURNS_PER_RANGE).cast("long").alias("part"),
                               "text", F.length(head).cast("long").alias("head"), F.concat(head, F.col("text"), F.lit(CLOSE)).alias("piece"), own.alias("is_target"))
    rendered = rendered.withColumn("size", F.length("piece").cast("long"))
    parts = rendered.groupBy("conv_id", "perspective", "part").agg(F.sum("size").alias("chars"), F.count("*").alias("n"))
    w = Window.partitionBy("conv_id", "perspective").orderBy("part")
    offsets = parts.select("conv_id", "perspective", "part", (F.sum("chars").over(w) - F.col("chars")).alias("chars0"), (F.sum("n").over(w) - F.col("n")).alias("n0"))
    inside = Window.partitionBy("conv_id", "perspective", "part").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
    placed = rendered.join(offsets, ["conv_id", "perspective", "part"])
    start = F.col("chars0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    out = placed.select("conv_id", "perspective", (F.col("n0") + F.row_number().over(inside) - 1).cast("long").alias("seq"), "speaker", "piece",
                        start.cast("long").alias("start"), "head", "size", "is_target")
    return out.select("conv_id", "perspective", "seq", "speaker", "piece", "start",
                      F.when(F.col("is_target"), F.col("start") + F.col("head")).alias("mask_start"),
                      F.when(F.col("is_target"), F.col("start") + F.col("size") - 1).alias("mask_end"), "is_target")
