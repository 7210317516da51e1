"""Chat formatting: a dialogue of several speakers, once from the perspective of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The marks of a message. In a text, "<|" is set apart so that it can't pose as one.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
UNKNOWN = "unknown"

#: Turn numbers of one block; a long conversation is numbered block by block.
BLOCK_TURNS = 64


def perspectives(turns: DataFrame, *, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Render every conversation for each of its speakers: that one as assistant, others as named users.

    `turns` has conv_id, turn, role (the speaker) and text; other columns are ignored. One row for
    each turn and perspective: conv_id, perspective, position (from 1), turn, speaker, segment (the
    rendered message), first and past (its characters in the rendered dialogue, which is all segments
    by position), train_first and train_past (the characters to learn: the perspective's own text and
    its closing mark; null in messages of others).

    System messages are context in every perspective, and have none of their own. A turn without a
    role is said by "unknown", who has no perspective either; one without a text is an empty message
    that isn't learned. Turns are in order of turn (null last), role and text; repeated rows are
    repeated messages. Conversations without a conv_id are one conversation.

    Only blocks of `block_turns` turn numbers are windows; their lengths are summed across blocks.
    """
    said = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("said"),
        F.col("text").isNotNull().alias("spoken"),
        F.col("role").isNotNull().alias("named"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit((1 << 62))).cast("long"))
    speakers = said.filter((F.col("speaker") != SYSTEM) & F.col("named")).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    seen = said.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    own = (F.col("speaker") == F.col("perspective")) & F.col("named")
    head = (
        F.when(own, F.lit(f"{OPEN}assistant\n"))
        .when((F.col("speaker") == SYSTEM) & F.col("named"), F.lit(f"{OPEN}system\n"))
        .otherwise(F.concat(F.lit(f"{OPEN}user name="), "speaker", F.lit("\n")))
    )
    rendered = seen.withColumn("head", head).withColumn("segment", F.concat("head", "said", F.lit(f"{CLOSE}\n"))).withColumn("length", F.length("segment").cast("long"))
    key = ["conv_id", "perspective"]
    blocks = rendered.groupBy(*key, "block").agg(F.count("*").alias("_n"), F.sum("length").alias("_length"))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        *(F.col(c).alias(f"_{c}") for c in [*key, "block"]),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_turns_before"),
        F.coalesce(F.sum("_length").over(before), F.lit(0)).alias("_chars_before"),
    )
    within = Window.partitionBy(*key, "block").orderBy(F.col("turn").asc_nulls_last(), "speaker", "said", "spoken")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    placed = rendered.withColumn("_row", F.row_number().over(within)).withColumn("_upto", F.sum("length").over(upto))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("perspective") == F.col("_perspective")) & (F.col("block") == F.col("_block"))
    past = F.col("_chars_before") + F.col("_upto")
    first = past - F.col("length")
    learned = own & F.col("spoken")
    return placed.join(starts, same).select(
        "conv_id",
        "perspective",
        (F.col("_turns_before") + F.col("_row")).alias("position"),
        "turn",
        "speaker",
        "segment",
        first.alias("first"),
        past.alias("past"),
        F.when(learned, first + F.length("head")).alias("train_first"),
        F.when(learned, past - 1).alias("train_past"),
    )
