"""Chat formatting: multi-party perspective rotation.

Every participant of a conversation gets a rendering of it: own turns as the assistant's,
those of others as users named by their role, system turns as system turns.  Masks mark what
is learned from: the content of the assistant's segments and their closing mark.

A rendering is emitted as its segments, one row per turn and perspective; a conversation of
any length is a stream of rows and never gathered in one task.  The rendered text of a
perspective is the concatenation of its segments in the order of turn, then role and text.

Edge cases: a null role is a participant of its own, whom others see as a user without a name; a null
text is empty; turns with equal numbers are ordered by role and text, repeated rows stay repeated;
a conversation with system turns only has no participant and no rows; rows without conv_id are
no conversation and give none, nor does an empty table; marks inside a text or a role are broken up,
and line breaks in a role are spaces, so that neither can end or forge a segment; very long texts
stay whole; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _defused(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def rotate_perspectives(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, speaker, rendered, mask_start and mask_end (code points of rendered; equal if masked out)."""
    turns = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.col("role").alias("speaker"), _defused(F.coalesce("text", F.lit(""))).alias("body"),
    )
    people = turns.where("speaker is null or speaker <> 'system'").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    both = turns.join(people, "conv_id")
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    head = (
        F.when(own, f"{OPEN}assistant\n")
        .when(F.col("speaker") == "system", f"{OPEN}system\n")
        .when(F.col("speaker").isNull(), f"{OPEN}user\n")
        .otherwise(F.concat(F.lit(f"{OPEN}user name="), _defused(F.translate("speaker", "\r\n", "  ")), F.lit("\n")))
    )
    rendered = F.concat(head, "body", F.lit(f"{CLOSE}\n"))
    start = F.length(head).cast("long")
    end = F.when(own, start + F.length("body") + len(CLOSE)).otherwise(start).cast("long")
    return both.select("conv_id", "perspective", "turn", "speaker", rendered.alias("rendered"), start.alias("mask_start"), end.alias("mask_end"))
