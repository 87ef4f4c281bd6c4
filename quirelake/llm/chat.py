"""Chat formatting by a finite-state machine over roles.

A template declares, for each state, the roles that may come next (the state is
the role of the last turn, at first ``START``), the roles on which a
conversation may end, and by role what goes before and after the text and which
of the three segments of a turn count for the loss. The machine runs as window
functions over the turns of a conversation, so one shuffle by conv_id does it
and no conversation is gathered in one row.

Result: a row a segment of each valid conversation, in the order of position:
conv_id, position, turn, role, text, loss, error (null). A conversation that the
machine rejects gives one row, of position 0, turn -1 and no text or role, whose
error names the first fault.

Defined results. Repeated rows count once; different rows of one turn are a
fault, as are null or unknown roles, null texts, null turns and a null conv_id
(all of its turns are one rejected conversation). Empty texts are valid.
Positions are three to a turn. An empty table gives no rows. Columns other than
conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Turn:
    """What surrounds a turn of a role, and the loss flags of prefix, text and suffix."""

    prefix: str
    suffix: str
    loss: tuple[bool, bool, bool] = (False, False, False)


@dataclass(frozen=True)
class Template:
    follows: Mapping[str, tuple[str, ...]]
    final: tuple[str, ...]
    turns: Mapping[str, Turn]


CHATML = Template(
    follows={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant",),
    turns={
        "system": Turn("<|im_start|>system\n", "<|im_end|>\n"),
        "user": Turn("<|im_start|>user\n", "<|im_end|>\n"),
        "assistant": Turn("<|im_start|>assistant\n", "<|im_end|>\n", (False, True, True)),
    },
)


def formatted(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """Segments of valid conversations and one row for each rejected one."""
    every = conversations.select("conv_id", "turn", "role", "text")
    turns = every.where("conv_id IS NOT NULL").distinct()
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    before = F.coalesce(F.lag("role").over(order), F.lit(START))
    allowed = F.lit(False)
    for state, roles in template.follows.items():
        allowed = F.when(before == state, F.col("role").isin(*roles)).otherwise(allowed)
    at = F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(": "))
    fault = (
        F.when(F.col("turn").isNull(), F.lit("no turn"))
        .when(F.lag("turn").over(order) == F.col("turn"), F.concat(at, F.lit("occurs twice")))
        .when(F.col("role").isNull() | ~F.col("role").isin(*template.turns), F.concat(at, F.lit("unknown role")))
        .when(F.col("text").isNull(), F.concat(at, F.lit("no text")))
        .when(~allowed, F.concat(at, F.col("role"), F.lit(" after "), before))
        .when(F.lead("role").over(order).isNull() & (F.row_number().over(order) == F.count("*").over(whole)) & ~F.col("role").isin(*template.final), F.concat(at, F.lit("ends with "), F.col("role")))
    )
    judged = turns.select("*", (F.row_number().over(order) - 1).alias("nth"), fault.alias("fault"))
    judged = judged.withColumn("error", F.first("fault", ignorenulls=True).over(whole.orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    segments = F.lit(None)
    for role, t in template.turns.items():
        parts = zip((F.lit(t.prefix), F.col("text"), F.lit(t.suffix)), t.loss, strict=True)
        segments = F.when(F.col("role") == role, F.array(*(F.struct(x.alias("text"), F.lit(y).alias("loss")) for x, y in parts))).otherwise(segments)
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("text"), F.lit(False).alias("loss")))
    shown = judged.where("error IS NULL OR nth = 0").select("conv_id", "turn", "role", "nth", "error", F.posexplode(F.when(F.col("error").isNull(), segments).otherwise(nothing)).alias("k", "segment"))
    valid = F.col("error").isNull()
    made = shown.select(
        "conv_id",
        (3 * F.col("nth") + F.col("k")).cast("long").alias("position"),
        F.when(valid, F.col("turn")).otherwise(F.lit(-1)).alias("turn"),
        F.when(valid, F.col("role")).alias("role"),
        F.col("segment.text").alias("text"),
        F.col("segment.loss").alias("loss"),
        "error",
    )
    # turns of no conversation are one rejected one, told without gathering them
    lost = every.where("conv_id IS NULL").limit(1)
    said = {"conv_id": F.col("conv_id"), "position": F.lit(0), "turn": F.lit(-1), "role": F.lit(None), "text": F.lit(None), "loss": F.lit(False), "error": F.lit("no conversation")}
    return made.unionByName(lost.select(*(said[f.name].cast(f.dataType).alias(f.name) for f in made.schema)))
