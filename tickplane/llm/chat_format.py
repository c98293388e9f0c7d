"""Multi-party perspective rotation of dialogues, in DataFrame functions.

A dialogue is rendered once for each participant: that speaker's turns are the
assistant's, the other speakers are named users.  The result has one row for
each turn and perspective, with its place in the rendering and the span that a
trainer may learn from, so no dialogue is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Speakers that set the scene: rendered for everyone, nobody's perspective.
CONTEXT = ("system",)
#: Turn numbers in a block of running sums, and first characters of a text that tell its lots apart.
BLOCK, PREFIX = 1024, 3
END = "<|end|>\n"


def _escaped(text: Column) -> Column:
    """Texts can't write markers: a blank goes into each ``<|``."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """Segments (conv, perspective, turn, speaker, role, segment, start, mask_start, mask_end).

    Segments of one (conv, perspective) joined in the order of ``start`` are the
    rendering; offsets count code points.  ``mask_start`` and ``mask_end`` bound
    what the assistant says, its end marker included; both are null elsewhere.
    Turns are ordered by turn (null first), speaker (null first) and text.  A null text is an
    empty one; a null speaker is nobody's perspective and an unnamed user; rows
    without a conversation form one of their own; repeated rows are repeated
    turns.  A dialogue with no participant has no perspective and gives no rows,
    as does an empty table.

    Places are running sums in three levels: blocks of turn numbers, lots of
    equal turn, speaker and first characters of the text, and rows in a lot; so
    a very long dialogue is many tasks' work, and so is one with very many rows
    of one turn or of none.  Equal rows are one row with a number until the end.
    """
    source = turns.select(
        turns[conv].alias("conv"), turns[turn].alias("turn"), turns[speaker].alias("speaker"), _escaped(turns[text]).alias("body")
    )
    source = source.groupBy("conv", "turn", "speaker", "body").agg(F.count("*").alias("copies"))
    people = source.where(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*CONTEXT)).select(F.col("conv").alias("c"), F.col("speaker").alias("perspective")).distinct()
    rows = source.join(people, source["conv"].eqNullSafe(people["c"])).drop("c")
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    scene = F.coalesce(F.col("speaker").isin(*CONTEXT), F.lit(False))
    role = F.when(own, "assistant").when(scene, "system").otherwise("user")
    head = (
        F.when(own, F.lit("<|assistant|>\n"))
        .when(scene, F.lit("<|system|>\n"))
        .when(F.col("speaker").isNull(), F.lit("<|user|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), _escaped(F.col("speaker")), F.lit("|>\n")))
    )
    made = rows.withColumn("role", role).withColumn("head", head).withColumn("segment", F.concat("head", "body", F.lit(END)))
    made = made.withColumn("size", F.char_length("segment").cast("long")).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    made = made.withColumn("lot", F.struct("turn", "speaker", F.substring("body", 1, PREFIX).alias("prefix")))
    key, total = ["conv", "perspective"], F.sum(F.col("size") * F.col("copies")).alias("total")
    until = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lots = made.groupBy(*key, "block", "lot").agg(total)
    blocks = lots.groupBy(*key, "block").agg(F.sum("total").alias("total"))
    blocks = blocks.select(F.col("conv").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), until(Window.partitionBy(*key).orderBy("block")).alias("origin"))
    # Structs are compared field by field, nulls first.
    lots = lots.withColumn("within", until(Window.partitionBy(*key, "block").orderBy("lot")))
    lots = lots.join(blocks, lots["conv"].eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    lots = lots.select("c", "p", F.col("lot").alias("l"), (F.col("origin") + F.col("within")).alias("origin"))
    in_lot = Window.partitionBy(*key, "lot").orderBy("body").rowsBetween(Window.unboundedPreceding, -1)
    placed = made.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(in_lot), F.lit(0)))
    met = placed.join(lots, placed["conv"].eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & placed["lot"].eqNullSafe(F.col("l")))
    met = met.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    start = F.col("origin") + F.col("before") + F.col("copy") * F.col("size")
    learned = F.col("role") == "assistant"
    return met.select(
        F.col("conv").alias(conv),
        "perspective",
        F.col("turn").alias(turn),
        "speaker",
        "role",
        "segment",
        start.cast("long").alias("start"),
        F.when(learned, start + F.char_length("head")).cast("long").alias("mask_start"),
        F.when(learned, start + F.col("size")).cast("long").alias("mask_end"),
    )


def assemble(segments: DataFrame, conv: str = "conv_id", max_turns: int = 4096) -> DataFrame:
    """(conv, perspective, rendering, masks) of the dialogues of at most ``max_turns`` turns.

    Longer ones stay as segments; ``max_turns`` is what bounds a task.
    """
    sizes = segments.groupBy(conv, "perspective").agg(F.count("*").alias("n")).where(F.col("n") <= max_turns).select(F.col(conv).alias("c"), F.col("perspective").alias("p"))
    short = segments.join(sizes, segments[conv].eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")), "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end")))
    gathered = short.groupBy(conv, "perspective").agg(parts.alias("parts"))
    return gathered.select(
        conv,
        "perspective",
        F.array_join(F.transform("parts", lambda x: x["segment"]), "").alias("rendering"),
        F.transform(F.filter("parts", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end"))).alias("masks"),
    )
