"""Op 10. Multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant, the others as named
users and system turns as they are; the mask spans (code points of the rendering, end exclusive) cover what the assistant
says with its closing mark, which is what a model trained on that rendering learns.

A rendering of any length is one text, stored in segments of SEGMENT turn numbers, so a conversation that holds a third of all
rows is spread over tasks: segments are numbered from 0, `start` is the place of a segment in the whole, and mask spans are
places in the whole, so that the segments joined in order are the dialogue and the spans joined in order its mask. Every
participant is rendered in every segment. Lengths, from which the places come, are counted by speaker and segment.

Rows of one turn number are ordered by speaker, then text; repeated rows are repeated messages. A null text is an empty message, a
null role the speaker `unknown`, null turns come last, in a segment of their own. A null conv_id names no conversation: each
such row is a dialogue of one turn. A conversation of system turns only has no participant and no rendering. Empty tables
give empty results; other columns, whatever their names, pass by. An opening mark inside a text, and either mark inside a role, is
broken by a space, so nobody can speak for another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT, SYSTEM, CLOSE = 512, "system", "<|end|>\n"
ASSISTANT, SYSTEM_MARK = "<|assistant|>", "<|system|>"


def _broken(text: Column, *marks: str) -> Column:
    for m in marks:
        text = F.replace(text, F.lit(m), F.lit(f"{m[0]} {m[1]}"))
    return text


def _head() -> Column:
    """The mark before a turn of somebody else."""
    return F.when(F.col("speaker") == SYSTEM, F.lit(SYSTEM_MARK)).otherwise(F.concat(F.lit("<|user name="), _broken(F.col("speaker"), "<|", "|>"), F.lit("|>")))


def places(said: DataFrame) -> DataFrame:
    """(conv_id, part, segment, perspective, start): where each participant's rendering of each part begins."""
    by_speaker = said.groupBy("conv_id", "part", "speaker").agg(F.count("*").alias("n"), F.sum(F.length("head") + F.length("body")).alias("size"), F.first(F.length("head")).alias("mark"))
    parts = by_speaker.groupBy("conv_id", "part").agg(F.sum("size").alias("size"))
    parts = parts.withColumn("segment", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("part").asc_nulls_last())) - 1)
    people = by_speaker.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    own = by_speaker.select("conv_id", F.coalesce("part", F.lit(-(1 << 62))).alias("p"), F.col("speaker").alias("perspective"), (F.col("n") * (F.col("mark") - len(ASSISTANT))).alias("less"))
    each = parts.join(people, "conv_id").withColumn("p", F.coalesce("part", F.lit(-(1 << 62)))).join(own, ["conv_id", "p", "perspective"], "left")
    before = Window.partitionBy("conv_id", "perspective").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("size") - F.coalesce("less", F.lit(0))).over(before), F.lit(0))
    return each.select("conv_id", "part", "segment", "perspective", start.alias("start"))


def rotate(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, perspective, n_messages, n_trained, start, rendered, mask [array of start, end])."""
    said = turns.select(
        "conv_id",
        F.floor(F.col("turn") / segment).cast("long").alias("part"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        F.concat(_broken(F.coalesce("text", F.lit("")), "<|"), F.lit(CLOSE)).alias("body"),
    ).withColumn("head", _head())
    named = said.where("conv_id is not null")
    where = places(named).select(F.col("conv_id").alias("conv"), F.col("part").alias("p"), "segment", "perspective", "start")
    seen = named.join(where, (F.col("conv_id") == F.col("conv")) & F.col("part").eqNullSafe(F.col("p"))).drop("conv", "p")
    own = F.col("speaker") == F.col("perspective")
    seen = seen.withColumn("head", F.when(own, F.lit(ASSISTANT)).otherwise(F.col("head")))
    group = ["conv_id", "segment", "perspective", "start"]
    order = Window.partitionBy(*group).orderBy("turn", "speaker", "body")
    placed = seen.withColumn("place", F.row_number().over(order)).withColumn("end", F.col("start") + F.sum(F.length("head") + F.length("body")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spoken = F.struct((F.col("end") - F.length("body")).alias("start"), F.col("end").alias("end"))
    whole = placed.groupBy(*group).agg(
        F.count("*").alias("n_messages"),
        F.sum(F.when(own, 1).otherwise(0)).cast("long").alias("n_trained"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("head", "body").alias("piece")))), lambda x: x["piece"]), "").alias("rendered"),
        F.array_sort(F.collect_list(F.when(own, spoken))).alias("mask"),
    )
    columns = ["conv_id", F.col("segment").cast("long").alias("segment"), "perspective", "n_messages", "n_trained", F.col("start").cast("long").alias("start"), "rendered", F.col("mask").cast("array<struct<start:long,end:long>>").alias("mask")]
    one = F.lit(1).cast("long")
    span = F.array(F.struct(F.lit(len(ASSISTANT)).cast("long").alias("start"), (F.length("body") + len(ASSISTANT)).cast("long").alias("end")))
    alone = said.where((F.col("conv_id").isNull()) & (F.col("speaker") != SYSTEM)).select(
        "conv_id", F.lit(0).cast("long").alias("segment"), F.col("speaker").alias("perspective"), one.alias("n_messages"), one.alias("n_trained"), F.lit(0).cast("long").alias("start"), F.concat(F.lit(ASSISTANT), "body").alias("rendered"), span.alias("mask")
    )
    return whole.select(*columns).unionByName(alone)


def mask_text(column: str = "mask"):
    """start:end, comma-joined."""
    return F.array_join(F.transform(F.col(column), lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
