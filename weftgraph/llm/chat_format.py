"""Multi-party chat formatting by perspective rotation, in DataFrame expressions only.

For every participant of a dialogue the dialogue is rendered once with that speaker as the assistant and all others
as named users; the mask holds the spans that the assistant says. A view comes in parts of PART utterances, so that no
row and no group grows with the length of a conversation; its parts, one after another, are the whole rendering.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.runtime import cut, read
from weftgraph.operators.labels import numbered

#: Utterances of a part.
PART = 64
#: Roles that set the scene and are nobody's perspective.
CONTEXT_ROLES = ("system",)
START, END = "<|im_start|>", "<|im_end|>"
#: What begins a mark, and what it becomes in a text: whatever a text says, it holds no mark. Taking one bar from each gives the text again.
MARK, ESCAPED = "<|", "<||"
#: Characters that a name may not have, by the code that stands for each; the percent sign first, so that no two names become one.
NAME_CODES = {c: f"%{ord(c):02X}" for c in "% \t\n\x0b\f\r<>|\""}
#: The name of a speaker without one; no other becomes it.
NAMELESS = "%"


def name_of(role: Column) -> Column:
    """The name of a speaker: different ones for different roles."""
    coded = reduce(lambda name, c: F.replace(name, F.lit(c), F.lit(NAME_CODES[c])), NAME_CODES, role)
    return F.when(role == "", F.lit(NAMELESS)).otherwise(coded)


def _segments(turns: Column, speaker: Column) -> Column:
    """Per turn its head, its body with the end mark, and whether the speaker says it."""

    def segment(t: Column) -> Column:
        own = t["role"] == speaker
        head = F.when(own, F.lit("assistant")).when(t["role"].isin(*CONTEXT_ROLES), t["role"]).otherwise(F.concat(F.lit("user name="), name_of(t["role"])))
        body = F.replace(t["text"], F.lit(MARK), F.lit(ESCAPED))
        return F.struct(F.concat(F.lit(START), head, F.lit("\n")).alias("head"), F.concat(body, F.lit(END)).alias("body"), own.alias("own"))

    return F.transform(turns, segment)


def _spans(segments: Column) -> Column:
    """Start and end, in characters, of what the speaker says; the end mark belongs to it, the line break after it doesn't."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    first = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + F.char_length(s["head"])
        end = start + F.char_length(s["body"])
        more = F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct((end + 1).alias("at"), F.when(s["own"], more).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(segments, first, step, lambda acc: acc["spans"])


def rotate_perspectives(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation, participant and part: ``conv_id, perspective, part, n_turns, context, text, spans``.

    Utterances are put in order of turn number, role and text, and PART of them at a time make a part, counted from 0; an
    ordinary conversation has part 0 alone. The parts' texts in order are the view's whole text; ``spans`` count from the
    start of a part's text. ``context`` is the conversation's first utterance of a context role, rendered, for parts that
    it does not stand in; else it is empty.

    Every row is an utterance, equal ones, too. A null role is the speaker '', a null text is empty, null turns come
    first, a null id makes a conversation of its own. A very long text is one utterance like any other. A conversation of
    context roles alone has no participant and so no row; an empty table gives none. Other columns are neither read nor
    returned.
    """
    said = turns.select(F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # places in the order of all conversations, found by ranges, which also cut a conversation that holds much of the table
    placed = cut(numbered(said, "conv_id", "turn", "role", "text"))
    context = F.col("role").isin(*CONTEXT_ROLES)
    first = placed.groupBy(F.col("conv_id").alias("of")).agg(F.min("number").alias("first"))
    scenes = placed.where(context).groupBy(F.col("conv_id").alias("scene_of")).agg(F.min(F.struct("number", "role", "text")).alias("scene"))
    known = first.join(scenes, F.col("of").eqNullSafe(F.col("scene_of")), "left").select("of", "first", "scene")
    at = placed.join(known.select("of", "first"), F.col("conv_id").eqNullSafe(F.col("of"))).withColumn("part", F.floor((F.col("number") - F.col("first")) / PART).cast("long"))
    parts = at.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("number", "role", "text"))).alias("turns"))
    speakers = placed.where(~context).select("conv_id", F.col("role").alias("perspective")).distinct()
    speakers = speakers.join(known, F.col("conv_id").eqNullSafe(F.col("of"))).drop("conv_id")
    views = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).withColumn("segments", _segments(F.col("turns"), F.col("perspective")))
    whole = lambda segments: F.concat_ws("", F.transform(segments, lambda s: F.concat(s["head"], s["body"], F.lit("\n"))))
    elsewhere = F.col("scene.number") < F.col("turns")[0]["number"]
    scene = F.when(elsewhere, whole(_segments(F.array("scene"), F.col("perspective")))).otherwise(F.lit(""))
    return views.select("conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"), scene.alias("context"), whole(F.col("segments")).alias("text"), _spans(F.col("segments")).alias("spans"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered texts of all conversations; their spans as a line of ``start-end`` and their summed length."""
    views = rotate_perspectives(read(spark, sf_dir, "conversations"))
    line = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))))
    masked = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return views.select("conv_id", "perspective", "part", "n_turns", "context", "text", line.alias("spans"), masked.alias("n_masked"))
