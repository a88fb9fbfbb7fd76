"""Chat formatting by perspective: a dialogue rendered once for every participant.

In a participant's rendering their own turns are the assistant's, everyone else is a
user with a name, and the loss mask covers what the participant says, with the end
mark.  A rendering is a sequence of segments, one row for each turn, with the
segment's place in the whole string; `masks` are character ranges in that string.
No dialogue is gathered in one task: turns are dealt by range, and a segment's start
comes from sums per range, so a conversation with a third of all turns spans as many
tasks as it needs.  `dialogues` joins the segments of conversations below a stated
length to whole strings.

All of it is DataFrame functions.  Cases: system turns belong to nobody and keep
their role; a null role is a participant without a name; a null text is an empty
turn; null turns come first; turns of one number follow by role, then by text; a
repeated turn is rendered again; a conversation of system turns only has no
participant and no rows; null conversation ids form one conversation; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldrecon.llm.common import join_on, register, table
from fieldrecon.llm.runs import deal, running_sum

SYSTEM = "system"
END = "<|end|>\n"


def segments(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, turn, role, segment, start, mask_start, mask_end (equal where nothing is learned)."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    dealt = deal(rows, ["conv_id", "turn", "role", "text"], "turns")
    speaker = F.coalesce("role", F.lit(""))
    people = dealt.select("conv_id", speaker.alias("perspective")).distinct().filter(F.col("perspective") != SYSTEM)
    seen = join_on(dealt, people, ["conv_id"])
    own = speaker == F.col("perspective")
    name = F.concat(F.lit("<|user name="), speaker, F.lit("|>\n"))
    head = F.when(own, F.lit("<|assistant|>\n")).when(speaker == SYSTEM, F.lit("<|system|>\n")).otherwise(name)
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(END))
    seen = seen.withColumn("own", own).withColumn("head", F.length(head).cast("long")).withColumn("segment", F.concat(head, body))
    seen = seen.withColumn("length", F.length("segment").cast("long"))
    placed = running_sum(seen, ["conv_id", "perspective"], ["turn", "role", "text"], "length", "start")
    return placed.select(
        "conv_id", "perspective", "turn", "role", "segment", "start",
        (F.col("start") + F.col("head")).alias("mask_start"),
        (F.col("start") + F.when(F.col("own"), F.col("length")).otherwise(F.col("head"))).alias("mask_end"),
    )


def dialogues(parts: DataFrame, longest: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(whole strings with their masks for dialogues of at most `longest` characters, the segments of the others)."""
    size = parts.groupBy("conv_id", "perspective").agg(F.max(F.col("start") + F.length("segment")).alias("chars"))
    short = join_on(parts, size.filter(F.col("chars") <= longest).drop("chars"), ["conv_id", "perspective"], "left_semi")
    long = join_on(parts, size.filter(F.col("chars") <= longest).drop("chars"), ["conv_id", "perspective"], "left_anti")
    all_ = F.sort_array(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end")))
    whole = short.groupBy("conv_id", "perspective").agg(all_.alias("s"))
    masks = F.transform(F.filter("s", lambda x: x["mask_start"] < x["mask_end"]), lambda x: F.struct(x["mask_start"], x["mask_end"]))
    return whole.select("conv_id", "perspective", F.array_join("s.segment", "").alias("text"), masks.alias("masks")), long


@register(
    "op6_chat_formatting",
    rf"""
    WITH t AS (SELECT conv_id, turn, role, coalesce(role, '') AS speaker, text, coalesce(text, '') AS body FROM conversations),
    p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'),
    h AS (SELECT t.*, perspective, speaker = perspective AS own,
            CASE WHEN speaker = perspective THEN E'<|assistant|>\n' WHEN speaker = '{SYSTEM}' THEN E'<|system|>\n'
                ELSE '<|user name=' || speaker || E'|>\n' END AS head
        FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
    s AS (SELECT *, head || body || E'<|end|>\n' AS segment FROM h),
    a AS (SELECT *, CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective
            ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM s)
    SELECT conv_id, perspective, turn, role, segment, start, start + length(head) AS mask_start,
        start + CASE WHEN own THEN length(segment) ELSE length(head) END AS mask_end
    FROM a
    """,
)
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(table(spark, sf_dir, "conversations"))
