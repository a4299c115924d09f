"""Chat formatting by multi-party perspective rotation.

A conversation is rendered once for each of its participants: the turns of that speaker become the assistant's and
carry the loss mask, the others' become named users; system turns stay system turns in every rendering and have no
perspective of their own. A rendering is a sequence of segments, one row each, with the segment's place, its character
range in the rendering and the range of what is learned, so that a conversation of any length is never gathered.

Segment: <|role|> or <|user name=speaker|>, a line feed, the content, <|end|>, a line feed. The learned range is the
content and <|end|> of the assistant's segments. Marks of the format inside a content or a name are escaped by a
backslash after '<'.

Places are sums over blocks of BLOCK turn numbers and sums inside the blocks, so a long conversation is spread over
tasks; equal rows are counted first and unfolded by arithmetic.

Defined results: a null role is the speaker 'unknown', a null text is empty. Turns are ordered by turn (nulls first),
speaker, text. Repeated rows are turns like others. A null conv_id is a conversation. A conversation of system turns
only has no rendering. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 64
END = "<|end|>\n"


def _escaped(x: Column) -> Column:
    return F.replace(x, F.lit("<|"), F.lit("<\\|"))


def _role(speaker: Column, perspective: Column) -> Column:
    return F.when(speaker == "system", "system").when(speaker == perspective, "assistant").otherwise("user")


def _head(speaker: Column, perspective: Column) -> Column:
    role = _role(speaker, perspective)
    return F.concat(F.lit("<|"), role, F.when(role == "user", F.concat(F.lit(" name="), _escaped(speaker))).otherwise(""), F.lit("|>\n"))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, seq (from 0), turn, speaker, chat_role, segment, start, end, learn_start, learn_end (null if not learned).

    Texts are shuffled once, by conversation and block of turns. What stands before a block is found from counts and
    lengths alone and joined to the block.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    x = conversations.select("conv_id", key.alias("c"), "turn", F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(1 << 60))).alias("b"), F.coalesce(F.col("role"), F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    light = x.groupBy("c", "b", "speaker").agg(F.count("*").alias("n"), F.sum(F.length(_escaped(F.col("text"))).cast("long")).alias("chars"))
    people = light.filter("speaker <> 'system'").select("c", F.col("speaker").alias("perspective")).distinct()
    sums = light.join(people, "c")
    fixed = F.length(_head(F.col("speaker"), F.col("perspective"))) + len(END)
    sums = sums.groupBy("c", "perspective", "b").agg(F.sum("n").alias("bt"), F.sum(F.col("n") * fixed + F.col("chars")).alias("bs"))
    over = Window.partitionBy("c", "perspective").orderBy("b")
    sums = sums.select("c", "b", "perspective", (F.sum("bt").over(over) - F.col("bt")).alias("t0"), (F.sum("bs").over(over) - F.col("bs")).alias("s0"))
    x = x.repartition("c", "b").groupBy("c", "b", "conv_id", "turn", "speaker", "text").agg(F.count("*").alias("times"))
    x = x.join(sums, ["c", "b"])  # a block's turns with each participant, row by row: neither is gathered
    x = x.withColumn("head", _head(F.col("speaker"), F.col("perspective"))).withColumn("segment", F.concat("head", _escaped(F.col("text")), F.lit(END)))
    x = x.withColumn("size", F.length("segment").cast("long"))
    inside = Window.partitionBy("c", "b", "perspective").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("t1", F.sum("times").over(inside) - F.col("times")).withColumn("s1", F.sum(F.col("size") * F.col("times")).over(inside) - F.col("size") * F.col("times"))
    x = x.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    x = x.withColumn("seq", F.col("t0") + F.col("t1") + F.col("k")).withColumn("start", F.col("s0") + F.col("s1") + F.col("k") * F.col("size"))
    x = x.withColumn("end", F.col("start") + F.col("size")).withColumn("chat_role", _role(F.col("speaker"), F.col("perspective")))
    learned = F.col("chat_role") == "assistant"
    return x.select(
        "conv_id", "perspective", "seq", "turn", "speaker", "chat_role", "segment", "start", "end",
        F.when(learned, F.col("start") + F.length("head")).alias("learn_start"), F.when(learned, F.col("end") - 1).alias("learn_end"),
    )


def render(rotated: DataFrame) -> DataFrame:
    """One row per (conversation, perspective): the rendering and the learned ranges. For conversations that fit in a row."""
    x = rotated.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(F.struct("seq", "segment", "learn_start", "learn_end"))).alias("s"))
    ranges = F.filter(F.transform("s", lambda r: F.struct(r["learn_start"].alias("start"), r["learn_end"].alias("end"))), lambda r: r["start"].isNotNull())
    return x.select("conv_id", "perspective", F.array_join(F.col("s.segment"), "").alias("rendering"), ranges.alias("learned"))


#: The same rows in DuckDB.
SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role
      FROM t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || replace(speaker, '<|', '<\|') ELSE '' END || '|>' || chr(10) AS head FROM r),
s AS (SELECT *, head || replace(text, '<|', '<\|') || '<|end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, row_number() OVER w - 1 AS seq, CAST(sum(length(segment)) OVER w AS BIGINT) AS ends FROM s
      WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, seq, turn, speaker, chat_role, sha256(segment) AS segment_sha256, ends - length(segment) AS start, ends AS "end",
  CASE WHEN chat_role = 'assistant' THEN ends - length(segment) + length(head) END AS learn_start,
  CASE WHEN chat_role = 'assistant' THEN ends - 1 END AS learn_end
FROM o
"""
