"""Chat formatting by perspective rotation.

For every participant of a dialogue the dialogue is rendered once with that
speaker as the assistant and all others as named users; the training mask
covers exactly what the assistant says.

A long dialogue is rendered in segments of consecutive turns, so no task ever
holds more than a bounded number of messages of one dialogue.  Everything is
built from DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.components import apart
from pricelens.session import checkpoint

SEGMENT_TURNS = 64
# Different messages of one segment that are rendered together; a segment with
# more (many messages at one turn) is cut into parts, in its order.
PART_MESSAGES = 256
CONTEXT_ROLES = ("system",)
UNNAMED = "unknown"


def _plain(text: F.Column) -> F.Column:
    """Text in which no marker of the chat format can be forged."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _numbered(said: DataFrame, part_messages: int) -> DataFrame:
    """Distinct messages of crowded segments with their ``part``: part k has the next
    ``part_messages`` after part k - 1, in the order of turn, speaker and text.

    The messages are sorted by ranges, so that a segment of any size spreads over
    the tasks; a message's place is the number of rows in the ranges before its
    own and its place there, counted from the first message of its segment.
    """
    order = ["conv_id", "segment", "turn", "speaker", "said"]
    placed = said.distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    placed = checkpoint(placed.select(*order, F.shiftright("id", 33).alias("range"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    # one row for each range
    before = placed.groupBy("range").agg(F.count("*").alias("size")).withColumn("end", F.sum("size").over(Window.orderBy("range")))
    placed = placed.join(F.broadcast(before.select("range", (F.col("end") - F.col("size")).alias("before"))), "range").withColumn("place", F.col("before") + F.col("at"))
    first = placed.groupBy("conv_id", "segment").agg(F.min("place").alias("first")).select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), "first")
    placed = placed.join(apart(first), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")))
    return placed.select("conv_id", "turn", "speaker", "said", "segment", F.floor((F.col("place") - F.col("first")) / part_messages).cast("long").alias("part"))


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                        text_col: str = "text", context_roles: Sequence[str] = CONTEXT_ROLES,
                        segment_turns: int = SEGMENT_TURNS, part_messages: int = PART_MESSAGES) -> DataFrame:
    """One row for each (dialogue, participant, segment, part).

    Participants are the distinct speakers (``role_col``) except
    ``context_roles``, whose messages keep their role in every rendering.
    Columns: ``conv_id``, ``perspective``, ``segment`` (turn divided by
    ``segment_turns``; -1 for null turns), ``part``, ``n_messages``,
    ``n_trained`` (messages of the assistant), ``text`` and ``mask``: the
    [start, end) code-point ranges of ``text`` to train on.  The segments of a
    dialogue, in the order of (segment, part), are its rendering.

    Messages stand in the order of turn, speaker, text; rows equal in dialogue,
    turn, speaker and text count once.  A null speaker is called ``unknown``, a
    null text is empty, null dialogue ids form one dialogue, and null turns come
    first.  A dialogue without participants gives no row, an empty table an
    empty result; other columns are ignored whatever their names.
    """
    said = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(UNNAMED)).alias("speaker"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("said"))
    said = said.withColumn("segment", F.coalesce(F.floor(F.col("turn") / segment_turns), F.lit(-1)).cast("long"))
    is_context = F.col("speaker").isin(*context_roles) if context_roles else F.lit(False)
    people = said.filter(~is_context).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()

    key = F.xxhash64("turn", "speaker", "said")
    crowded = (said.groupBy("conv_id", "segment").agg(F.count_distinct(key).alias("n"))
               .filter(F.col("n") > part_messages).select(F.col("conv_id").alias("c"), F.col("segment").alias("s")))
    met = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s"))
    plain = said.join(crowded, met, "left_anti").withColumn("part", F.lit(0).cast("long"))
    said = plain.unionByName(_numbered(said.join(crowded, met, "left_semi"), part_messages))
    # collect_set drops repeated rows before the shuffle
    segments = said.groupBy("conv_id", "segment", "part").agg(
        F.array_sort(F.collect_set(F.struct("turn", "speaker", "said"))).alias("messages"))

    def head(m):
        mine, context = m["speaker"] == F.col("perspective"), m["speaker"].isin(*context_roles) if context_roles else F.lit(False)
        return F.concat(F.lit("<|"), F.when(context, m["speaker"]).when(mine, "assistant").otherwise(
            F.concat(F.lit("user name="), _plain(m["speaker"]))), F.lit("|>\n"))

    seen = segments.join(people, F.col("conv_id").eqNullSafe(F.col("of")))
    seen = seen.withColumn("shown", F.transform("messages", lambda m: F.struct(
        head(m).alias("head"), F.concat(_plain(m["said"]), F.lit("\n<|end|>")).alias("body"),
        (m["speaker"] == F.col("perspective")).alias("mine"))))
    length = F.transform("shown", lambda s: F.char_length(s["head"]) + F.char_length(s["body"]) + 1)
    seen = seen.withColumn("length", length)
    marks = F.transform("shown", lambda s, i: F.struct(
        s["mine"].alias("mine"),
        (F.aggregate(F.slice("length", F.lit(1), i), F.lit(0), lambda a, x: a + x) + F.char_length(s["head"])).cast("long").alias("start"),
        (F.aggregate(F.slice("length", F.lit(1), i + 1), F.lit(0), lambda a, x: a + x) - 1).cast("long").alias("end")))
    return seen.select(
        "conv_id", "perspective", "segment", "part", F.size("messages").cast("long").alias("n_messages"),
        F.size(F.filter("shown", lambda s: s["mine"])).cast("long").alias("n_trained"),
        F.array_join(F.transform("shown", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "").alias("text"),
        F.transform(F.filter(marks, lambda m: m["mine"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias("mask"))


QUERY_SQL = """
WITH said AS (
  SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said,
         coalesce(CAST(floor(turn / 64.0) AS BIGINT), -1) AS segment
  FROM conversations),
parted AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, segment ORDER BY turn NULLS FIRST, speaker, said) - 1) // 256 AS part FROM said),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
shown AS (
  SELECT s.conv_id, p.perspective, s.segment, s.part, s.turn, s.speaker, s.said, s.speaker = p.perspective AS mine,
         '<|' || CASE WHEN s.speaker = 'system' THEN s.speaker WHEN s.speaker = p.perspective THEN 'assistant'
                      ELSE 'user name=' || replace(s.speaker, '<|', '< |') END || '|>' || chr(10) AS head,
         replace(s.said, '<|', '< |') || chr(10) || '<|end|>' AS body
  FROM parted s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
           PARTITION BY conv_id, perspective, segment, part ORDER BY turn NULLS FIRST, speaker, said
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM shown)
SELECT conv_id, perspective, segment, CAST(part AS BIGINT) AS part, count(*) AS n_messages,
       count(*) FILTER (mine) AS n_trained,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, speaker, said) AS text,
       coalesce(string_agg(CAST(CAST(before + length(head) AS BIGINT) AS VARCHAR) || ':' ||
                           CAST(CAST(before + length(head) + length(body) AS BIGINT) AS VARCHAR), ','
                           ORDER BY turn NULLS FIRST, speaker, said) FILTER (mine), '') AS mask
FROM placed GROUP BY conv_id, perspective, segment, part
"""
