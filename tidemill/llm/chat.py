"""Preference formatting of conversations, by DataFrame functions alone.

A pair has a chosen and a rejected conversation. The longest common prefix of their turns is rendered once as prompt; what
follows on each side is rendered as its completion, with the spans that carry a loss: assistant turns and their end marks.
Other turns of a completion are masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

END = "<|end|>"
LEARNED = "assistant"


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def _turn(t: Column) -> Column:
    return F.concat(_head(t), t["text"], F.lit(END + "\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def _mask(turns: Column) -> Column:
    """start:end of every learned stretch of the rendered turns, in code points, end exclusive, joined by commas."""

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_head(t))
        span = F.concat_ws(":", start, start + F.length(t["text"]) + len(END))
        out = F.when(t["role"] == LEARNED, F.concat(acc["out"], F.when(acc["out"] == "", "").otherwise(","), span)).otherwise(acc["out"])
        return F.struct((acc["at"] + F.length(_turn(t))).alias("at"), out.alias("out"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)["out"]


def render_preferences(pairs: DataFrame) -> DataFrame:
    """Rows (pair_id, chosen, rejected), sides being arrays of (role, text) without nulls in them, to one row for each.

    pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask. Turns are equal if role and text are. A side that
    ends with the prompt has an empty completion and mask; an empty or null side has null ones, and then there is no prompt turn.
    """
    pairs = pairs.select("pair_id", *(F.coalesce(side, F.array().cast("array<struct<role:string,text:string>>")).alias(c) for side, c in (("chosen", "c"), ("rejected", "r"))))
    equal = F.zip_with("c", "r", lambda x, y: x.eqNullSafe(y))  # the shorter side is filled by nulls, which equal no turn
    differ = F.array_position(equal, F.lit(False))
    pairs = pairs.withColumn("n", F.when(differ == 0, F.size("c")).otherwise(differ - 1).cast("int"))
    rest = {side: F.slice(F.col(side), F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0))) for side in ("c", "r")}
    pairs = pairs.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), *(F.when(F.size(s) > 0, rest[s]).alias(s) for s in rest))
    return pairs.select(
        "pair_id", F.col("n").cast("long").alias("n_prompt_turns"), _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"), _rendered(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"),
    )


def _ordered(turns: DataFrame, key: str, side: str) -> DataFrame:
    """key, c and r: the turns of side 0 and side 1 in order, each an array of (role, text); rows whose key is null take no part."""
    one = F.struct(F.col(side).alias("side"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    every = turns.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(one)).alias("all"))
    bare = lambda n: F.transform(F.filter("all", lambda t: t["side"] == n), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return every.select(key, bare(0).alias("c"), bare(1).alias("r"))


def format_preferences(turns: DataFrame) -> DataFrame:
    """Rows (pair_id, side, turn, role, text), side 0 chosen and 1 rejected, to one row for each pair, as render_preferences gives it.

    Turns stand in order of turn, then role, then text (null turns first); repeated rows count once; null roles and texts are
    empty. Rows whose pair_id is null take no part, nor do those of other sides, but for a pair that has only such. Other columns are
    ignored; an empty table gives no row.
    """
    return render_preferences(_ordered(turns, "pair_id", "side").select("pair_id", F.col("c").alias("chosen"), F.col("r").alias("rejected")))


def _last_learned(turns: Column) -> Column:
    """Place, from 1, of the last learned turn; 0 without any."""
    back = F.array_position(F.transform(F.reverse(turns), lambda t: t["role"] == LEARNED), F.lit(True))
    return F.when(back > 0, F.size(turns) - back + 1).otherwise(0).cast("int")


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """pair_id, chosen and rejected of every conversation (conv_id, turn, role, text): rejected are the same turns, but the last
    assistant turn says what that of the neighbour (of 2k and 2k + 1 the other one) says.

    Without an assistant turn both sides are alike; where only the neighbour has none, rejected lacks that turn. Order, repeats and
    nulls as in format_preferences.
    """
    both = _ordered(conversations.withColumn("side", F.col("conv_id").bitwiseAND(F.lit(1).cast("long")).cast("int")).withColumn("k", F.shiftright("conv_id", 1)), "k", "side")
    both = both.select("k", "c", "r", _last_learned(F.col("c")).alias("lc"), _last_learned(F.col("r")).alias("lr"))

    def pair(bit: int, own: str, last: str, other: str, its: str) -> Column:
        head, tail = F.slice(own, F.lit(1), F.greatest(F.col(last) - 1, F.lit(0))), F.slice(own, F.col(last) + 1, F.size(own))
        rejected = F.when(F.col(last) == 0, F.col(own)).otherwise(F.concat(head, F.slice(other, F.greatest(its, F.lit(1)), F.when(F.col(its) > 0, 1).otherwise(0)), tail))
        return F.struct((F.shiftleft("k", 1) + bit).alias("pair_id"), F.col(own).alias("chosen"), rejected.alias("rejected"))

    return both.select(F.explode(F.array(pair(0, "c", "lc", "r", "lr"), pair(1, "r", "lr", "c", "lc"))).alias("p")).select("p.*").where(F.size("chosen") > 0)


def op7_preference_chat(spark, sf_dir):
    """The table names no pairs: every conversation is preferred to itself with its last answer swapped for its neighbour's."""
    return render_preferences(swapped_answers(table(spark, sf_dir, "conversations")))


OP7_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t
), last AS (
  SELECT conv_id, max(i) AS i, arg_max(text, i) AS text FROM o WHERE role = 'assistant' GROUP BY 1
), sides AS (
  SELECT conv_id AS pair_id, 0 AS side, i AS j, role, text FROM o
  UNION ALL
  SELECT o.conv_id, 1, o.i, o.role, CASE WHEN o.i = mine.i THEN other.text ELSE o.text END
  FROM o LEFT JOIN last mine ON mine.conv_id = o.conv_id LEFT JOIN last other ON other.conv_id = xor(o.conv_id, 1)
  WHERE mine.i IS NULL OR o.i <> mine.i OR other.i IS NOT NULL
), n AS (
  SELECT pair_id, side, role, text, row_number() OVER (PARTITION BY pair_id, side ORDER BY j) AS i,
         '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown
  FROM sides
), d AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.i, b.i)) AS first
  FROM (SELECT * FROM n WHERE side = 0) a FULL JOIN (SELECT * FROM n WHERE side = 1) b ON a.pair_id = b.pair_id AND a.i = b.i
  WHERE a.i IS NULL OR b.i IS NULL OR a.role <> b.role OR a.text <> b.text GROUP BY 1
), p AS (
  SELECT n.pair_id, coalesce(any_value(d.first), max(i) + 1) - 1 AS k, count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1
  FROM n LEFT JOIN d USING (pair_id) GROUP BY n.pair_id
), c AS (
  SELECT n.*, p.k, coalesce(sum(length(shown)) OVER (PARTITION BY n.pair_id, side, i > p.k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM n JOIN p USING (pair_id)
), s AS (
  SELECT *, CAST(off + length(head) AS BIGINT)::VARCHAR || ':' || CAST(off + length(head) + length(text) + 7 AS BIGINT)::VARCHAR AS span FROM c
), g AS (
  SELECT pair_id,
         string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND i <= k) AS prompt,
         string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND i > k) AS chosen,
         string_agg(span, ',' ORDER BY i) FILTER (side = 0 AND i > k AND role = 'assistant') AS chosen_mask,
         string_agg(shown, '' ORDER BY i) FILTER (side = 1 AND i > k) AS rejected,
         string_agg(span, ',' ORDER BY i) FILTER (side = 1 AND i > k AND role = 'assistant') AS rejected_mask
  FROM s GROUP BY pair_id
)
SELECT pair_id, CAST(k AS BIGINT) AS n_prompt_turns, coalesce(prompt, '') AS prompt,
       CASE WHEN n0 > 0 THEN coalesce(chosen, '') END AS chosen, CASE WHEN n0 > 0 THEN coalesce(chosen_mask, '') END AS chosen_mask,
       CASE WHEN n1 > 0 THEN coalesce(rejected, '') END AS rejected, CASE WHEN n1 > 0 THEN coalesce(rejected_mask, '') END AS rejected_mask
FROM g JOIN p USING (pair_id)
"""
