"""Chat formatting of preference pairs.

Of a pair of conversations the longest common prefix of turns (equal role and text) is rendered once as the prompt. What
follows in each is rendered as its completion, with a mask of the characters to learn: the texts of assistant turns.

Defined results: turns are ordered by turn, then role, then text, nulls first; repeated turns are kept. Null roles and texts count as
empty. Conversations with a null id are in no pair, and a pair that lacks one of its conversations is left out. If one
conversation begins the other, its completion is empty. A conversation is the unit of work, like a text elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARNED = "assistant"


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _rendered(turn: Column) -> Column:
    return F.concat(_head(turn["role"]), turn["text"], F.lit("\n"))


def conversations_of(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: id and its turns in order."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def pairs_of_neighbours(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``(pair_id, chosen, rejected)``: conversations 2k and 2k + 1; the one with more assistant text is chosen, then the first."""
    each = turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.sum(F.when(F.col("role") == LEARNED, F.length(F.coalesce("text", F.lit("")))).otherwise(0)).alias("said")
    )
    pair = F.floor(F.col("id") / 2).cast("long") if dict(turns.dtypes)[id_col] not in ("int", "bigint") else F.shiftright(F.col("id").cast("long"), 1)
    sides = each.withColumn("pair_id", pair)
    a = sides.where(F.pmod("id", F.lit(2)) == 0).select("pair_id", F.col("id").alias("a"), F.col("said").alias("said_a"))
    b = sides.where(F.pmod("id", F.lit(2)) == 1).select("pair_id", F.col("id").alias("b"), F.col("said").alias("said_b"))
    first = F.col("said_a") >= F.col("said_b")
    return a.join(b, "pair_id").select("pair_id", F.when(first, F.col("a")).otherwise(F.col("b")).alias("chosen"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("rejected"))


def with_other_replies(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turns of conversations 2c and 2c + 1 for each conversation c: itself, and the same with another last reply.

    The other one is c up to its last assistant turn, and then the last assistant turn of conversation ``c ^ 1``; without such
    a reply it just ends, and where c has none either the reply follows its last turn. So both share all turns
    before, and one conversation has one pair. Turns without a number come first. The id is a whole number.
    """
    known = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = F.col("role") == LEARNED
    ends = known.groupBy("id").agg(
        F.coalesce(F.max(F.when(said, F.col("turn"))), F.max("turn") + 1).alias("last"), F.max(F.when(said, F.struct("turn", "text"))).alias("reply")
    )
    own = known.select((2 * F.col("id")).alias(id_col), "turn", "role", "text")
    begin = known.join(ends.select("id", "last"), "id").where("turn IS NULL OR turn < last").select(2 * F.col("id") + 1, "turn", "role", "text")
    replies = ends.where("reply IS NOT NULL").select(F.col("id").bitwiseXOR(F.lit(1).cast("long")).alias("id"), F.col("reply.text").alias("text"))
    end = replies.join(ends.select("id", "last"), "id").select(2 * F.col("id") + 1, F.col("last"), F.lit(LEARNED), "text")
    return own.union(begin).union(end)


def pairs_of_replies(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``(pair_id, chosen, rejected)`` for the turns that ``with_other_replies`` made: a conversation is preferred to its variant."""
    each = turns.where(F.col(id_col) % 2 == 0).select(F.col(id_col).alias("chosen")).distinct()
    return each.select(F.shiftright("chosen", 1).alias("pair_id"), "chosen", (F.col("chosen") + 1).alias("rejected"))


def _completion(rest: Column) -> Column:
    """Text of the turns and the character ranges of assistant texts in it."""
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("mask"))

    def add(done, turn):
        begin = (F.length(done["text"]) + F.length(_head(turn["role"]))).cast("long")
        span = F.struct(begin.alias("from"), (begin + F.length(turn["text"])).alias("to"))
        mask = F.when((turn["role"] == LEARNED) & (turn["text"] != ""), F.array_append(done["mask"], span)).otherwise(done["mask"])
        return F.struct(F.concat(done["text"], _rendered(turn)).alias("text"), mask.alias("mask"))

    return F.aggregate(rest, start, add)


def preference_rows(turns: DataFrame, pairs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per pair: pair_id, chosen_id, rejected_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask."""
    talks = conversations_of(turns, id_col)
    both = pairs.join(talks.select(F.col("id").alias("chosen"), F.col("turns").alias("a")), "chosen")
    both = both.join(talks.select(F.col("id").alias("rejected"), F.col("turns").alias("b")), "rejected")
    same = F.zip_with("a", "b", lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]) & x.isNotNull() & y.isNotNull())
    differs = F.array_position(same, False)
    both = both.withColumn("common", F.when(differs > 0, differs - 1).otherwise(F.size("a")).cast("int"))
    rest = lambda side: F.filter(side, lambda _, i: i >= F.col("common"))
    prompt = F.array_join(F.transform(F.filter("a", lambda _, i: i < F.col("common")), _rendered), "")
    done = both.select("pair_id", F.col("chosen").alias("chosen_id"), F.col("rejected").alias("rejected_id"), F.col("common").cast("long").alias("prompt_turns"), prompt.alias("prompt"), _completion(rest("a")).alias("a"), _completion(rest("b")).alias("b"))
    return done.select("pair_id", "chosen_id", "rejected_id", "prompt_turns", "prompt", F.col("a.text").alias("chosen"), F.col("a.mask").alias("chosen_mask"), F.col("b.text").alias("rejected"), F.col("b.mask").alias("rejected_mask"))


def mask_text(mask: Column) -> Column:
    """A mask as text, ``from-to`` and commas."""
    return F.array_join(F.transform(mask, lambda s: F.concat(s["from"].cast("string"), F.lit("-"), s["to"].cast("string"))), ",")


ORACLE = """
WITH raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ends AS (
  SELECT conv_id, coalesce(max(turn) FILTER (WHERE role = 'assistant'), max(turn) + 1) AS last, first(text ORDER BY turn DESC NULLS LAST, text DESC) FILTER (WHERE role = 'assistant') AS reply
  FROM raw GROUP BY conv_id),
made AS (
  SELECT 2 * conv_id AS conv_id, turn, role, text FROM raw
  UNION ALL SELECT 2 * r.conv_id + 1, r.turn, r.role, r.text FROM raw r JOIN ends e ON e.conv_id = r.conv_id WHERE r.turn IS NULL OR r.turn < e.last
  UNION ALL SELECT 2 * a.conv_id + 1, a.last, 'assistant', b.reply FROM ends a JOIN ends b ON b.conv_id = xor(a.conv_id, 1) WHERE b.reply IS NOT NULL),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, role, text FROM made),
pairs AS (SELECT conv_id AS pair_id, 2 * conv_id AS chosen_id, 2 * conv_id + 1 AS rejected_id FROM ends WHERE 2 * conv_id + 1 IN (SELECT conv_id FROM made)),
differ AS (
  SELECT p.pair_id, min(coalesce(x.k, y.k)) - 1 AS common
  FROM pairs p JOIN (SELECT p.pair_id, t.* FROM pairs p JOIN turns t ON t.conv_id = p.chosen_id) x ON x.pair_id = p.pair_id
  FULL JOIN (SELECT p.pair_id, t.* FROM pairs p JOIN turns t ON t.conv_id = p.rejected_id) y ON y.pair_id = x.pair_id AND y.k = x.k AND y.role = x.role AND y.text = x.text
  WHERE y.k IS NULL GROUP BY p.pair_id),
shared AS (
  SELECT p.*, coalesce(d.common, (SELECT count(*) FROM turns t WHERE t.conv_id = p.chosen_id)) AS common FROM pairs p LEFT JOIN differ d ON d.pair_id = p.pair_id),
sides AS (SELECT pair_id, common, 'c' AS side, chosen_id AS conv_id FROM shared UNION ALL SELECT pair_id, common, 'r', rejected_id FROM shared),
shown AS (SELECT s.pair_id, s.side, s.common, t.k, t.role, t.text, '<|' || t.role || '|>' || chr(10) AS head, '<|' || t.role || '|>' || chr(10) || t.text || chr(10) AS line FROM sides s JOIN turns t ON t.conv_id = s.conv_id),
placed AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY pair_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begins FROM shown WHERE k > common),
completed AS (
  SELECT pair_id, side, string_agg(line, '' ORDER BY k) AS text,
         string_agg(CASE WHEN role = 'assistant' AND text <> '' THEN CAST(CAST(begins AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begins AS BIGINT) + length(text) AS VARCHAR) END, ',' ORDER BY k) AS mask
  FROM placed GROUP BY pair_id, side),
prompts AS (SELECT pair_id, string_agg(line, '' ORDER BY k) AS prompt FROM shown WHERE side = 'c' AND k <= common GROUP BY pair_id)
SELECT s.pair_id, s.pair_id AS chosen_id, xor(s.pair_id, 1) AS rejected_id, CAST(s.common AS BIGINT) AS prompt_turns, coalesce(q.prompt, '') AS prompt, coalesce(c.text, '') AS chosen, coalesce(c.mask, '') AS chosen_mask,
       coalesce(r.text, '') AS rejected, coalesce(r.mask, '') AS rejected_mask
FROM shared s LEFT JOIN prompts q ON q.pair_id = s.pair_id LEFT JOIN completed c ON c.pair_id = s.pair_id AND c.side = 'c' LEFT JOIN completed r ON r.pair_id = s.pair_id AND r.side = 'r'
"""
