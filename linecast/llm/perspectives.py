"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

Method. For every participant of a conversation the dialogue is rendered once with that speaker as the
assistant and all others as named users. System turns stay system turns in every rendering; they are
no participant. The mask marks the assistant's words and the token that ends them.

Scale. Conversations are rendered in parts of ``BLOCK`` consecutive turn numbers, which are what is
grouped, so a conversation with a third of all rows is many groups. Texts are shuffled once, by part;
participants and part numbers come from narrow columns and meet the parts where they already lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linecast.llm.decontam import bounded
from linecast.llm.scratch import table

BLOCK = 64
SYSTEM = "system"
NOBODY = "unknown"
START, END = "<|im_start|>", "<|im_end|>"


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Rows ``(conv, perspective, part, n_turns, n_target, n_chars, text, mask)``.

    A rendering is the concatenation of its parts by ``part`` (from 0). ``mask`` lists the character
    ranges of ``text`` to learn, ``from-to`` with ``to`` exclusive, joined by commas.

    * turns are ordered by number, those of one number by role, then text (nulls first); turns without
      number come last; more than ``block`` turns of one number are ordered by hash first;
    * a null or empty role is the speaker ``unknown``; a null text is empty;
    * repeated rows are repeated turns; a null conversation id is one conversation;
    * a conversation of system turns alone is rendered once, perspective null and nothing masked;
    * ``<|`` in texts and names is broken up as ``< |``, so no text can forge a turn;
    * an empty table gives no rows; other columns are ignored, whatever their names.
    """
    turn, text = F.col(turn_col).cast("long"), F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"<\|", "< |")
    role = F.regexp_replace(F.when(F.coalesce(F.col(role_col), F.lit("")) == "", NOBODY).otherwise(F.col(role_col)), r"<\|", "< |")
    key = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit(""))
    number = F.coalesce(F.floor(turn / F.lit(block)).cast("long"), F.lit((1 << 62)))
    base = turns.select(F.col(conv_col).alias("conv"), key.alias("key"), number.alias("block"), turn.alias("turn"), F.coalesce(turn, F.lit(1 << 62)).alias("at"), role.alias("role"), F.col(role_col).alias("raw_role"), F.col(text_col).alias("raw"), text.alias("text"))

    crowds = base.groupBy(F.col("key").alias("ckey"), F.col("at").alias("cat")).agg(F.count("*").alias("n")).where(F.col("n") > block).withColumn("split", F.ceil(F.col("n") / F.lit(block)).cast("long"))
    crowds = bounded(crowds.select("ckey", "cat", "split"), F.length("ckey") + 32)
    base = base.join(crowds, (F.col("key") == F.col("ckey")) & (F.col("at") == F.col("cat")), "left")
    inner = F.when(F.col("split").isNull(), F.lit(0)).otherwise(F.col("at") * 0 + F.pmod(F.xxhash64("raw_role", "raw"), F.col("split")) + 1)
    # a crowded number is a part of its own: (block, number, hash); the others of the block stay together
    base = base.withColumn("sub", inner).withColumn("crowd", F.when(F.col("split").isNull(), F.lit(-(1 << 62))).otherwise(F.col("at")))
    where = ["key", "block", "crowd", "sub"]

    parts = base.groupBy(*where).agg(F.min("at").alias("first"))
    parts = parts.withColumn("part", F.row_number().over(Window.partitionBy("key").orderBy("first", "crowd", "sub")) - 1)
    speakers = base.select("key", "role").where(F.col("role") != SYSTEM).distinct().groupBy("key").agg(F.array_sort(F.collect_set("role")).alias("speakers"))
    side = parts.join(speakers, "key", "left").select(*where, "part", "speakers")

    lines = base.groupBy(*where).agg(F.first("conv").alias("conv"), F.sort_array(F.collect_list(F.struct("turn", "raw_role", "raw", "role", "text"))).alias("turns"))
    views = lines.join(side, where).select("conv", "part", "turns", F.explode_outer("speakers").alias("perspective"))

    def head(t):
        other = F.when(t["role"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.concat(F.lit(START), F.when(t["role"].eqNullSafe(F.col("perspective")), F.lit("assistant")).otherwise(other), F.lit("\n"))

    shown = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), t["role"].eqNullSafe(F.col("perspective")).alias("own")))
    views = views.withColumn("shown", shown)
    views = views.withColumn("sizes", F.transform("shown", lambda s: F.char_length(s["head"]) + F.char_length(s["body"]) + 1))
    spans = F.transform("shown", lambda s, i: F.struct(s["own"].alias("own"), (F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, x: a + x) + F.char_length(s["head"])).alias("from"), F.char_length(s["body"]).alias("size")))
    views = views.withColumn("spans", F.filter(spans, lambda s: s["own"]))
    mask = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["from"].cast("string"), (s["from"] + s["size"]).cast("string"))), ",")
    whole = F.array_join(F.transform("shown", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "")
    out = views.select(F.col("conv").alias(conv_col), "perspective", F.col("part").cast("long").alias("part"), F.size("turns").cast("long").alias("n_turns"), F.size("spans").cast("long").alias("n_target"), whole.alias("text"), mask.alias("mask"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op2_perspectives(spark, sf_dir: str) -> DataFrame:
    """Every conversation of the whole table from every participant's perspective."""
    return rotate(table(spark, sf_dir, "conversations"))


ORACLE_OP2 = f"""
WITH t AS (SELECT conv_id, turn, role AS raw_role, text AS raw, turn // {BLOCK} AS block,
  replace(CASE WHEN coalesce(role, '') = '' THEN '{NOBODY}' ELSE role END, '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
parts AS (SELECT conv_id, block, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY block) - 1 AS BIGINT) AS part FROM (SELECT DISTINCT conv_id, block FROM t)),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> '{SYSTEM}'),
lines AS (SELECT t.*, s.perspective, coalesce(t.role = s.perspective, false) AS own,
  '{START}' || CASE WHEN t.role = s.perspective THEN 'assistant' WHEN t.role = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user name=' || t.role END || chr(10) AS head, t.text || '{END}' AS body
  FROM t LEFT JOIN speakers s ON t.conv_id = s.conv_id),
placed AS (SELECT *, sum(length(head) + length(body) + 1) OVER w - length(body) - 1 AS b FROM lines
  WINDOW w AS (PARTITION BY conv_id, perspective, block ORDER BY turn, raw_role NULLS FIRST, raw NULLS FIRST ROWS UNBOUNDED PRECEDING))
SELECT p.conv_id, p.perspective, parts.part, count(*) AS n_turns, count(*) FILTER (own) AS n_target,
  string_agg(head || body || chr(10), '' ORDER BY turn, raw_role NULLS FIRST, raw NULLS FIRST) AS text,
  coalesce(string_agg(CAST(b AS VARCHAR) || '-' || CAST(b + length(body) AS VARCHAR), ',' ORDER BY b) FILTER (own), '') AS mask,
  CAST(sum(length(head) + length(body) + 1) AS BIGINT) AS n_chars
FROM placed p JOIN parts ON p.conv_id = parts.conv_id AND p.block = parts.block
GROUP BY p.conv_id, p.perspective, parts.part
"""
