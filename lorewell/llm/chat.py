"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.common import table

#: Marks of the template; MARKS are the only places where < and > stand in a formatted conversation.
TURN, HEAD_END, MORE, END = "<turn|", ">\n", "<more>", "<end>\n"


def escape(c: Column) -> Column:
    """No < or > is left, so no text can look like a mark."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows -> conv_id, formatted, loss: one row per conversation.

    Turn structs are collected and sorted by turn (ties by role, then text; null turns first); neighbours of the same
    role share one header, their texts parted by MORE, so that the rows can be read back. loss lists start (0-based)
    and length, in code points of formatted, of each assistant text. Null roles and texts count as empty. Rows that
    repeat are turns of their own. Each conversation is one row of the result, so its turns meet in one task.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    df = rows.groupBy("conv_id").agg(turns.alias("turns")).withColumn("n", F.size("turns"))
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | (F.get("turns", i).role != F.get("turns", i - 1).role))
    df = df.withColumn("starts", starts)
    runs = F.transform(F.sequence(F.lit(0), F.size("starts") - 1), lambda k: F.slice("turns", F.get("starts", k) + 1, F.coalesce(F.get("starts", k + 1), F.col("n")) - F.get("starts", k)))
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    no = F.lit(False)

    def run(r: Column) -> Column:
        head = piece(F.concat(F.lit(TURN), escape(F.get(r, 0).role), F.lit(HEAD_END)), no)
        body = F.flatten(F.transform(r, lambda t, i: F.array(piece(F.when(i == 0, "").otherwise(MORE), no), piece(escape(t.text), t.role == "assistant"))))
        return F.concat(F.array(head), body, F.array(piece(F.lit(END), no)))

    df = df.withColumn("pieces", F.flatten(F.transform(runs, run)))
    place = F.aggregate(
        "pieces", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")),
        lambda a, p: F.struct((a.at + F.length(p.s)).alias("at"), F.when(p.loss, F.concat(a.loss, F.array(F.struct(a.at.alias("start"), F.length(p.s).alias("length"))))).otherwise(a.loss).alias("loss")),
    )
    return df.select("conv_id", F.array_join(F.transform("pieces", lambda p: p.s), "").alias("formatted"), place.loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>."""
    parts = F.slice(F.split(formatted, r"<turn\|"), 2, 1 << 30)

    def turns(part: Column) -> Column:
        role = unescape(F.substring_index(part, ">", 1))
        body = F.substring_index(F.substring(part, F.instr(part, HEAD_END) + len(HEAD_END), F.length(part)), "<end>", 1)
        return F.transform(F.split(body, MORE), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(parts, turns))


def loss_text(formatted: Column, loss: Column) -> Column:
    return F.array_join(F.transform(loss, lambda x: unescape(F.substring(formatted, x.start + 1, x.length))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What format_conversations() wrote, read back: counts and hashes per conversation."""
    f = F.col("formatted")
    df = formatted.select("conv_id", read_turns(f).alias("turns"), loss_text(f, F.col("loss")).alias("loss"), F.length(f).cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return df.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), "formatted_chars")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    hard = "\\### Assistant: </turn> ok"
    one = lambda turn, role: spark.range(1).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.lit(turn).cast(kinds["turn"]).alias("turn"), F.lit(role).alias("role"), F.lit(hard).alias("text"))
    return digests(format_conversations(rows.union(one(0, "user")).union(one(1, "assistant"))))


#: formatted_chars: each text with one code point more for every \, < and >, and the marks around it.
OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c
), s AS (
  SELECT conv_id, turn, role, text, before IS NOT NULL AND before = role AS more FROM r
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', ''))
           + CASE WHEN more THEN 6 ELSE 14 + length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', '')) END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
