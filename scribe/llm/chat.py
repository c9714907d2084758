"""Chat formatting by Spark expressions only: sorted turn structs, merged neighbours, reversible escapes, a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: [INST] role [/INST]text[SEP]text</s>. A text never holds one of these unescaped.
OPEN, CLOSE, NEXT, END = "[INST] ", " [/INST]", "[SEP]", "</s>"


def escape(text: Column) -> Column:
    """One more backslash inside everything that looks like a control string, escaped or not; see unescape()."""
    text = F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2")
    return F.regexp_replace(text, r"\[(\\*)(/?INST\]|SEP\])", r"[\\$1$2")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<\\(\\*)(/?s>)", r"<$1$2")
    return F.regexp_replace(text, r"\[\\(\\*)(/?INST\]|SEP\])", r"[$1$2")


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, n_blocks, segments, formatted), one row per conversation.

    Turns go by (turn, role, text), nulls first; neighbours of one role share a block. `segments` are the pieces of
    `formatted` in order, `loss` marking the texts of the role to learn. Null roles and texts count as empty, rows with
    a null conv_id make one conversation of their own, repeated rows stay, other columns are ignored and an empty table
    gives no row. A conversation is one row of the result by contract, so its turns meet in one place; nothing else does.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chats = chats.withColumn(
        "marked",
        F.transform(
            "turns",
            lambda t, i: F.struct(t["role"].alias("role"), t["text"].alias("text"), ((i == 0) | (t["role"] != F.element_at("turns", F.when(i > 0, i).otherwise(1))["role"])).alias("first"), i.alias("i")),
        ),
    )

    def pieces(t: Column) -> Column:
        head = F.concat(F.when(t["i"] > 0, F.lit(END)).otherwise(""), F.lit(OPEN), escape(t["role"]), F.lit(CLOSE))
        return F.array(
            F.struct(F.when(t["first"], head).otherwise(F.lit(NEXT)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == learn).alias("loss")),
        )

    segments = F.concat(F.flatten(F.transform("marked", pieces)), F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))))
    return (
        chats.select("conv_id", F.size(F.filter("marked", lambda t: t["first"])).cast("long").alias("n_blocks"), segments.alias("segments"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""

    def block(b: Column) -> Column:
        at = F.instr(b, CLOSE)
        role = unescape(F.substring(b, F.lit(len(OPEN) + 1), at - len(OPEN) - 1))
        texts = F.split(F.substring(b, at + len(CLOSE), F.length(b)), r"\[SEP\]")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    blocks = F.split(formatted, "</s>")
    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), block))


def chat_digest(chats: DataFrame) -> DataFrame:
    """What the contract asks for, read back from format_chats()."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = chats.select("conv_id", "formatted", "n_blocks", read_turns(F.col("formatted")).alias("turns"), loss.alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


def with_planted(turns: DataFrame) -> DataFrame:
    """The contract's conversation -7, whose texts are control strings."""
    spark, said = turns.sparkSession, "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (
  SELECT *, coalesce(role <> lag(role) OVER w, true) AS first, row_number() OVER w AS i,
    regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\]|SEP\])', '[\\\1\2', 'g') AS esc,
    regexp_replace(regexp_replace(role, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\]|SEP\])', '[\\\1\2', 'g') AS esc_role
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(length(esc) + CASE WHEN first THEN 15 + length(esc_role) + CASE WHEN i > 1 THEN 4 ELSE 0 END ELSE 5 END) + 4)::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE first) AS n_blocks
FROM t GROUP BY conv_id
"""
