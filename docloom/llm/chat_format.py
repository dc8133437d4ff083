"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as a sequence of turns

    <s><<SYS>>role<</SYS>>text</s>                     for the assistant (under the loss mask)
    <s><<SYS>>role<</SYS>>[INST]text[/INST]</s>        for all other roles

and read back by a deterministic parser (split at the turn end, then fixed marks).
A conversation whose recovered turns differ from the source, or whose texts hold a
control string, is rendered again with these strings escaped. Escaping puts a caret
behind the first character of a control string, ``</s>`` -> ``<^/s>``, and one more
where carets stand already, ``<^/s>`` -> ``<^^/s>``; no control string is left and
taking one caret away restores every text. So the first escaped rendering reads back
identically, and there are two levels: plain and escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

ASSISTANT = "assistant"
OPEN, CLOSE = "<s><<SYS>>", "</s>"
ROLE_END = "<</SYS>>"
ASK, ASK_END = "[INST]", "[/INST]"
#: Renderings whose texts are escaped follow the plain one; their first line names the level.
LEVELS = 1
_CONTROL = r"(/?s>|/?INST\]|</?SYS>>)"
PROBE_ID, PROBE_TEXT = -1, "</s>[INST] ok [/INST]"
_TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column, levels: int) -> Column:
    for _ in range(levels):
        text = F.regexp_replace(text, r"([<\[])(\^*)" + _CONTROL, "$1^$2$3")
    return text


def unescape(text: Column, levels: int) -> Column:
    for _ in range(levels):
        text = F.regexp_replace(text, r"([<\[])\^(\^*)" + _CONTROL, "$1$2$3")
    return text


def holds_control(text: Column) -> Column:
    return text.rlike(r"[<\[]" + _CONTROL)


def head(level: int) -> str:
    return f"#{level}\n"


def render(turns: Column, level: int) -> Column:
    """The conversation as one string, texts and roles escaped ``level`` times."""

    def turn(t: Column) -> Column:
        text = escape(t["text"], level)
        body = F.when(t["role"] == ASSISTANT, text).otherwise(F.concat(F.lit(ASK), text, F.lit(ASK_END)))
        return F.concat(F.lit(OPEN), escape(t["role"], level), F.lit(ROLE_END), body, F.lit(CLOSE))

    return F.concat(F.lit(head(level)), F.array_join(F.transform(turns, turn), ""))


def parse(formatted: Column, level: int) -> Column:
    """The turns of a rendering: role, text; a part without the marks of a turn yields nulls."""
    body = F.substring(formatted, len(head(level)) + 1, 1 << 30)
    parts = F.split(body, CLOSE)
    whole = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.lit(True))

    def turn(p: Column) -> Column:
        at = F.instr(p, ROLE_END)
        role = F.when(F.startswith(p, F.lit(OPEN)) & (at > 0), F.substring(p, len(OPEN) + 1, at - len(OPEN) - 1))
        rest = F.substring(p, at + len(ROLE_END), 1 << 30)
        asked = F.startswith(rest, F.lit(ASK)) & F.endswith(rest, F.lit(ASK_END))
        text = F.when(role == ASSISTANT, rest).when(asked, F.substring(rest, len(ASK) + 1, F.length(rest) - len(ASK) - len(ASK_END)))
        return F.struct(unescape(role, level).alias("role"), unescape(text, level).alias("text"))

    return F.transform(whole, turn).cast(_TURNS)


def format_conversations(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, ...) -> conv_id, formatted, level, turns (read back), round_trip.

    Turns are ordered by turn (null first), ties by role and text, so that repeated
    rows stay and their order is defined. Null roles and texts count as empty; a null
    conv_id is a conversation of its own; an empty table gives an empty result. Texts
    of any length are one value each, as is a conversation; other columns are not read.
    """
    clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).cast(_TURNS).alias("source"))
    level, formatted = F.lit(LEVELS), render(F.col("source"), LEVELS)
    for k in reversed(range(LEVELS)):
        fits = F.coalesce(parse(render(F.col("source"), k), k) == F.col("source"), F.lit(False))
        if not k:
            fits = fits & ~F.exists("source", lambda t: holds_control(t["text"]) | holds_control(t["role"]))
        level = F.when(fits, F.lit(k)).otherwise(level)
    whole = whole.withColumn("level", level)
    for k in reversed(range(LEVELS)):
        formatted = F.when(F.col("level") == k, render(F.col("source"), k)).otherwise(formatted)
    done = whole.withColumn("formatted", formatted)
    back = parse(F.col("formatted"), LEVELS)
    for k in reversed(range(LEVELS)):
        back = F.when(F.col("level") == k, parse(F.col("formatted"), k)).otherwise(back)
    return done.withColumn("turns", back).select("conv_id", "formatted", "level", "turns", F.coalesce(F.col("turns") == F.col("source"), F.lit(False)).alias("round_trip"))


def with_probe(rows: DataFrame) -> DataFrame:
    """rows and conversation -1, whose two turns consist of control strings."""
    probe = rows.sparkSession.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, ASSISTANT, PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).union(probe)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and the probe, read back from their renderings; awkward rows as in ``format_conversations``."""
    done = format_conversations(with_probe(table(spark, sf_dir, "conversations")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == ASSISTANT), lambda t: t["text"]), "")
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), F.col("level").cast("long").alias("escape_level"))


_TEXT = "coalesce(text, '')"
_ALL = f"(SELECT conv_id, turn, coalesce(role, '') AS role, {_TEXT} AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{PROBE_TEXT}'), (-1, 1, 'assistant', '{PROBE_TEXT}'))"
#: A conversation is escaped where one of its texts or roles holds a control string.
OP4_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, role, text,
         regexp_replace(role, '([<\\[])(\\^*)(/?s>|/?INST\\]|</?SYS>>)', '\\1^\\2\\3', 'g') AS role_1,
         regexp_replace(text, '([<\\[])(\\^*)(/?s>|/?INST\\]|</?SYS>>)', '\\1^\\2\\3', 'g') AS text_1
  FROM {_ALL} AS all_rows
), conv AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         max(CASE WHEN length(role_1) + length(text_1) > length(role) + length(text) AND regexp_matches(role || chr(10) || text, '[<\\[](/?s>|/?INST\\]|</?SYS>>)') THEN 1 ELSE 0 END) AS level,
         sum(length(role) + length(text) + CASE WHEN role = 'assistant' THEN 22 ELSE 35 END) AS chars_0,
         sum(length(role_1) + length(text_1) + CASE WHEN role = 'assistant' THEN 22 ELSE 35 END) AS chars_1
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(3 + CASE WHEN level = 0 THEN chars_0 ELSE chars_1 END AS BIGINT) AS formatted_chars, CAST(level AS BIGINT) AS escape_level
FROM conv
"""
