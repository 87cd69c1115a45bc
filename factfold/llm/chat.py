"""Chat formatting of typed content parts, in DataFrame operations only.

A message has a role and parts (type, text, ref, units). The visitor writes text parts with their control strings escaped and
every other part as a numbered placeholder, and records for each attachment its turn, type, reference and the tokens that it
expands to. Turns are joined by a template whose marks start with ``<|``. Every ``<`` and ``[`` of a role or text is followed by a
backslash and backslashes are doubled, so neither one text nor two that meet can hold a mark, and the output can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factfold.llm.common import read

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: What control strings of this and other templates begin with. No prefix of one is left at the end of a text either.
CONTROL = r"([<\[])"
#: Stands for a part that isn't text until all of a message's placeholders are numbered; no escaped text holds it.
HOLE = "<|>"
#: Tokens of a part that isn't text: so many for each unit (image tile, second of audio, page) and so many besides.
TOKENS_PER_UNIT, TOKENS_BESIDES = {"image": 256, "audio": 25, "document": 600}, {"image": 2, "audio": 2, "document": 4}
PARTS = "array<struct<type:string,text:string,ref:string,units:long>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def text_tokens(text: Column) -> Column:
    """An estimate that needs no vocabulary: words by four characters begun, other marks one by one."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]{1,4}|[^\p{L}\p{N} \t\n\x0B\f\r]")).cast("long")


def _part_tokens(p: Column) -> Column:
    by_type = lambda table: F.coalesce(*(F.when(p["type"] == k, F.lit(v)) for k, v in table.items()), F.lit(1))
    return F.when(p["type"] == "text", text_tokens(F.coalesce(p["text"], F.lit("")))).otherwise(F.coalesce(p["units"], F.lit(1)) * by_type(TOKENS_PER_UNIT) + by_type(TOKENS_BESIDES))


def format_conversations(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, parts) to one row per conversation.

    Columns: conv_id, n_turns, formatted, loss_spans (start and length in characters of each assistant body), attachments in
    order (number, turn, type, ref, tokens) and n_tokens. Rows go by turn, equal turns by role and parts; repeated rows are
    repeated turns. Null roles and texts count as empty, null parts as no parts; a part that is null itself or of an unknown
    type is a placeholder too, its type written as in URLs. Adjacent text parts are one text. Rows with a null conv_id are one
    conversation. An empty table gives an empty result. Other columns are ignored.
    """
    parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    others = F.filter("parts", lambda p: ~p["type"].eqNullSafe("text"))
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("others", others).withColumn("first", before(F.size("others")))
    whole = F.concat_ws("", F.transform("parts", lambda p: F.when(p["type"] == "text", escape(p["text"])).otherwise(HOLE)))
    placeholder = lambda j: F.concat(F.lit("<|"), F.url_encode(F.coalesce(F.get(F.col("others"), j)["type"], F.lit("part"))), F.lit(":"), (F.col("first") + j).cast("string"), F.lit("|>"))
    shown = F.transform(F.split(whole, r"<\|>", -1), lambda g, j: F.concat(g, F.when(j < F.size("others"), placeholder(j)).otherwise("")))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    rows = rows.withColumn("body", F.concat_ws("", shown)).withColumn("head", head)
    rows = rows.withColumn("start", before(F.length("head") + F.length("body") + len(END)) + F.length("head"))
    attachment = F.transform("others", lambda p, i: F.struct((F.col("first") + i).alias("number"), F.col("turn").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), _part_tokens(p).alias("tokens")))
    tokens = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + _part_tokens(p))
    span = F.when(F.col("role") == "assistant", F.struct("start", F.length("body").cast("long").alias("length")))
    one = F.struct("at", F.concat("head", "body", F.lit(END)).alias("segment"), span.alias("span"), attachment.alias("attachments"))
    turns = rows.select("conv_id", one.alias("t"), tokens.alias("k")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"), F.sum("k").alias("n_tokens"))
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.concat_ws("", F.col("turns.segment")).alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"), F.flatten("turns.attachments").alias("attachments"), "n_tokens",
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), placeholders left out."""
    turn = lambda s: F.struct(
        unescape(F.substring_index(s, BODY, 1)).alias("role"),
        unescape(F.regexp_replace(F.substring_index(F.substring_index(s, BODY, -1), END, 1), r"<\|[^|]*\|>", "")).alias("text"),
    )
    return F.transform(F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30), turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    cut_out = F.transform(spans, lambda s: unescape(F.regexp_replace(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")), r"<\|[^|]*\|>", "")))
    return F.concat_ws("", cut_out)


def digest(chats: DataFrame) -> DataFrame:
    """The digest columns, from the formatted text and its loss mask, with the attachments (JSON) and expanded tokens."""
    per_turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    rows = chats.select("conv_id", "formatted", "attachments", "n_tokens", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.concat_ws("", per_turn), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
        F.to_json("attachments").alias("attachments"), "n_tokens",
    )


def from_texts(conversations: DataFrame) -> DataFrame:
    """Rows with a text column as messages of one text part."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT CAST(-7 AS BIGINT) AS conv_id, turn, role, '{odd}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest(format_conversations(from_texts(rows)))


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '<', '<\'), '[', '[\') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(replace(replace(replace(role, '\', '\\'), '<', '<\'), '[', '[\')) + length(escaped) + 23)::BIGINT AS formatted_chars,
  '[]' AS attachments, sum(len(regexp_extract_all(text, '[\p{L}\p{N}]{1,4}|[^\p{L}\p{N} \t\n\x0B\f\r]')))::BIGINT AS n_tokens
FROM e GROUP BY conv_id
"""
