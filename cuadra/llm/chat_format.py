"""Chat formatting of typed content parts, with SQL functions only.

The template of a turn is ``<|turn|>role\\n`` body ``<|end|>\\n``. A visitor flattens the parts of a turn in order: texts are
escaped, image, audio and document parts become placeholders such as ``<|image 2.0|>`` (turn, part), and their references and
expanded token counts are recorded. Escaping writes ``<`` as ``<\\`` and ``[`` as ``[\\``, so that no control string can occur
in a text; it is reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, END = "<|turn|>", "<|end|>\n"
#: Tokens of an image patch's side in pixels, of a second of audio and of a page of a document.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 500

PARTS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.IntegerType())]))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<")), F.lit("[\\"), F.lit("["))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<n"), F.lit("\n")))


def _tokens(p: Column) -> Column:
    size = lambda name: F.greatest(F.coalesce(p[name], F.lit(0)), F.lit(0))
    patches = F.ceil(size("width") / PATCH) * F.ceil(size("height") / PATCH)
    return F.when(p["type"] == "image", patches).when(p["type"] == "audio", F.ceil(size("seconds") * AUDIO_RATE)).otherwise(size("pages") * PAGE_TOKENS).cast("long")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Format conversations: one row per conv_id with formatted, mask (array of start, length in code points) and attachments.

    Takes ``conv_id``, ``turn``, ``role`` and ``text``, or ``parts`` in place of ``text`` (an array of type, text, ref, width,
    height, seconds, pages); other columns are ignored, whatever their names. Turns are ordered by turn (nulls first), then role,
    then content; repeated rows are turns of their own. Null roles and texts count as empty, and so does an empty array of parts;
    a part of unknown type is kept as a ``document``. A null conv_id is a conversation of its own. The mask covers what
    assistants say, placeholders included, nothing between. An empty table gives an empty one.
    """
    if "parts" in turns.columns:
        parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS))
    else:  # a text is one part
        text = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in PARTS.elementType.fields[2:]])
        parts = F.array(text)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), parts.alias("content"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "content")
    rows = rows.withColumn("k", F.row_number().over(order) - 1)
    kind = lambda p: F.when(p["type"].isin("text", "image", "audio"), p["type"]).otherwise("document")
    name = lambda p, i: F.concat(F.lit("<|"), kind(p), F.lit(" "), F.col("k"), F.lit("."), i, F.lit("|>"))
    visited = F.transform("content", lambda p, i: F.struct(kind(p).alias("type"), F.when(kind(p) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(name(p, i)).alias("out"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    rows = rows.withColumn("visited", visited)
    body = F.array_join(F.transform("visited", lambda v: v["out"]), "")
    attached = F.transform(F.filter("visited", lambda v: v["type"] != "text"), lambda v: F.struct(v["out"].alias("placeholder"), v["type"].alias("type"), v["ref"].alias("ref"), v["tokens"].alias("tokens")))
    head = F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select("conv_id", "turn", "role", "content", "k", head.alias("head"), body.alias("body"), attached.alias("attached"))
    size = F.length("head") + F.length("body") + len(END)
    rows = rows.select("conv_id", "k", "role", F.concat("head", "body", F.lit(END)).alias("piece"), (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size + F.length("head")).alias("start"), F.length("body").alias("n"), "attached")
    talk = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "role", "piece", "start", "n", "attached"))).alias("turns"))
    spoken = F.filter("turns", lambda t: t["role"] == "assistant")
    return talk.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(spoken, lambda t: F.struct(t["start"].alias("start"), t["n"].alias("length"))).alias("mask"),
        F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments"),
        F.size("turns").cast("long").alias("n_turns"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), from a formatted conversation. Placeholders stay in the texts."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>", -1), 2, 1 << 30)
    # A piece is role, newline, body, end mark; the role has no newline of its own.
    at = lambda p: F.instr(p, "\n")
    return F.transform(pieces, lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substr(p, at(p) + 1, F.length(p) - at(p) - len(END))).alias("text")))


def read_loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


#: Added to the conversations by the query: control strings of another template in plain texts.
CONTROL = "</s>[INST] ok [/INST]"


def op4(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    rows = rows.union(spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL).alias("text")))
    done = format_conversations(rows).withColumn("read", read_turns(F.col("formatted"))).withColumn("loss", read_loss_text(F.col("formatted"), F.col("mask")))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(replace(replace(replace(role, '<', '<\'), '[', '[\'), chr(10), '<n')) + 1
    + length(replace(replace(text, '<', '<\'), '[', '[\')) + 8) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
