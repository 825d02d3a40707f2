"""Chat formatting with typed content parts.

A turn holds parts of the kinds text, image, audio and document. A visitor walks the parts in order and
flattens each: text is escaped, any other part becomes a placeholder string, an attachment record
(turn, part, kind, reference, offset of the placeholder) and the number of tokens that the placeholder
expands to. A turn is ``<|role|>``, the role, a line feed, the parts, ``<|end|>`` and a line feed.

Strings that a chat template could take for control marks are escaped in texts and roles by a backslash
behind their first character; if backslashes stand there already, one more is added. So the escape can
be undone, and an escaped text holds no control string. The loss mask covers the escaped parts of the
assistant's turns, as (start, end) in code points.

Everything is built-in functions: turns are rendered row by row, then joined per conversation. One
conversation is one training sample and one row, so its turns meet in one row by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.llm.shared import table

#: What follows the first character of a control string of common chat templates. Fixed values.
TAILS = (r"\|", r"/?s>", r"/?INST\]", r"/?SYS>>", r"start_of_turn>", r"end_of_turn>")
TAIL = "|".join(TAILS)
ESCAPE, UNESCAPE = rf"([<\[])(\\*)(?={TAIL})", rf"([<\[])\\(\\*)(?={TAIL})"
OPEN, CLOSE = "<|role|>", "<|end|>\n"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 600


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2")


def expanded_tokens(part: Column) -> Column:
    """Tokens a placeholder stands for: image patches, audio frames, document pages; at least one."""
    count = (F.when(part["kind"] == "image", F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH))
             .when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE))
             .when(part["kind"] == "document", part["pages"] * PAGE_TOKENS))
    return F.greatest(F.coalesce(count, F.lit(1)).cast("long"), F.lit(1).cast("long"))


def _role(role: Column) -> Column:
    """A role as it stands in a head, which a line feed ends."""
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _visited(part: Column, before: Column) -> Column:
    """What the visitor makes of one part: its string and, unless it is text, an attachment's fields.
    Between two texts stands ``<|text|>``, so that no control string can arise where they meet."""
    is_text = lambda x: F.coalesce(x["kind"], F.lit("text")) == "text"
    join = F.when(before.isNotNull() & is_text(before), F.lit("<|text|>")).otherwise(F.lit(""))
    mark = F.concat(F.lit("<|"), escaped(part["kind"]), F.lit("|>"))
    other = ~is_text(part)
    return F.struct(F.when(other, mark).otherwise(F.concat(join, escaped(F.coalesce(part["text"], F.lit(""))))).alias("out"),
                    F.when(other, part["kind"]).alias("kind"), F.when(other, part["ref"]).alias("ref"),
                    F.when(other, expanded_tokens(part)).alias("tokens"))


def formatted(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (array of start, end), attachments (array of
    turn, part, kind, ref, at, tokens), expanded_tokens (sum over attachments).

    ``turns`` has conv_id, turn, role and text or parts (array of ``PART``; where both are there, the
    text is a first part unless null and parts are given). Turns follow ``turn``, ties the role and the
    rendered text; null turns come first. Null roles and texts are empty, null part kinds are text, null
    conv_ids are one conversation; repeated rows are turns like any other. A missing size counts as one
    token. An empty table gives no rows; other columns are not read.
    """
    plain = F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"), *[
        F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    ) if "text" in turns.columns else None
    typed = F.col("parts").cast(f"array<{PART}>") if "parts" in turns.columns else None
    if typed is None:
        parts = F.array(plain)
    elif plain is None:
        parts = F.coalesce(typed, F.array().cast(f"array<{PART}>"))
    else:
        parts = F.when(typed.isNull(), F.array(plain)).when(F.col("text").isNull(), typed).otherwise(F.concat(F.array(plain), typed))
    d = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), parts.alias("parts"))
    d = d.select("conv_id", "turn", "role", F.transform("parts", lambda p, i: _visited(p, F.get("parts", i - 1))).alias("seen"),
                 F.concat(F.lit(OPEN), _role(F.col("role")), F.lit("\n")).alias("head"))
    d = d.withColumn("body", F.array_join(F.col("seen.out"), ""))
    size = F.length("head") + F.length("body") + len(CLOSE)
    earlier = Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("at", F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    start = F.col("at") + F.length("head")
    placed = F.transform("seen", lambda p, i: F.struct(
        F.col("turn").alias("turn"), i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"),
        (start + F.length(F.array_join(F.slice(F.col("seen.out"), 1, i), ""))).alias("at"), p["tokens"].alias("tokens")))
    d = d.select("conv_id", F.struct(
        "at", F.concat("head", "body", F.lit(CLOSE)).alias("out"),
        F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.length("body")).alias("end"))).alias("loss"),
        F.filter(placed, lambda a: a["kind"].isNotNull()).alias("attachments")).alias("t"))
    d = d.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), lambda x, y: F.signum(x["at"] - y["at"]).cast("int")).alias("ts"))
    return d.select(
        "conv_id", F.array_join(F.col("ts.out"), "").alias("formatted"), F.array_compact(F.col("ts.loss")).alias("loss"),
        F.flatten(F.col("ts.attachments")).alias("attachments")).withColumn(
        "expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(samples: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss_text (the unescaped texts under the mask, in order)
    and formatted_chars from formatted conversations alone. Placeholders and the marks between texts
    stay as they are, so turns of one text part come back exactly."""
    pieces = F.split("formatted", "<\\|role\\|>")
    d = samples.select("conv_id", "formatted", "loss", F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("pieces"))
    turn = lambda p: F.struct(_unrole(F.substring_index(p, "\n", 1)).alias("role"), unescaped(_between(p)).alias("text"))
    masked = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    return d.select("conv_id", F.transform("pieces", turn).alias("turns"), F.array_join(masked, "").alias("loss_text"),
                    F.length("formatted").cast("long").alias("formatted_chars"))


def _between(piece: Column) -> Column:
    """What stands behind the first line feed and before the end mark."""
    at = F.instr(piece, "\n")
    return F.substring(piece, at + 1, F.length(piece) - at - len(CLOSE))


def op1_chat_format(spark, folder: str) -> DataFrame:
    sample = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(sample)
    d = read_back(formatted(turns))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


_RE2 = rf"([<\[])(\\*)({TAIL})"
SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(role, '{_RE2}', '\1\\\2\3', 'g')) + length(regexp_replace(text, '{_RE2}', '\1\\\2\3', 'g')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(n) + count(*) * {len(OPEN) + 1 + len(CLOSE)})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
