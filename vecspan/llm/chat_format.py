r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation renders as turns "### Role: body</turn>" + newline. The parser cuts at every "</turn>", takes the
role up to the first ": " and undoes the escape "\x -> x". A turn is first rendered raw and reparsed; unless that
gives back exactly its role and text as one turn, its text is escaped (a backslash before backslashes and inside
"</turn>" and "### ") and reparsed again; a turn that still differs stops the job. The grammar is cut at turn ends,
so turn-wise round trips imply that of the whole conversation, and rows never meet before rendering.

Turns meet twice: first by (conversation, block of 64 turn numbers), then blocks by conversation, so that one
conversation with very many rows arrives as few, already joined strings. Spans under the loss mask (assistant bodies)
are kept as offsets into the formatted text.

Edge cases: null text is empty, null role is the empty role; roles outside user/assistant/system are written in hex;
a null turn sorts first; equal turn numbers sort by role, then text; repeated rows are turns of their own; a null
conv_id is a conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspan.llm.common import table

END, HEAD = "</turn>", "### "
ROLES = ("user", "assistant", "system")
BLOCK = 64


def _role_out(role: Column) -> Column:
    return F.when(role.isin(*ROLES), F.initcap(role)).otherwise(F.concat(F.lit("="), F.hex(F.encode(role, "UTF-8"))))


def _role_in(mark: Column) -> Column:
    return F.when(mark.startswith("="), F.decode(F.unhex(F.substring(mark, 2, 1 << 30)), "UTF-8")).otherwise(F.lower(mark))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(END), F.lit("<\\/turn>"))
    return F.replace(out, F.lit(HEAD), F.lit("#\\## "))


def unescape(body: Column) -> Column:
    return F.regexp_replace(body, r"(?s)\\(.)", "$1")


def _render(mark: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD), mark, F.lit(": "), body, F.lit(END + "\n"))


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text, ok) of a formatted text; ok is false where the grammar is broken."""
    pieces = F.split(formatted, END, -1)
    heads = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column, i: Column) -> Column:
        body = F.when(i > 0, F.substring(piece, 2, 1 << 30)).otherwise(piece)
        mark = F.regexp_extract(body, r"^### ([^:\n]*): ", 1)
        text = F.substring(body, F.length(mark) + len(HEAD) + 3, F.lit(1 << 30))
        ok = body.rlike(r"^### [^:\n]*: ") & ((i == 0) | piece.startswith("\n")) & ~F.contains(text, F.lit(HEAD)) & (F.element_at(pieces, -1) == "\n")
        return F.struct(_role_in(mark).alias("role"), unescape(text).alias("text"), ok.alias("ok"))

    return F.transform(heads, turn)


def _same(segment: Column, role: Column, text: Column) -> Column:
    turns = parse_turns(segment)
    first = F.try_element_at(turns, F.lit(1))
    return F.coalesce((F.size(turns) == 1) & first["ok"] & (first["role"] == role) & (first["text"] == text), F.lit(False))


def render_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, body, segment: every turn rendered and reparsed to itself."""
    t = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("mark", _role_out(F.col("role")))
    raw = _render(F.col("mark"), F.col("text"))
    body = F.when(_same(raw, F.col("role"), F.col("text")), F.col("text")).otherwise(escape(F.col("text")))
    t = t.withColumn("body", body).withColumn("segment", _render(F.col("mark"), F.col("body")))
    checked = F.when(_same(F.col("segment"), F.col("role"), F.col("text")), F.col("segment")).otherwise(F.raise_error(F.lit("a turn does not reparse to itself")))
    return t.withColumn("segment", checked)


def format_chat(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, formatted, n_turns, loss_spans array<struct<start, length>> (code points, from 0)."""
    t = render_turns(conversations).withColumn("blk", F.floor(F.col("turn") / block))
    order = ["turn", "role", "text"]
    before = W.partitionBy("conv_id", "blk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("at") + F.length("mark") + len(HEAD) + 2).alias("start"), F.length("body").cast("long").alias("length")))
    blocks = t.withColumn("span", span).groupBy("conv_id", "blk").agg(
        F.sort_array(F.collect_list(F.struct("at", "segment"))).alias("segments"), F.sort_array(F.collect_list("span")).alias("spans"), F.count("*").alias("n"), F.sum(F.length("segment")).alias("chars")
    )
    blocks = blocks.select("conv_id", "blk", F.array_join(F.transform("segments", lambda x: x["segment"]), "").alias("text"), "spans", "n", "chars")
    before = W.partitionBy("conv_id").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("at", F.coalesce(F.sum("chars").over(before), F.lit(0)))
    blocks = blocks.withColumn("spans", F.transform("spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), s["length"].alias("length"))))
    return blocks.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "").alias("formatted"),
        F.sum("n").alias("n_turns"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """format_chat()'s rows plus turns (reparsed) and loss_text (unescaped text under the loss mask)."""
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumn("turns", parse_turns(F.col("formatted"))).withColumn("loss_text", F.array_join(loss, ""))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    out = read_back(format_chat(rows.unionByName(extra)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, CASE WHEN role IN ('user', 'assistant', 'system') THEN length(role) ELSE 1 + 2 * strlen(role) END AS mark_chars,
    CASE WHEN regexp_matches(text, '\\[\s\S]') OR contains(text, '</turn>') OR contains(text, '### ')
         THEN replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ') ELSE text END AS body
  FROM rows)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + mark_chars + 2 + length(body) + 8)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
