"""Chat formatting by prefix-target expansion, in SQL functions only.

A turn is written as `<|role|>`, a line feed, the text, `<|end|>`, a line feed. Control strings inside texts
are escaped reversibly, so none can be forged: backslashes are doubled and `<|` becomes `<\\|`. In
roles %, <, | and line feeds are percent-encoded.

Every assistant turn gives an example: all turns up to it, of which only that reply is under the loss
mask (its end mark is not). A conversation that does not end with an assistant turn gives one more
example, all of its turns with nothing under the mask, so that no turn is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Fixed values of the template.
OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"
_ROLE = [("%", "%25"), ("<", "%3C"), ("|", "%7C"), ("\n", "%0A")]


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    for plain, code in _ROLE:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _unescape_role(role: Column) -> Column:
    for plain, code in reversed(_ROLE):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """turns -> (conv_id, alone, example, last, text, loss_start, loss_end), a row an example.

    loss_start and loss_end: code points of text under the loss mask, end exclusive; null where
    nothing is. example counts from 1 in each conversation; last marks its last one.
    Turns go by number (null first), equal numbers by role and text; null roles and texts are empty
    and all rows are kept, repeated ones too. A row without a conv_id is a conversation of its own, numbered
    by `alone` (null elsewhere), so such rows are never gathered; other rows are gathered by conversation, as each
    example holds all turns before its own: a very long text stands whole in each later example. Other columns are not read. An empty table gives no example.
    """
    alone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    own = turns.select(F.col(conv_col).alias("conv_id"), alone.alias("alone"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = own.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    written = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), _escape_role(t["role"]), F.lit(SHUT)).alias("mark"), escape(t["text"]).alias("body"), (t["role"] == TRAINED).alias("trained")))
    whole = whole.select("conv_id", "alone", written.alias("turns"), F.size("turns").alias("n"))
    whole = whole.withColumn("at", F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("turns", i)["trained"] | (i == F.col("n"))))
    each = whole.select("conv_id", "alone", "turns", F.size("at").alias("of"), F.posexplode("at").alias("nth", "i"))
    line = lambda t: F.concat(t["mark"], t["body"], F.lit(END))
    each = each.withColumn("before", F.array_join(F.transform(F.slice("turns", 1, F.col("i") - 1), line), "")).withColumn("t", F.element_at("turns", F.col("i")))
    start = F.when(F.col("t.trained"), F.char_length("before") + F.char_length("t.mark")).cast("long")
    return each.select(
        "conv_id",
        "alone",
        (F.col("nth") + 1).alias("example"),
        (F.col("nth") + 1 == F.col("of")).alias("last"),
        F.concat(F.col("before"), line(F.col("t"))).alias("text"),
        start.alias("loss_start"),
        (start + F.char_length("t.body")).alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """A formatted text's turns: array<struct<role, text>>."""
    pieces = F.split(text, r"<\|end\|>\n")

    def turn(piece: Column) -> Column:
        at = F.instr(piece, SHUT)
        role = F.substring(piece, F.lit(len(OPEN) + 1), at - F.lit(len(OPEN) + 1))
        body = F.substring(piece, at + F.lit(len(SHUT)), F.char_length(piece))
        return F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(F.filter(pieces, lambda p: p != ""), turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """Examples -> (conv_id, turns, loss_text, formatted_chars), a row a conversation."""
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.substring("text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))))
    slim = formatted.select("conv_id", "alone", "example", loss.alias("loss"), F.when(F.col("last"), F.col("text")).alias("text"), F.char_length("text").cast("long").alias("chars"))
    got = slim.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.max("text").alias("text"), F.sum("chars").alias("formatted_chars"))
    return got.select("conv_id", read_turns(F.col("text")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss_text"), "formatted_chars")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"), F.lit(said).alias("text"))
    back = read_back(materialize(examples(own.unionByName(more)), "chat-examples"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


SQL = r"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY conv_id, alone) AS n,
         2 + length(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '|', '%7C'), chr(10), '%0A')) + 3
           + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 8 AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id, alone ORDER BY nth) AS upto FROM n
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(sum(upto) FILTER (WHERE role = 'assistant' OR nth = n), 0) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id, alone
"""
