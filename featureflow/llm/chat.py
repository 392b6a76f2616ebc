"""Chat formatting with prefix-target expansion, in DataFrame functions only.

A conversation is rendered once: `<s>` then, for each turn, `[` role `]` text `</s>`. Roles and
texts have the signs of control strings replaced, so that a sign of the template is never part of
them: \\ becomes \\0, < \\1, > \\2, [ \\3 and ] \\4; replacing back in the order 4 to 0 restores them.

Every assistant turn becomes an example of its own: all turns before it are its context and only
its reply is trainable. Since all examples of a conversation are prefixes of one rendering, an
example row holds the length of its prefix, the place of its reply and the reply; its full text is
the prefix of the rendering, which `texts` cuts out. So what is written grows with the turns, not
with their square.

Cases: null text is an empty text, null role an empty role. Turns are ordered by turn (null first),
then role, then text; repeated rows are turns each. Rows with null conv_id are one conversation.
A conversation without assistant turns has no example, but is rendered. Other columns are ignored.
A conversation's rendering is one value, as its digest needs all of it: its memory is its length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featureflow.llm.common import part, text_blocks

#: Signs of the template and what stands for them inside texts; the escape sign first.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), (">", "\\2"), ("[", "\\3"), ("]", "\\4"))
OPEN, CLOSE = "<s>", "</s>"


def escape(text: Column) -> Column:
    for sign, code in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for sign, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def with_control_case(conversations: DataFrame, conv_id: int = -7) -> DataFrame:
    """conversations with one more: a user and an assistant turn whose texts are control strings of a template."""
    case = "</s>[INST] ok [/INST]"
    turns = conversations.select("conv_id", "turn", "role", "text")
    more = conversations.sparkSession.range(2).select(F.lit(conv_id).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(case).alias("text"))
    return turns.unionByName(more)


def _blocks(conversations: DataFrame) -> DataFrame:
    """One row a turn: conv_id, n (place from 1), reply (whether it is trainable), head, body (rendered) and where its block ends."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    made = rows.withColumn("head", F.concat(F.lit("["), escape(F.col("role")), F.lit("]"))).withColumn("body", escape(F.col("text")))
    size = (F.length("head") + F.length("body") + len(CLOSE)).cast("long")
    end = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + len(OPEN)
    return made.select("conv_id", F.row_number().over(order).alias("n"), (F.col("role") == "assistant").alias("reply"), "head", "body", end.alias("end"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, formatted: each conversation's rendering."""
    part = F.struct("n", F.concat("head", "body", F.lit(CLOSE)).alias("b"))
    whole = _blocks(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return whole.select("conv_id", F.concat(F.lit(OPEN), F.array_join(F.transform("parts", lambda p: p["b"]), "")).alias("formatted"))


def expand(conversations: DataFrame) -> DataFrame:
    """conversations -> one row an assistant turn: conv_id, n, prefix_chars, loss_start, loss_chars (places in the rendering, from 0), reply (as rendered)."""
    chars = F.length("body").cast("long")
    return _blocks(conversations).filter("reply").select("conv_id", "n", F.col("end").alias("prefix_chars"), (F.col("end") - len(CLOSE) - chars).alias("loss_start"), chars.alias("loss_chars"), F.col("body").alias("reply"))


def texts(formatted: DataFrame, examples: DataFrame) -> DataFrame:
    """The examples with the whole text of each, context and reply: as many characters as all prefixes together."""
    joined = examples.join(formatted.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    return joined.withColumn("text", F.expr("substring(formatted, 1, cast(prefix_chars AS int))")).drop("formatted")


def parse(formatted: DataFrame) -> DataFrame:
    """Renderings -> conv_id, turns array<struct<role, text>>: the turns that were formatted."""
    blocks = F.split(F.expr(f"substring(formatted, {len(OPEN) + 1})"), re.escape(CLOSE))
    turn = F.transform(F.slice("b", 1, F.size("b") - 1), lambda b: F.struct(unescape(F.substr(F.substring_index(b, "]", 1), F.lit(2))).alias("role"), unescape(F.substr(b, F.instr(b, "]") + 1)).alias("text")))
    return formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), blocks.alias("b")).select("conv_id", "formatted_chars", turn.alias("turns"))


def digests(formatted: DataFrame, examples: DataFrame) -> DataFrame:
    """What a reader of the output gets back: per conversation its turns, and all text under the loss mask, cut out of the rendering, in order."""
    turns = parse(formatted)
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    turns = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"), "formatted_chars")
    masks = examples.groupBy(F.col("conv_id").alias("_conv")).agg(F.sort_array(F.collect_list(F.struct("loss_start", "loss_chars"))).alias("masks"))
    cut = formatted.join(masks, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("_conv", "masks", text_blocks(F.col("formatted")).alias("blocks"))
    loss = cut.select("_conv", F.array_join(F.transform("masks", lambda m: unescape(part(F.col("blocks"), m["loss_start"], m["loss_start"] + m["loss_chars"]))), "").alias("loss"))
    loss = loss.select("_conv", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"))
    both = turns.join(loss, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return both.select("conv_id", "n_turns", "turns_sha256", F.coalesce("loss_chars", F.lit(0)).alias("loss_chars"), F.coalesce("loss_sha256", F.sha2(F.lit(""), 256)).alias("loss_sha256"), "formatted_chars")
