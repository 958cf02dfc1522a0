r"""Chat formatting with Spark expressions only.

Template: each run of adjacent turns of one role is a block
``<|im_start|>role\n`` + its texts, joined by ``<|im_sep|>``, + ``<|im_end|>\n``.
Inside roles and texts a backslash becomes two and ``<|`` becomes ``<\|``, so a text can hold any
control string and is read back exactly. The loss mask is a list of (start, length) in code points
that covers each assistant text, and neither marks nor anything between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """One pass from the left: a backslash stands for the character behind it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text): conv_id, formatted, loss_spans.

    Turns are sorted by turn, then role and text, so ties have one order. A null text or role is
    empty; a null turn comes first; rows with a null conv_id are one conversation of that id.
    Repeated rows are turns of their own. Other columns are ignored. The work is linear in the turns;
    a conversation, being one row of the result, must fit in a task.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.select("conv_id", "role", escape(F.col("text")).alias("text"), F.row_number().over(order).alias("n"), F.lag("role").over(order).alias("before"))
    opening = F.concat(F.when(F.col("n") > 1, END).otherwise(""), F.lit(START), escape(F.col("role")), F.lit("\n"))
    marked = placed.withColumn("mark", F.when(F.col("before") == F.col("role"), SEP).otherwise(opening))
    through = F.sum(F.length("mark") + F.length("text")).over(Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    piece = F.struct("n", "role", F.concat("mark", "text").alias("piece"), (through - F.length("text")).cast("long").alias("start"), F.length("text").cast("long").alias("length"))
    chats = marked.select("conv_id", piece.alias("piece")).groupBy("conv_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    spans = F.transform(F.filter("pieces", lambda p: p["role"] == trained_role), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return chats.select("conv_id", F.concat(F.array_join(F.transform("pieces", lambda p: p["piece"]), ""), F.lit(END)).alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turns_of(b: Column) -> Column:
        inner = F.regexp_replace(b, r"(?s)<\|im_end\|>\n$", "")
        cut = F.instr(inner, "\n")
        role, rest = F.substring(inner, F.lit(1), cut - 1), F.substring(inner, cut + 1, F.length(inner))
        return F.transform(F.split(rest, r"<\|im_sep\|>", -1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def digest(chats: DataFrame) -> DataFrame:
    """What the query returns, read back from ``formatted`` and ``loss_spans`` alone."""
    turns = chats.select("conv_id", "formatted", "loss_spans", read_turns(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
