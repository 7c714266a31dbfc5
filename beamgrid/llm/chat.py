"""Chat formatting by prefix-target expansion: one example for each assistant turn. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Every escape begins with this control character, so unescaping is unambiguous.
ESC = "\x10"
#: What is escaped in texts, and in roles besides (a role ends at its line's end).
_IN_TEXT = ((ESC, ESC + "0"), ("<|", ESC + "1"))
_IN_ROLE = (*_IN_TEXT, ("\n", ESC + "2"))


def _replaced(x: Column, pairs) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escaped(x: Column, role: bool = False) -> Column:
    return _replaced(x, _IN_ROLE if role else _IN_TEXT)


def unescaped(x: Column, role: bool = False) -> Column:
    return _replaced(x, [(b, a) for a, b in reversed(_IN_ROLE if role else _IN_TEXT)])


def examples(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example, formatted, loss_start, loss_chars: a row for each assistant turn, in order from 0.

    formatted is the conversation up to and with that turn; its loss mask is the code points [loss_start, loss_start + loss_chars),
    which hold that reply alone, escaped, without the end mark. Turns after the last reply, or a conversation without one, give one
    more row with an empty mask, so that nothing is lost. Turns go by number, nulls first; equal numbers by role and text. Null
    roles and texts are empty. Rows with a null conv_id are one conversation. Extra columns are not read.

    A conversation is assembled in one task, and its examples hold it about half as many times as it has replies: that is
    what the method makes. Examples are cut from the conversation as they are read, and aren't shuffled.
    """
    c = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("x"))
    whole = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("t", "r", "x"))).alias("turns"))
    head = lambda p: F.concat(F.lit(START), escaped(p["r"], True), F.lit("\n"))
    piece = lambda p: F.struct((p["r"] == "assistant").alias("reply"), F.length(head(p)).alias("head"), F.length(escaped(p["x"])).alias("n"), F.concat(head(p), escaped(p["x"]), F.lit(END + "\n")).alias("s"))
    whole = whole.withColumn("pieces", F.transform("turns", piece)).drop("turns")
    whole = whole.withColumn("formatted", F.array_join("pieces.s", ""))
    # Where each piece ends, by running sums over (position, length) rows of the exploded pieces.
    tail = len(END) + 1
    size = lambda p: p["head"] + p["n"] + tail
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<length:int,loss_start:int,loss_chars:int>>").alias("cuts"))
    step = lambda acc, p: F.struct(
        (acc["at"] + size(p)).alias("at"),
        F.when(p["reply"], F.array_append(acc["cuts"], F.struct((acc["at"] + size(p)).alias("length"), (acc["at"] + p["head"]).alias("loss_start"), p["n"].alias("loss_chars")))).otherwise(acc["cuts"]).alias("cuts"),
    )
    whole = whole.withColumn("run", F.aggregate("pieces", zero, step)).withColumn("open", ~F.element_at("pieces", -1)["reply"])
    rest = F.array(F.struct(F.col("run.at").alias("length"), F.col("run.at").alias("loss_start"), F.lit(0).alias("loss_chars")))
    cuts = F.when(F.col("open"), F.concat("run.cuts", rest)).otherwise(F.col("run.cuts"))
    rows = whole.select("conv_id", "formatted", F.posexplode(cuts).alias("example", "cut"))
    return rows.select("conv_id", "example", F.left("formatted", F.col("cut.length")).alias("formatted"), F.col("cut.loss_start").alias("loss_start"), F.col("cut.loss_chars").alias("loss_chars"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from examples(): n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    reply = unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars")))
    own = formatted.select("conv_id", "example", "formatted", reply.alias("reply"), F.length("formatted").alias("n"))
    whole = own.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "reply"))), lambda r: r["reply"]), "").alias("loss"),
        F.sum("n").cast("long").alias("formatted_chars"),
    )
    pieces = F.split("last", r"<\|im_end\|>\n", -1)
    body = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substring(p, len(START) + 1, 1 << 30))
    at = lambda p: F.instr(p, F.lit("\n"))
    turn = lambda p: F.concat(unescaped(F.left(p, at(p) - 1), True), F.lit("\n"), unescaped(F.substring(p, at(p) + 1, F.lit(1 << 30))), F.lit("\n"))
    whole = whole.withColumn("turns", F.transform(body, turn))
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
