"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"
#: Strings that could pass for markup inside a text. "<|" opens every marker of this template; the rest are control
#: strings of other public templates. Fixed values.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def escape(text: Column) -> Column:
    """Doubles backslashes, then puts one after the first character of every control string. The escaped text holds no control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    """Undoes escape: a control string is split by exactly one backslash, while a text's own come in pairs."""
    for c in CONTROLS:
        text = F.replace(text, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _split(text: Column, marker: str) -> Column:
    return F.split(text, marker.replace("|", "\\|"), -1)


def format_conversations(turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_mask of every conversation of turns (conv_id, turn, role, text).

    Turns are collected as structs and sorted; neighbours of one role share a block,
    ``<|start|>role<|text|>text<|next|>text<|end|>``, with texts and roles escaped. loss_mask has a span (start from 0,
    length, in code points of formatted) for each text of a trained role. One conversation is one value; its turns
    meet in one task, as they must for their formatted text.
    Nulls: a null role or text is the empty string, a null turn sorts first, rows of null conv_id form one
    conversation. Rows with the same turn are ordered by role, then text; repeated rows stay.
    A conversation of any length is one value. An empty table gives no rows. Other columns are not read.
    """
    read = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    held = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def blocks(all_turns: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(all_turns) - 1), lambda i: (i == 0) | (all_turns[i]["role"] != F.get(all_turns, i - 1)["role"]))
        until = lambda s, k: F.coalesce(F.get(s, k + 1), F.size(all_turns))
        return _let(heads, lambda s: F.transform(s, lambda i, k: F.struct(all_turns[i]["role"].alias("role"), F.transform(F.slice(all_turns, i + 1, until(s, k) - i), lambda t: t["text"]).alias("texts"))))

    def parts(block: Column) -> Column:
        """Strings of a block, each with whether it is under the mask."""
        part = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
        bare = F.lit(False)
        head = part(F.concat(F.lit(START), escape(block["role"]), F.lit(TEXT)), bare)
        loss = block["role"].isin(*trained_roles)
        texts = F.flatten(F.transform(block["texts"], lambda t, i: F.when(i == 0, F.array(part(escape(t), loss))).otherwise(F.array(part(F.lit(NEXT), bare), part(escape(t), loss)))))
        return F.concat(F.array(head), texts, F.array(part(F.lit(END), bare)))

    made = held.select("conv_id", F.flatten(F.transform(_let(F.col("turns"), blocks), parts)).alias("parts"))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))
    walk = lambda a, p: F.struct((a["at"] + F.length(p["s"])).alias("at"), F.when(p["loss"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), F.length(p["s"]).alias("length"))))).otherwise(a["spans"]).alias("spans"))
    return made.select("conv_id", F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("formatted"), F.aggregate("parts", empty, walk)["spans"].alias("loss_mask"))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation: what format_conversations was given, in its order."""

    def block(b: Column) -> Column:
        halves = _split(F.substring_index(b, END, 1), TEXT)
        return F.transform(_split(halves[1], NEXT), lambda t: F.struct(unescape(halves[0]).alias("role"), unescape(t).alias("text")))

    return _let(_split(formatted, START), lambda bs: F.flatten(F.transform(F.slice(bs, F.lit(2), F.size(bs) - 1), block)))


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """The text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss_mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from format_conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    back = formatted.select("conv_id", "formatted", parse_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
