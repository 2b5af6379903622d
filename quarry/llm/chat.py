"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; neighbours of one role share a header (array expressions), and
the whole is joined to one string. The template:

    <|start|>ROLE\\n TEXT [<|more|> TEXT]... <|end|>

Inside texts and roles `\\` is written `\\b` and `<|` is written `<\\p|` (in roles a line end `\\n`, a null role `\\0`), so no
text can hold a marker and unescape() gives it back exactly. `mask` lists the code-point spans of assistant texts.

Defined results: rows are ordered by turn, ties by role and text, nulls first; a null text is empty; repeated rows are turns of
their own; rows with a null conv_id form one conversation; an empty table gives no rows; extra columns are not read. A formatted
conversation is one value, so it must stay under Spark's limit of 2 GB a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MORE, END = "<|start|>", "<|more|>", "<|end|>"


def _put(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return _put(_put(text, "\\", "\\b"), "<|", "<\\p|")


def unescape(text: Column) -> Column:
    return _put(_put(text, "<\\p|", "<|"), "\\b", "\\")


def escape_role(role: Column) -> Column:
    return F.coalesce(_put(escape(role), "\n", "\\n"), F.lit("\\0"))


def unescape_role(role: Column) -> Column:
    return F.when(role != "\\0", unescape(_put(role, "\\n", "\n")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and mask (array of start, length in code points, from 0) of each conversation."""
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        joins = (i > 0) & F.get(F.col("turns"), i - 1)["role"].eqNullSafe(t["role"])
        head = F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
        before = F.when(joins, F.lit(MORE)).when(i > 0, F.concat(F.lit(END), head)).otherwise(head)
        return F.struct(before.alias("before"), escape(t["text"]).alias("body"), F.coalesce(t["role"] == "assistant", F.lit(False)).alias("loss"))

    rows = rows.select("conv_id", F.transform("turns", piece).alias("pieces"))
    rows = rows.select("conv_id", "pieces", F.transform("pieces", lambda p: F.length(p["before"]) + F.length(p["body"])).alias("sizes"))
    rows = rows.select("*", _starts_of_blocks(F.col("sizes")).alias("blocks"))

    def span(p: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        at = F.get(F.col("blocks"), block) + _total(F.slice("sizes", block * BLOCK + 1, i % BLOCK))
        return F.struct((at + F.length(p["before"])).alias("start"), F.length(p["body"]).alias("length"), p["loss"].alias("loss"))

    text = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["body"])), ""), F.lit(END))
    spans = F.filter(F.transform("pieces", span), lambda s: s["loss"])
    return rows.select("conv_id", text.alias("formatted"), F.transform(spans, lambda s: F.struct(s["start"], s["length"])).alias("mask"))


#: Positions are summed in blocks of so many turns: a turn adds up its own block, a block the blocks before it.
BLOCK = 256


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda x, y: x + y)


def _starts_of_blocks(sizes: Column) -> Column:
    """Where each block of BLOCK turns begins."""
    count = F.greatest(F.lit(1), F.ceil(F.size(sizes) / BLOCK).cast("int"))
    totals = F.transform(F.sequence(F.lit(0), count - 1), lambda k: _total(F.slice(sizes, k * BLOCK + 1, BLOCK)))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: _total(F.slice(totals, F.lit(1), k)))


def parse_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, in order."""
    runs = F.split(formatted, r"<\|start\|>|<\|end\|><\|start\|>|<\|end\|>$")
    runs = F.filter(runs, lambda r: F.instr(r, "\n") > 0)  # every run has a header line

    def turns(run: Column) -> Column:
        role = unescape_role(F.substring_index(run, "\n", 1))
        texts = F.split(F.substr(run, F.instr(run, "\n") + F.lit(1)), r"<\|more\|>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(runs, turns))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, m["start"] + 1, m["length"]))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all read from the formatted rows."""
    turns, loss = F.col("turns"), F.col("loss")
    rows = formatted.select("conv_id", "formatted", parse_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("mask")).alias("loss"))
    lines = F.array_join(F.transform(turns, lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
