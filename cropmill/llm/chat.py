r"""Chat formatting with Spark expressions only.

Turn structs are collected and sorted by turn, adjacent turns of one role become one block (array aggregation), and blocks are
concatenated:

    <s>[SYS] text[/SYS][INST] text\+text[/INST][ASST] text</s>

Control strings inside texts are escaped reversibly: in a text every backslash becomes ``\b``, every ``<`` ``\l`` and every ``[``
``\k``, so no control string can be made of text. Turns of one block are divided by ``\+``. A role other than system, user and
assistant is written in its block's mark, escaped likewise.

``read_back`` recovers the turns from the formatted string alone. The loss mask is the list of character ranges of assistant texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropmill.llm.arrays import bound, running

OPEN, JOIN, CLOSE = "<s>", "\\+", "</s>"
#: Marks of the known roles.
MARKS = {"system": "SYS", "user": "INST", "assistant": "ASST"}


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\k"))


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\k"), F.lit("[")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def _mark(role: Column) -> Column:
    """A role's mark; ``:role`` for roles of other names, in which ``]`` is escaped too."""
    known = F.lit(None).cast("string")
    for name, mark in MARKS.items():
        known = F.coalesce(known, F.when(role == name, F.lit(mark)))
    return F.coalesce(known, F.concat(F.lit(":"), F.replace(escaped(role), F.lit("]"), F.lit("\\c"))))


def _role(mark: Column) -> Column:
    known = F.lit(None).cast("string")
    for name, m in MARKS.items():
        known = F.coalesce(known, F.when(mark == m, F.lit(name)))
    return F.coalesce(known, unescaped(F.replace(F.substring(mark, 2, 1 << 30), F.lit("\\c"), F.lit("]"))))


def merged(turns: str, starts: str) -> Column:
    """Adjacent turns of one role as one block: array of (role, texts). ``starts``: the column of the blocks' first turns."""
    last = F.size(turns) + 1
    return F.transform(starts, lambda s, i: F.struct(F.element_at(turns, s)["role"].alias("role"), F.transform(F.slice(turns, s, F.coalesce(F.get(F.col(starts), i + 1), last) - s), lambda t: t["text"]).alias("texts")))


def formatted(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_col``, ``formatted``, ``loss_mask`` (array of start, end; code points, end exclusive).

    Turns are sorted by turn, null turns first; ties and repeated rows are all kept, ordered by role and text. A null text or role
    is an empty string; rows of null conversation are one conversation. An empty table gives an empty table.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sorted_turns = conversations.groupBy(F.col(conv_col)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    first = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.get(F.col("turns"), i - 2)["role"]))
    blocks = sorted_turns.withColumn("starts", first).select(conv_col, merged("turns", "starts").alias("blocks"))

    def block(b: Column) -> Column:
        return F.concat(F.lit("["), _mark(b["role"]), F.lit("] "), F.array_join(F.transform(b["texts"], escaped), JOIN), F.when(b["role"] == "assistant", F.lit(CLOSE)).otherwise(F.concat(F.lit("[/"), _mark(b["role"]), F.lit("]"))))

    text = F.concat(F.lit(OPEN), F.array_join(F.transform("blocks", block), ""), F.lit("\n"))
    out = blocks.select(conv_col, text.alias("formatted"))
    return out.withColumn("loss_mask", mask_of(F.col("formatted")))


#: A block, its mark, and its body. Bodies hold no bracket and no ``<``.
BLOCK = r"\[([^\[\]/][^\[\]]*+)\] ([^\[<]*+)(?:</s>|\[/[^\[\]]*+\])"


def blocks_of(text: Column) -> Column:
    """Blocks read from a formatted string: array of (start of body, role, bodies)."""
    marks = F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1))
    bodies = F.regexp_extract_all(text, F.lit(BLOCK), F.lit(2))
    wholes = F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0))

    def read(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda x: F.length(x["whole"])), lambda a, b: a + b)

        def block(x: Column) -> Column:
            part = x["part"]
            start = F.lit(len(OPEN) + 3) + x["end"] - F.length(part["whole"]) + F.length(part["mark"])
            return F.struct(start.alias("start"), _role(part["mark"]).alias("role"), F.split(part["body"], r"\\\+", -1).alias("bodies"))

        return F.transform(F.arrays_zip(parts.alias("part"), ends.alias("end")), block)

    return bound(F.arrays_zip(marks.alias("mark"), bodies.alias("body"), wholes.alias("whole")), read)


def mask_of(text: Column) -> Column:
    """Ranges of the assistant texts within a formatted string."""
    own = F.filter(blocks_of(text), lambda b: b["role"] == "assistant")

    def spans(b: Column) -> Column:
        ends = running(F.transform(b["bodies"], lambda x: F.length(x) + len(JOIN)), lambda a, c: a + c)

        def span(x: Column) -> Column:
            end = b["start"] + x["end"] - len(JOIN)
            return F.struct((end - F.length(x["body"])).alias("start"), end.alias("end"))

        return F.transform(F.arrays_zip(b["bodies"].alias("body"), ends.alias("end")), span)

    return F.flatten(F.transform(own, spans))


def read_back(text: Column) -> Column:
    """The turns of a formatted string, one for each original row: array of (role, text)."""
    return F.flatten(F.transform(blocks_of(text), lambda b: F.transform(b["bodies"], lambda x: F.struct(b["role"].alias("role"), unescaped(x).alias("text")))))


def under_mask(text: Column, mask: Column) -> Column:
    """All text under a loss mask, unescaped and concatenated."""
    return F.array_join(F.transform(mask, lambda m: unescaped(text.substr(m["start"] + 1, m["end"] - m["start"]))), "")
