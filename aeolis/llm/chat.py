"""Chat formatting: fold event logs of conversations into messages, render them, read them back.

A rendered turn is <s>role[INST]text</s>; in a turn to learn from, [/INST] stands for [INST].
Inside roles and texts a backslash becomes \\e, < becomes \\l and [ becomes \\b, so that no
control string can occur there; taking that back gives the text.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, ASK, LEARN, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
#: Characters of a streamed delta.
PIECE = 64
#: Characters and what stands for them, the backslash first (fixed order).
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def escape(text: Column) -> Column:
    for raw, coded in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for raw, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages of a log (conv_id, seq, turn, kind, role, text).

    Events of a turn count in order of seq: `delta` appends its text, `edit` and `regenerate`
    drop what the turn had and start again with theirs. A null kind is a delta, a null text
    empty. The turn's role is that of its last start, or else of its first event. Events with
    equal seq count by kind, role and text. A turn without events doesn't exist; a conversation
    without any neither. A null conv_id or turn is a value of its own.
    """
    starts = F.col("kind").isin("edit", "regenerate").cast("int")
    so_far = Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumns({"kind": F.coalesce("kind", F.lit("delta")), "text": F.coalesce("text", F.lit("")), "role": F.coalesce("role", F.lit(""))})
    rows = rows.withColumn("_version", F.sum(starts).over(so_far)).withColumn("_n", F.row_number().over(so_far))
    versions = rows.groupBy("conv_id", "turn", "_version").agg(F.array_sort(F.collect_list(F.struct("_n", "role", "text"))).alias("_parts"))
    last = versions.groupBy("conv_id", "turn").agg(F.max_by("_parts", "_version").alias("_parts"))
    return last.select("conv_id", "turn", F.col("_parts")[0]["role"].alias("role"), F.array_join(F.col("_parts.text"), "").alias("text"))


def as_events(turns: DataFrame) -> DataFrame:
    """The log of a table with one row a finished turn, as if it had been streamed.

    First each turn gets a draft; then all are written anew in order, an assistant's turn by
    `regenerate`, others by `edit`, and go on in deltas of PIECE characters. Rows of one turn are
    numbered as turns of their own, in order of role and text. Null and empty texts have one
    empty piece, long ones many; null conversations are one. Other columns don't matter.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    numbered = turns.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("long").alias("turn"))
    start = F.when(F.col("role") == "assistant", F.lit("regenerate")).otherwise(F.lit("edit"))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    pieces = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(pieces)

    def event(phase: int, n: Column, kind: Column, text: Column) -> Column:
        seq = F.lit(phase << 56).bitwiseOR(F.shiftleft("turn", 28)).bitwiseOR(n.cast("long"))
        return F.struct(seq.alias("seq"), kind.alias("kind"), text.alias("text"))

    draft = event(0, F.lit(0), F.lit("delta"), F.concat(F.substring("text", 1, PIECE), F.lit(" (draft)")))
    final = F.transform(pieces, lambda x, i: event(1, i, F.when(i == 0, start).otherwise(F.lit("delta")), x))
    events = numbered.select("conv_id", "turn", "role", F.explode(F.concat(F.array(draft), final)).alias("e"))
    return events.select("conv_id", "e.seq", "turn", "e.kind", "role", "e.text")


def render(messages: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): one row a conversation, its turns in order.

    loss lists the spans (start from 0, length, in characters) to learn from: the escaped
    texts of the role learn_from. Messages of one turn are ordered by role and text; repeated
    ones each count. Null roles and texts are empty, an empty text has an empty span; null
    conversations are one. No messages in, none out. Other columns don't matter. The output is
    one string a conversation, so a conversation, however long, must fit in a row.
    """
    mark = F.when(F.col("role") == learn_from, F.lit(LEARN)).otherwise(F.lit(ASK))
    rows = messages.withColumns({"_head": F.concat(F.lit(OPEN), escape(F.coalesce("role", F.lit(""))), mark), "_text": escape(F.coalesce("text", F.lit("")))})
    rows = rows.withColumn("_piece", F.concat("_head", "_text", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.length("_piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.when(F.col("role") == learn_from, F.struct((before + F.length("_head")).cast("int").alias("start"), F.length("_text").alias("length")))
    rows = rows.select("conv_id", F.row_number().over(order).alias("_n"), "_piece", span.alias("_span"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_n", "_piece", "_span"))).alias("_rows"))
    return whole.select("conv_id", F.array_join(F.col("_rows._piece"), "").alias("formatted"), F.filter(F.col("_rows._span"), lambda s: s.isNotNull()).alias("loss"))


def turns_of(formatted: Column) -> Column:
    """What was rendered: an array of (role, text); empty roles and texts come back empty, null gives null."""
    pieces = F.split(formatted, CLOSE)

    def turn(piece: Column) -> Column:
        halves = F.split(F.replace(piece, F.lit(LEARN), F.lit(ASK)), r"\[INST\]")
        role = F.substring(halves[0], len(OPEN) + 1, 1 << 30)
        return F.struct(unescape(role).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
