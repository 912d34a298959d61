"""Operator 9: chat formatting with a grammar round trip, in DataFrame functions only.

A turn is ``### role: text</turn>`` and a line feed.  Inside roles and texts every backslash is
doubled and a backslash is put into each control string, which no doubled text can contain, so
parsing undoes it exactly.  A turn is first rendered as it is; only if parsing doesn't give it back
is its content escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HEAD, SEP, END = "### ", ": ", "</turn>\n"
# Control strings inside content and their escaped forms.
MARKS = (("</turn>", "<\\/turn>"), ("### ", "#\\## "))
ROLE_MARKS = (*MARKS, (": ", ":\\ "))


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column, marks: tuple = MARKS) -> Column:
    c = _swap(c, "\\", "\\\\")
    for plain, safe in marks:
        c = _swap(c, plain, safe)
    return c


def unescape(c: Column, marks: tuple = MARKS) -> Column:
    for plain, safe in reversed(marks):
        c = _swap(c, safe, plain)
    return _swap(c, "\\\\", "\\")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(SEP), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; unmarked or bare marks give nulls."""
    def turn(segment: Column) -> Column:
        at = F.locate(SEP, segment)
        role = F.substr(segment, F.lit(len(HEAD) + 1), at - F.lit(len(HEAD) + 1))
        text = F.substr(segment, at + F.lit(len(SEP)))
        good = segment.startswith(HEAD) & (at > 0)
        for mark, _ in MARKS:
            good = good & ~F.contains(text, F.lit(mark)) & ~F.contains(role, F.lit(mark))
        return F.struct(
            F.when(good, unescape(role, ROLE_MARKS)).alias("role"), F.when(good, unescape(text)).alias("text"))

    parts = F.split(formatted, END)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted) of ``rows`` (conv_id, turn, role, text, ...).

    Turns are ordered by turn (null first); rows with the same turn by role, then text, and repeated
    rows stay.  A null role or text is empty; rows with a null conv_id are one conversation.  The
    reparsed turns equal the source turns, whatever the texts hold.  A conversation becomes one
    string, so the longest conversation bounds the memory of a task.  Other columns aren't read.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        text("role").alias("role"), text("text").alias("text"),
    ).withColumn("plain", render(F.col("role"), F.col("text")))
    back = parse(F.col("plain"))
    same = (F.size(back) == 1) & F.coalesce(
        (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text")), F.lit(False))
    safe = render(escape(F.col("role"), ROLE_MARKS), escape(F.col("text")))
    turns = turns.select("conv_id", "turn", "role", "text", F.when(same, F.col("plain")).otherwise(safe).alias("out"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "out")))
    return turns.groupBy("conv_id").agg(ordered.alias("turns")).select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["out"]), "").alias("formatted"))


def chat_report(rows: DataFrame) -> DataFrame:
    """Digests of every conversation, read back from its formatted string."""
    back = format_chats(rows).withColumn("back", parse(F.col("formatted")))
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    said = F.array_join(F.transform(F.filter("back", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return back.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"), F.sha2(said.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7: both turns quote the control strings of a template, already escaped once."""
    said = F.lit("\\### Assistant: </turn> ok")
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
