"""Chat formatting with typed content parts.

A turn is a role and an ordered list of parts: text, image, audio or document. Every part is visited once by its kind:
text is escaped, an attachment becomes a placeholder that stands for its expanded tokens, and its reference is recorded in
order. A conversation becomes a list of segments, each with its place in the loss mask; their concatenation is the training
string. Marks of turns cannot be forged: escaping puts one more backslash into every ``<|``, ``<\\|``, ``<\\\\|`` …, so an
escaped text never holds ``<|`` and taking one backslash out again restores it.

Nulls: a null text is empty, a null role is the empty role, null parts are none, an unknown kind is kept as escaped text of
its reference. Turns are ordered by turn (null first), then role, then text; repeated rows are repeated turns. Rows with a
null conversation id form one conversation. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"
#: kind of attachment -> its placeholder in the string
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role ends at the line's end: % and newlines in it are written as %25 and %0A."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_parts(text: Column) -> Column:
    """The parts of a plain text turn: one text part."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens"),
    ).cast(PART))


def visit(part: Column) -> Column:
    """What a part adds to the string, by its kind."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    out = F.when(kind == "text", escape(F.coalesce(part["text"], F.lit(""))))
    for name, mark in PLACEHOLDERS.items():
        out = out.when(kind == name, F.lit(mark))
    return out.otherwise(escape(F.coalesce(part["ref"], part["text"], F.lit(""))))


def attachments(parts: Column) -> Column:
    """References of the parts that became placeholders, in order, with the tokens each expands to (0 if unknown)."""
    held = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p["kind"].isin(*PLACEHOLDERS))
    return F.transform(held, lambda p: F.struct(
        p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0).cast("bigint")).alias("tokens")))


def format_turns(turns: DataFrame, trained: tuple[str, ...] = ("assistant",), conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: conv, ``segments`` (text, loss), ``formatted`` and ``attachments``.

    A conversation is one training example and one output value, so its turns meet in one group; turns are flattened to
    strings before they are shuffled.
    """
    body = F.array_join(F.transform(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), visit), "")
    role_text = F.coalesce(F.col(role), F.lit(""))
    flat = turns.select(conv, F.struct(
        F.col(turn).alias("turn"), role_text.alias("role"), body.alias("body"), attachments(F.col(parts)).alias("held"),
    ).alias("t"))
    gathered = flat.groupBy(conv).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
        F.struct(t["body"].alias("text"), t["role"].isin(*trained).alias("loss")),
        F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")),
    )))
    return gathered.select(
        conv, segments.alias("segments"), F.flatten(F.transform("turns", lambda t: t["held"])).alias("attachments")
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def expanded_tokens(attached: str = "attachments") -> Column:
    return F.aggregate(attached, F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"])


def read_turns(formatted: str = "formatted") -> Column:
    """Turns (role, text) read back from the string. An attachment's placeholder stays as it is."""
    found = F.filter(F.split(F.col(formatted), r"<\|im_end\|>\n"), lambda x: x != "")
    return F.transform(found, lambda x: F.struct(
        unescape_role(F.substring_index(F.substr(x, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(x, F.instr(x, "\n") + 1)).alias("text"),
    ))


def loss_text(segments: str = "segments") -> Column:
    """All text under the loss mask, in order, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
