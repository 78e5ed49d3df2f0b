"""Chat formatting with a grammar round trip, in Spark's own functions only.

    conversation := turn*
    turn         := "<s>" mark role "[INST]" text "[/INST]" "</s>"
    mark         := loss level
    loss         := "+" (trained on) | "-"
    level        := "0" (role and text as they are) | "1" (escaped)

A turn is rendered as it is and parsed again. Where the parse differs from the source, the turn
is rendered escaped: & becomes &amp; < becomes &lt; and [ becomes &#91; so no control string of
this template, or of any that begins with those signs, is left inside; undoing the three is exact.
Then the turns of a conversation are joined and the whole is parsed again; should that differ (it
can't for this grammar: no control string overlaps itself), all its turns are escaped, which leaves
no reading but one.

The parser is a pair of splits and fixed places; it takes the loss mask and levels from the
rendered text and nothing else.

Defined results: a null role or text is the empty string; rows of a conversation are ordered by
turn, then role, then text, so ties and repeated rows have one order and all are kept; null turns
come first; rows with a null conversation form one conversation; an empty table gives an empty
result; other columns are never read. A formatted conversation is one string, so one task holds
the turns of the longest conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.quality_rules import bound

OPEN, TEXT, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
#: Roles under the loss mask.
TRAINED = ("assistant",)


def quoted(s: str) -> str:
    return r"\Q" + s + r"\E"


def escape(c: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for plain, safe in (("[", "&#91;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def render(role: Column, text: Column, level: int) -> Column:
    put = escape if level else lambda c: c
    loss = F.when(role.isin(*TRAINED), F.lit("+")).otherwise(F.lit("-"))
    return F.concat(
        F.lit(OPEN), loss, F.lit(str(level)), put(role), F.lit(TEXT), put(text), F.lit(CLOSE), F.lit(END)
    )


def parse(rendered: Column) -> Column:
    """Array of (loss, role, text), or null where the text isn't of the grammar."""

    def turn(piece: Column) -> Column:
        escaped = F.substring(piece, len(OPEN) + 2, 1) == "1"
        rest = F.substring(piece, len(OPEN) + 3, 2**31 - 1)
        read = lambda c: F.when(escaped, unescape(c)).otherwise(c)

        def halves(two: Column) -> Column:
            body = F.get(two, F.lit(1))
            whole = (
                (F.size(two) == 2)
                & F.startswith(piece, F.lit(OPEN))
                & F.endswith(body, F.lit(CLOSE))
                & F.substring(piece, len(OPEN) + 1, 1).isin("+", "-")
                & F.substring(piece, len(OPEN) + 2, 1).isin("0", "1")
            )
            inner = F.left(body, F.length(body) - len(CLOSE))
            whole = whole & (F.locate(CLOSE, inner) == 0) & (F.locate(OPEN, rest) == 0)
            return F.when(
                whole,
                F.struct(
                    (F.substring(piece, len(OPEN) + 1, 1) == "+").alias("loss"),
                    read(F.get(two, F.lit(0))).alias("role"),
                    read(inner).alias("text"),
                ),
            )

        return bound(F.split(rest, quoted(TEXT), -1), halves)

    def all_turns(pieces: Column) -> Column:
        # The last piece is what follows the last end mark, and has to be nothing.
        ended = F.element_at(pieces, -1) == ""
        return F.when(ended, F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn))

    return bound(F.split(rendered, quoted(END), -1), all_turns)


def same(parsed: Column, turns: Column) -> Column:
    """Is the parse the source, turn for turn; a null parse isn't."""
    seen = F.transform(parsed, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return F.coalesce(seen == turns, F.lit(False))


def format_chats(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, formatted, and n_escaped, the number of turns that had to be escaped."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), blank(role).alias("role"), blank(text).alias("text")
    )
    plain = rows.withColumn("r0", render(F.col("role"), F.col("text"), 0))
    tried = plain.withColumn("ok", same(parse(F.col("r0")), F.array(F.struct("role", "text"))))
    turns = tried.select(
        "conv_id",
        F.struct(
            "turn", "role", "text", (~F.col("ok")).alias("escaped"), F.when(F.col("ok"), F.col("r0")).otherwise(render(F.col("role"), F.col("text"), 1)).alias("r")
        ).alias("t"),
    )
    joined = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    first = joined.withColumn("formatted", F.array_join(F.transform("t", lambda x: x["r"]), ""))
    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    checked = first.withColumn("ok", same(parse(F.col("formatted")), source))
    return checked.select(
        "conv_id",
        F.when(F.col("ok"), F.col("formatted"))
        .otherwise(F.array_join(F.transform("t", lambda x: render(x["role"], x["text"], 1)), ""))
        .alias("formatted"),
        F.when(F.col("ok"), F.size(F.filter("t", lambda x: x["escaped"]))).otherwise(F.size("t")).cast("bigint").alias("n_escaped"),
    )
