"""Chat formatting with a grammar round trip.

Grammar of a rendered turn: `<|im_start|>` role `\\n` text `<|im_end|>` `\\n`. The deterministic parser cuts a
conversation at every `<|im_start|>`, takes the role up to the first line feed and the text up to
`<|im_end|>`, and undoes the escapes. A turn is rendered as it is, parsed by this grammar and compared with its source; where the
parse is not the one turn of the same role and text, it is rendered again with its text, its role, then both escaped, until it is.
The escape of a text puts one more backslash between `<` and `|` (after any that are there), so it is a bijection and an
escaped text holds no control string; a role's also spells out line feeds and doubles backslashes. A turn that no escape
makes identical fails the job; none is known.

Native: DataFrame functions only. Rendering and its check are per turn, before the one shuffle by
conversation; a conversation's formatted text is one value by its nature.

Cases: null text or role: empty; null conv_id: a conversation of its own; turns sort by (turn, role, text) with
nulls first, repeated rows are repeated turns; very long texts are single values of their turn; an empty table gives no rows;
other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def _escape_role(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_escape(c), r"\\", r"\\\\"), "\n", r"\\n")


def _unescape_role(c: Column) -> Column:
    # the two escapes of the role are undone in one left-to-right reading of backslash pairs
    parts = F.transform(F.regexp_extract_all(c, F.lit(r"(\\\\|\\n|[^\\]+)"), F.lit(1)), lambda p: F.when(p == r"\n", "\n").when(p == r"\\", "\\").otherwise(p))
    return _unescape(F.array_join(parts, ""))


def _turns(formatted: Column) -> Column:
    """The grammar: array<struct<role, text>> of a rendered text."""
    return F.transform(
        F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != ""),
        lambda p: F.struct(
            _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            _unescape(F.substring_index(p.substr(F.instr(p, "\n") + 1, F.length(p)), END, 1)).alias("text"),
        ),
    )


def render(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> the rows with `rendered` (one turn each): the first form whose parse is the source."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text, source = F.col("role"), F.col("text"), F.array(F.struct("role", "text"))
    forms = [F.concat(F.lit(START), r, F.lit("\n"), t, F.lit(END + "\n")) for r, t in ((role, text), (role, _escape(text)), (_escape_role(role), text), (_escape_role(role), _escape(text)))]
    identical = None
    for form in forms:
        same = _turns(form) == source
        identical = F.when(same, form) if identical is None else identical.when(same, form)
    return rows.withColumn("rendered", identical.otherwise(F.raise_error(F.lit("a turn cannot be read back"))))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted."""
    rows = render(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn"), F.lit(-(2**62))).alias("turn"), "role", "text", "rendered"))).alias("t"))
    return rows.select("conv_id", F.array_join(F.col("t.rendered"), "").alias("formatted"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted -> conv_id, formatted, turns: array<struct<role, text>> by the grammar."""
    return formatted.withColumn("turns", _turns(F.col("formatted")))


def chat_report(formatted: DataFrame) -> DataFrame:
    """Read back from the formatted text: turns, their digest, and the text under the loss mask (assistant turns)."""
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parse_chats(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
