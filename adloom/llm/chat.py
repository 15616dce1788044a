"""Chat formatting that is proved by reading the rendered text back.

Grammar. A rendered conversation is a sequence of turns; a turn is OPEN role NEWLINE text CLOSE. Every control string begins with
`<|`, so the parser is deterministic: it cuts at OPEN, takes the role up to the first line end and the text up to the first
end mark, which must be that of CLOSE with nothing behind it, and takes one backslash out of every `<\\|`, `<\\\\|` and so on.

Method. Each turn is rendered as it is and parsed; where what comes back is not the turn, its text (and role) conflict with the
grammar and are escaped: a backslash is put into every `<|`, `<\\|` and so on, which the parser takes out again. Escaped text has no
`<|`, and a turn is cut out by strings that have it, so one escape ends with an equal turn. The turns of a conversation are then
joined, the whole is parsed, and what comes back is compared with the source; a conversation that differs is an error, not a row.
Only DataFrame functions are used.

Null roles and texts are empty, and texts of any length are whole. Turns are ordered by turn (nulls first), then role, then text;
repeated rows stay. Each row without conv_id is a conversation by itself, so that such rows don't form one group of any size. Line ends in
a role are escaped too. Columns besides conv_id, turn, role and text are ignored; no rows give no conversations. A conversation is
one row of output, so its turns meet in one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, END = "<|im_start|>", "<|im_end|>"
CLOSE = END + "\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # Doubled backslashes are set aside first, so that an escaped backslash before an n is no line end.
    parts = F.transform(F.split(unescape(role), r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def parse(rendered: Column) -> Column:
    """array<struct<role, raw, text>> of a rendered string; raw is the text as it stands there. A piece without CLOSE, with an
    end mark before it or without a line end after the role is no turn and comes back with null text."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(role) + 2, F.length(piece))
        raw = F.when(body.endswith(CLOSE) & (F.locate(END, piece) == F.length(piece) - len(CLOSE) + 1), F.substring(body, F.lit(1), F.length(body) - len(CLOSE)))
        return F.struct(_unescape_role(role).alias("role"), raw.alias("raw"), unescape(raw).alias("text"))

    pieces = F.split(rendered, r"<\|im_start\|>", -1)
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_chats(rows: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """rows (conv_id, turn, role, text). Returns (conv_id, formatted string, loss_spans array<struct<start, length>>, escaped_turns long,
    identical boolean): the rendered conversation; where in it, in code points from 1, the texts of trained roles stand; how many
    turns had to be escaped; whether the turns that the parser reads from the whole are the source's, which is true of each row: reading
    `formatted` of a conversation of which it isn't raises an error.

    One shuffle by conv_id serves the running lengths and the grouping.
    """
    own = ["conv_id", "alone_id"]
    turns = rows.select("conv_id", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    alone = F.col("alone")
    turns = turns.withColumn("alone", parse(render_turn(F.col("role"), F.col("text"))))
    turns = turns.withColumn("fits", (F.size(alone) == 1) & (F.element_at(alone, 1)["role"] == F.col("role")) & F.coalesce(F.element_at(alone, 1)["text"] == F.col("text"), F.lit(False))).drop("alone")
    turns = turns.withColumn("out_role", F.when(F.col("fits"), F.col("role")).otherwise(_escape_role(F.col("role")))).withColumn("out_text", F.when(F.col("fits"), F.col("text")).otherwise(escape(F.col("text"))))
    turns = turns.withColumn("piece", render_turn(F.col("out_role"), F.col("out_text")))
    so_far = Window.partitionBy(*own).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("end", F.sum(F.length("piece").cast("long")).over(so_far)).withColumn("at", F.row_number().over(so_far))
    start = F.col("end") - len(CLOSE) - F.length("out_text") + 1
    turns = turns.withColumn("span", F.when(F.col("role").isin(*trained_roles), F.struct(start.alias("start"), F.length("out_text").cast("long").alias("length"))))
    chats = turns.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("at", "role", "text", "piece", "span", "fits"))).alias("turns"))
    chats = chats.withColumn("formatted", F.array_join(F.col("turns")["piece"], ""))
    chats = chats.withColumn("identical", F.coalesce(_plain(parse(F.col("formatted"))) == _plain(F.col("turns")), F.lit(False)))
    return chats.select(
        "conv_id",
        F.when(F.col("identical"), F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("a conversation doesn't come back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))).alias("formatted"),
        F.filter(F.col("turns")["span"], lambda s: s.isNotNull()).alias("loss_spans"),
        F.size(F.filter("turns", lambda t: ~t["fits"])).cast("long").alias("escaped_turns"),
        "identical",
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, read from the rendered string and unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")
