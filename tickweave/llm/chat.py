"""Chat formatting that is parsed again before it is kept.

Grammar of the formatted text::

    conversation := turn*
    turn         := "<s>[INST]" role "[/INST]" text "</s>"

A control string inside a role or text gets one backslash after its first
character (``</s>`` becomes ``<\\/s>``), one more if it has some already. So no
control string is left, and taking one backslash away gives the source back: one pass
of escaping is always enough (tested on arbitrary strings). The plain rendering is
parsed first by the grammar; if it does not parse or says other turns than the source,
the escaped one is rendered, parsed and compared as well (``round_trip``).

The loss mask is made while rendering: the spans (start, length, in code points) of
``formatted`` that hold the texts of a role. All of it is DataFrame expressions.

Defined cases: null role or text is empty; turns are ordered by (turn, role,
text), repeated rows are turns of their own; a null conversation id is one
conversation; an empty table gives no rows; other columns are ignored. One
conversation is one output row, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
#: A control string as it stands in the grammar, without a backslash.
PLAIN = r"[<\[]/?(?:s>|INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3"))


def render(turns: Column, change=lambda x: x) -> Column:
    """The formatted text of an array of (role, text)."""
    one = lambda t: F.concat(F.lit(OPEN), change(t["role"]), F.lit(MIDDLE), change(t["text"]), F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def mask(turns: Column, role: str, change=lambda x: x) -> Column:
    """The spans (start from 0, length) of render(turns, change) that hold the texts of ``role``."""
    span = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.slice(F.array(span), 1, 0).alias("spans"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.lit(len(OPEN) + len(MIDDLE)) + F.length(change(t["role"]))
        length = F.length(change(t["text"])).cast("long")
        one = F.struct(start.alias("start"), length.alias("length"))
        return F.struct((start + length + F.lit(len(CLOSE))).alias("at"), F.when(t["role"] == role, F.concat(a["spans"], F.array(one))).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, none, step, lambda a: a["spans"])


def parse(formatted: Column) -> Column:
    """The array of (role, text) that a formatted text says, null if the grammar does not fit.

    Each piece up to a closing mark must begin with the opening mark and is cut at its
    first middle mark; no further control string may be in it, and nothing may follow the last.
    """
    pieces = F.split(formatted, CLOSE, -1)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)
    inner = lambda piece: piece.substr(F.lit(len(OPEN) + 1), F.length(piece))

    def fits(piece: Column) -> Column:
        body = inner(piece)
        return piece.startswith(OPEN) & body.contains(MIDDLE) & (F.regexp_count(body, F.lit(PLAIN)) == 1)

    def turn(piece: Column) -> Column:
        body = inner(piece)
        role = F.substring_index(body, MIDDLE, 1)
        text = body.substr(F.length(role) + F.lit(len(MIDDLE) + 1), F.length(body))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.when((F.element_at(pieces, -1) == "") & F.forall(whole, fits), F.transform(whole, turn))


def format_chats(rows: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_mask (spans of ``formatted``), escaped, round_trip, and ``turns`` as read back from ``formatted``."""
    empty = F.lit("")
    said = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), empty).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), empty).alias("text"),
        ).alias("t"),
    )
    source = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    source = source.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    plain = source.withColumn("_plain", render(F.col("source")))
    tried = plain.withColumn("escaped", ~parse(F.col("_plain")).eqNullSafe(F.col("source")))
    formatted = F.when(F.col("escaped"), render(F.col("source"), escape)).otherwise(F.col("_plain"))
    spans = F.when(F.col("escaped"), mask(F.col("source"), loss_role, escape)).otherwise(mask(F.col("source"), loss_role))
    done = tried.withColumn("formatted", formatted).withColumn("loss_mask", spans).drop("_plain")
    read = done.withColumn("turns", parse(F.col("formatted")))
    return read.select("conv_id", "formatted", "loss_mask", "escaped", "turns", F.col("turns").eqNullSafe(F.col("source")).alias("round_trip"))


def loss_texts(formatted: Column, loss_mask: Column) -> Column:
    """The text under the loss mask, read from ``formatted``, unescaped, in order, nothing between."""
    cut = lambda x: unescape(formatted.substr(x["start"].cast("int") + 1, x["length"].cast("int")))
    return F.array_join(F.transform(loss_mask, cut), "")
