"""Chat formatting: a finite-state machine over roles, text segments and loss flags from a declarative template.

``chat_segments`` validates each turn against the transition table with one window per conversation (the state
before a turn is the role before it), renders the turn by the template and flags the segments that bear loss.
``chat_format`` puts a conversation's segments together; ``chat_parse`` reads turns and loss text back from the
formatted text and its loss spans. Where a segment starts comes from a running sum over the turns, so that both take
time in proportion to a conversation's length. DataFrame operations only.

Defined cases: a null role or text counts as empty; equal turns are ordered by role, then text; roles outside the
table are formatted and marked invalid; control strings inside roles and texts are escaped and restored exactly;
a null conv_id is a conversation of its own; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """How a turn is written: open, role, middle, text, close. All control strings begin with ``<|``."""

    open: str = "<|im_start|>"
    middle: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state (the role before, "" at the start) -> roles that may follow
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})


TEMPLATE = ChatTemplate()


def escape(text: Column) -> Column:
    """One backslash more between ``<`` and ``|``: no control string is left, and ``unescape`` undoes it."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    """A role stays on one line: backslash and line feed are written as two characters."""
    r = F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(r)


def _unescape_role(role: Column) -> Column:
    # the doubled backslash is set aside as one control character that no escaped role contains in pairs
    r = F.transform(F.split(unescape(role), r"\\\\"), lambda part: F.replace(part, F.lit("\\n"), F.lit("\n")))
    return F.array_join(r, "\\")


def chat_segments(turns: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """One row per turn: conv_id, turn, role, valid, and segments array<struct<text, loss>> in order."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    state = F.coalesce(F.lag("role").over(order), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    valid = F.lit(False)
    for before, after in template.follows.items():
        valid = valid | ((state == before) & role.isin(*after))
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no, loss = F.lit(False), role.isin(*template.loss_roles)
    segments = F.array(
        seg(F.concat(F.lit(template.open), _escape_role(F.col("role")), F.lit(template.middle)), no), seg(escape(F.col("text")), loss), seg(F.lit(template.close), no)
    )
    return turns.select("conv_id", "turn", "role", "text", valid.alias("valid"), segments.alias("segments"))


def chat_format(turns: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, valid (every turn), formatted, and loss_spans
    array<struct<start, length, turn, offset>>.

    start and length count code points of ``formatted``; turn is the number of the turn that a span lies in (from 0)
    and offset its place after that turn's beginning. A conversation's whole text is one value, as the format asks for.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = chat_segments(turns, template)
    size = lambda i: F.length(F.get("segments", F.lit(i))["text"]).cast("long")
    rows = rows.withColumn("_piece", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    rows = rows.select("conv_id", "valid", "_piece", "segments", (F.row_number().over(order) - 1).alias("_turn"), (F.sum(F.length("_piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("_piece")).alias("_at"))
    span = lambda i, before: F.when(
        F.get("segments", F.lit(i))["loss"], F.struct((F.col("_at") + before).alias("start"), size(i).alias("length"), F.col("_turn").alias("turn"), before.alias("offset"))
    )
    spans = F.array_compact(F.array(span(0, F.lit(0).cast("long")), span(1, size(0)), span(2, size(0) + size(1))))
    rows = rows.select("conv_id", "valid", F.struct("_turn", F.col("_piece").alias("piece"), spans.alias("spans")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.bool_and("valid").alias("valid"), F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select("conv_id", "valid", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), F.flatten(F.transform("t", lambda x: x["spans"])).alias("loss_spans"))


def chat_parse(formatted: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """Reads ``chat_format``'s output back: turns array<struct<role, text>> and loss_text array<string>, unescaped."""
    q = lambda s: "\\Q" + s + "\\E"
    body = F.split("formatted", q(template.close))
    whole = formatted.select("*", F.slice(body, 1, F.size(body) - 1).alias("_body"))
    n = len(template.open)
    head = lambda x: F.substring_index(x, template.middle, 1)
    turns = F.transform(
        "_body",
        lambda x: F.struct(
            _unescape_role(F.substr(head(x), F.lit(n + 1))).alias("role"), unescape(F.substr(x, F.length(head(x)) + F.lit(len(template.middle) + 1))).alias("text")
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.get(F.col("_body"), s["turn"]), (s["offset"] + 1).cast("int"), s["length"].cast("int"))))
    return whole.select("conv_id", "valid", "formatted", turns.alias("turns"), loss.alias("loss_text"))
