"""Chat formatting with a role state machine, on DataFrame functions only.

A declarative template says how a turn of each role is marked and which text carries loss; a transition
table says which role may follow which. The result has the formatted text, its segments with loss flags, and
whether the turn order was valid.

Control strings inside texts and roles are escaped reversibly: an escape character goes after the first
character of each, and an escape character of the text itself is doubled.

Defined results: null text or role counts as empty; turns are ordered by (turn, role, text), nulls first, and
repeated rows stay as turns of their own; rows with a null id are one conversation; long texts are
formatted whole; an invalid order sets ``valid`` false and is formatted all the
same; an empty table gives an empty table; columns other than the four used are not kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\ue000"  # of the private use area


@dataclass(frozen=True)
class Template:
    """Marks of a turn, roles whose text carries loss, control strings to escape, allowed steps between roles."""

    open: str = "<|turn|>"
    text: str = "<|text|>"
    close: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    # Control strings of common chat formats.
    control: tuple[str, ...] = ("<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    steps: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)}
    )
    final: tuple[str, ...] = ("assistant",)


TEMPLATE = Template()


def _quote(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != ESCAPE else c for c in text)


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    doubled = F.regexp_replace(text, ESCAPE, ESCAPE * 2)
    inside = "|".join(f"(?<={_quote(c[0])})(?={_quote(c[1:])})" for c in template.control)
    return F.regexp_replace(doubled, inside, ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"{ESCAPE}({ESCAPE}?)", "$1")


def order_is_valid(roles: Column, template: Template = TEMPLATE) -> Column:
    """Runs the state machine over the roles; the state after a forbidden step is ``!`` for good."""
    step = lambda state, role: F.coalesce(
        *[F.when((state == a) & role.isin(*b), role) for a, b in template.steps.items()], F.lit("!")
    )
    return F.aggregate(roles, F.lit(""), step).isin(*template.final)


def format_chats(turns: DataFrame, template: Template = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, valid, segments array<struct<text, loss>>, formatted``.

    A conversation's rows meet in one task, since its text is one value of the result.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    row = F.struct(F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    grouped = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    lit = F.lit

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(F.concat(lit(template.open), escape(t.getField("role"), template), lit(template.text)), lit(False)),
                segment(escape(t.getField("text"), template), t.getField("role").isin(*template.loss_roles)),
                segment(lit(template.close), lit(False)),
            ),
        )
    )
    return grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        order_is_valid(F.col("turns.role"), template).alias("valid"),
        segments.alias("segments"),
    ).withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """``array<struct<role, text>>`` read back from formatted text."""
    turns = F.filter(F.split(formatted, _quote(template.open)), lambda x: x != "")
    mark = _quote(template.text)
    close = F.length(F.lit(template.close))

    def parts(t: Column) -> Column:
        two = F.split(F.substring(t, F.lit(1), F.length(t) - close), mark, 2)
        return F.struct(unescape(F.get(two, 0)).alias("role"), unescape(F.get(two, 1)).alias("text"))

    return F.transform(turns, parts)
