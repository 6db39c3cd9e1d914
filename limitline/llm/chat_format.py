"""Chat formatting from a declarative template, with DataFrame functions alone.

A template says how a turn begins and ends, which roles are learned, how roles may follow
each other, and which characters are written as escapes. The characters that begin a
control string never occur in an escaped text, so a formatted conversation can be taken
apart again exactly, whatever its texts say.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written. ``opening`` + role + ``after_role`` + text + ``closing``.

    ``escapes`` maps characters to their escapes; the backslash must be among them, and so
    must the first character of ``opening`` and ``closing``. ``role_escapes`` are added
    inside roles, for ``after_role``. ``follows`` has the roles that may come after each
    role ("" before the first turn), ``last`` those that may end a conversation.
    """

    opening: str = "### "
    after_role: str = ": "
    closing: str = "</turn>\n"
    learned: tuple[str, ...] = ("assistant",)
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
    role_escapes: tuple[tuple[str, str], ...] = ((":", "\\c"),)
    follows: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("", ("system", "user")),
        ("system", ("user",)),
        ("user", ("assistant",)),
        ("assistant", ("user",)),
    )
    last: tuple[str, ...] = ("assistant",)


CHAT = Template()

#: State of a conversation with a turn out of order; no role leads out of it.
_REJECTED = "\u0000rejected"


def escaped(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def unescaped(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[1]), F.lit(p[0])), reversed(pairs), text)


def _in_order(turns: Column, template: Template) -> Column:
    """Runs the roles through the machine; whether it ends where a conversation may."""
    follows = F.create_map(
        *(x for role, nexts in template.follows for x in (F.lit(role), F.array(*map(F.lit, nexts))))
    )

    def step(state: Column, turn: Column) -> Column:
        allowed = F.coalesce(F.array_contains(F.element_at(follows, state), turn["role"]), F.lit(False))
        return F.when(allowed, turn["role"]).otherwise(F.lit(_REJECTED))

    return F.aggregate(turns, F.lit(""), step).isin(*template.last)


def _segments(turn: Column, template: Template) -> Column:
    """Three segments of a turn: its head, its text and its end; only a learned text is under the loss."""
    role = escaped(turn["role"], template.escapes + template.role_escapes)
    head = F.concat(F.lit(template.opening), role, F.lit(template.after_role))
    learned = turn["role"].isin(*template.learned)

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    return F.array(
        segment(head, F.lit(False)),
        segment(escaped(turn["text"], template.escapes), learned),
        segment(F.lit(template.closing), F.lit(False)),
    )


def format_chats(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conv_id: segments (text, loss), formatted, in_order.

    ``turns`` has conv_id, turn, role, text. Rows of a conversation go by turn, those of
    equal or no turn by role and text, no turn first; repeated rows count each. Null text
    or role counts as empty; a null conv_id is a conversation of its own. Every
    conversation is formatted; ``in_order`` tells if its roles follow the template's
    order. An empty table gives no rows; other columns are not read.
    """
    row = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: _segments(t, template)))
    return grouped.select(
        "conv_id", segments.alias("segments"), _in_order(F.col("turns"), template).alias("in_order")
    ).select("conv_id", "segments", F.concat_ws("", "segments.text").alias("formatted"), "in_order")


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, _quoted(template.closing), -1)
    whole = F.filter(parts, lambda p, i: i < F.size(parts) - 1)
    skip, gap = len(template.opening), len(template.after_role)

    def turn(part: Column) -> Column:
        mark = F.instr(part, template.after_role)  # from 1; the first one, as roles have none
        role = F.substr(part, F.lit(skip + 1), mark - F.lit(skip + 1))
        text = F.substr(part, mark + F.lit(gap))
        return F.struct(
            unescaped(role, template.escapes + template.role_escapes).alias("role"),
            unescaped(text, template.escapes).alias("text"),
        )

    return F.transform(whole, turn)


def loss_text(segments: Column, template: Template = CHAT) -> Column:
    """All text under the loss, unescaped."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.concat_ws("", F.transform(kept, lambda s: unescaped(s["text"], template.escapes)))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"
