"""Chat formatting: a finite-state machine over roles and a declarative template.

A template names the control strings, the roles under the loss, and the moves of a machine whose
states are entered by roles. A conversation's rows, in order of their turns, become text segments
with a loss flag each: a turn is its header, its text and its end mark, and the text of a role
under the loss is the only segment that carries the flag. The machine reads the roles and tells
whether the order is one that the template allows, and at which turn it stopped.

Control strings inside texts are escaped reversibly: between the two parts of the opener that all
control strings begin with (``<`` and ``|``) stands one backslash more than in the text, so that
no text holds the opener itself. A formatted conversation can be read back without loss
(:func:`read_turns`).

Everything is built-in expressions. A conversation is one value in the end, so its rows do meet in
one task; they are combined before the shuffle, and nothing else is gathered.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Template:
    """Control strings, roles under the loss, and the machine: moves (state, role) -> state, and the states to end in."""

    turn_start: str = "<|im_start|>"
    turn_end: str = "<|im_end|>"
    after_turn: str = "\n"
    opener: tuple[str, str] = ("<", "|")
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            (START, "system"): "told",
            (START, "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    ends: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        first, rest = self.opener
        if not first or not rest or "\\" in first + rest or rest[0] in first:
            raise ValueError("an opener has two different parts without a backslash")
        for mark in (self.turn_start, self.turn_end):
            if not mark.startswith(first + rest) or mark.count(first + rest) > 1:
                raise ValueError(f"{mark!r} has to begin with the opener and hold it once")
        if self.turn_start.startswith(self.turn_end) or self.turn_end.startswith(self.turn_start) or first + rest in self.after_turn:
            raise ValueError("control strings have to differ")


CHATML = Template()


def escape(text: Column, template: Template = CHATML) -> Column:
    """One backslash more between the opener's two parts."""
    first, rest = map(re.escape, template.opener)
    return F.regexp_replace(text, rf"({first}\\*)({rest})", r"$1\\$2")


def unescape(text: Column, template: Template = CHATML) -> Column:
    first, rest = map(re.escape, template.opener)
    return F.regexp_replace(text, rf"({first}\\*)\\({rest})", "$1$2")


def _role_out(role: Column, template: Template) -> Column:
    """A role on one line: the line break that ends a header can't stand in it."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")), template)


def _role_in(header: Column, template: Template) -> Column:
    return F.replace(F.replace(unescape(header, template), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def machine(roles: Column, template: Template = CHATML) -> Column:
    """Run the machine over an array of roles: struct(state, stop).

    ``stop`` is the number (from 1) of the turn whose role has no move, null if all have; ``state`` is then null.
    """
    table = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    begin = F.struct(F.lit(START).alias("state"), F.lit(0).cast("bigint").alias("seen"))

    def move(at: Column, role: Column) -> Column:
        to = F.try_element_at(table, F.concat_ws("\n", at["state"], role))
        return F.when(at["state"].isNull(), at).otherwise(F.struct(to.alias("state"), (at["seen"] + 1).alias("seen")))

    return F.aggregate(roles, begin, move, lambda at: F.struct(at["state"].alias("state"), F.when(at["state"].isNull(), at["seen"]).alias("stop")))


def turn_segments(role: Column, text: Column, template: Template = CHATML) -> Column:
    """The three segments of a turn, struct(text, loss): header, text, end."""
    part = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    return F.array(
        part(F.concat(F.lit(template.turn_start), _role_out(role, template), F.lit("\n")), F.lit(False)),
        part(escape(text, template), role.isin(*template.loss_roles)),
        part(F.lit(template.turn_end + template.after_turn), F.lit(False)),
    )


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, text).

    Returns conv_id, segments (array of struct(text, loss)), state and stop of the machine, and
    valid: whether it read all turns and ended in a state to end in. Conversations that it rejects
    are formatted too; whoever wants none of them filters on ``valid``.

    * A null text is empty, a null role is a role without a name, null ids are one conversation.
    * Turns with the same number come in order of role and text, repeated rows all stay; a null turn comes first.
    * No rows in, no rows out. Other columns are neither read nor returned.
    """
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    made = whole.select(
        "conv_id",
        F.flatten(F.transform("rows", lambda r: turn_segments(r["role"], r["text"], template))).alias("segments"),
        machine(F.transform("rows", lambda r: r["role"]), template).alias("end"),
    )
    return made.select("conv_id", "segments", "end.state", "end.stop", F.coalesce(F.col("end.state").isin(*template.ends), F.lit(False)).alias("valid"))


def formatted(segments: Column) -> Column:
    """The conversation's text: all segments, nothing between."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column, template: Template = CHATML) -> Column:
    """All text under the loss, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


def read_turns(text: Column, template: Template = CHATML) -> Column:
    """Read a formatted conversation back: array of struct(role, text)."""
    turns = F.filter(F.split(text, re.escape(template.turn_start), -1), lambda _, i: i > 0)
    tail = len(template.turn_end + template.after_turn)

    def turn(chunk: Column) -> Column:
        header = F.substring_index(chunk, "\n", 1)
        begin = F.length(header) + 2
        body = F.substring(chunk, begin, F.length(chunk) - begin + 1 - tail)
        return F.struct(_role_in(header, template).alias("role"), unescape(body, template).alias("text"))

    return F.transform(turns, turn)


def digests(chats: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of formatted conversations, read back from their segments.

    ``valid`` and ``stop`` of the machine follow.
    """
    out = chats.select("conv_id", "valid", "stop", formatted(F.col("segments")).alias("formatted"), loss_text(F.col("segments"), template).alias("loss"))
    out = out.select("*", read_turns(F.col("formatted"), template).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
        "stop",
    )
