"""Chat formatting in DataFrame functions alone: a finite-state machine over roles, and a declarative template.

Every turn becomes three segments: the marks before its text, the text, and the mark behind it. A segment says whether
it counts in the loss. Texts and roles are escaped: behind each character that begins a control string comes a
backslash, and behind each backslash another. No control string is left in them, and one expression takes it back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    opens: str = "<|im_start|>"
    names: str = "<|im_sep|>"
    closes: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Strings that stand for something else in any text that a model reads.
    control: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    start: str = "start"
    #: (state, role): next state. Any other turn is out of order.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "instructed",
            ("start", "user"): "asked",
            ("instructed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    #: States in which a conversation may end.
    ends: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        for mark in (self.opens, self.names, self.closes, *self.control):
            if len(mark) < 2 or mark[1] == "\\":
                raise ValueError(f"not a control string: {mark!r}")

    def _leads(self) -> str:
        first = {mark[0] for mark in (self.opens, self.names, self.closes, *self.control)} | {"\\"}
        return "([" + "".join("\\" + c if not c.isalnum() else c for c in sorted(first)) + "])"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._leads(), r"$1\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._leads() + r"\\", "$1")


def _order(template: Template, turns: Column) -> tuple[Column, Column]:
    """(whether the turns are in order to the end, place of the first that is not, or null)."""
    table = F.create_map(*(x for (state, role), to in template.moves.items() for x in (F.lit(f"{state}\n{role}"), F.lit(to))))
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(a: Column, turn: Column) -> Column:
        to = table[F.concat(a["state"], F.lit("\n"), turn["role"])]
        bad = F.when(a["bad"].isNull() & to.isNull(), a["at"]).otherwise(a["bad"])
        return F.struct(F.coalesce(to, a["state"]).alias("state"), (a["at"] + 1).alias("at"), bad.alias("bad"))

    end = F.aggregate(turns, begin, step)
    return end["bad"].isNull() & end["state"].isin(*template.ends), end["bad"]


def format_chats(turns: DataFrame, template: Template | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (text and loss flag; joined they are `formatted`), in_order and
    first_bad_turn (its place, from 0).

    Turns are taken by their number, then role and text; repeated rows stay. A null text or role is empty, a null
    number comes first, and a turn without a conversation is one by itself. A conversation out of order is formatted like
    any other and marked.
    """
    template = template or Template()
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.struct(
            F.col(f"`{turn_col}`").cast("long").alias("turn"),
            F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        ).alias("row"),
        F.when(F.col(f"`{conv_col}`").isNull(), F.monotonically_increasing_id()).alias("alone"),
    )
    grouped = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(template.opens), template.escape(t["role"]), F.lit(template.names)).alias("text"), F.lit(False).alias("loss")),
                F.struct(template.escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
                F.struct(F.lit(template.closes).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    in_order, bad = _order(template, F.col("turns"))
    return grouped.select("conv_id", segments.alias("segments"), in_order.alias("in_order"), bad.alias("first_bad_turn")).withColumn(
        "formatted", F.array_join(F.col("segments.text"), "")
    )


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) of a formatted conversation."""
    template = template or Template()
    parts = F.split(formatted, re.escape(template.opens), -1)
    return F.transform(
        F.slice(parts, 2, F.size(parts)),
        lambda p: F.struct(
            template.unescape(F.substring_index(p, template.names, 1)).alias("role"),
            template.unescape(F.substring_index(F.substring_index(p, template.names, -1), template.closes, 1)).alias("text"),
        ),
    )


def read_loss(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped."""
    template = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")
