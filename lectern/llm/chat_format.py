"""Chat formatting: a finite-state machine over roles and a declarative template.

All of it is DataFrame functions. A conversation becomes one string in which
every turn stands between control strings; what could make a control string inside
a text or a role is escaped, as the template asks, so that the string can be read
back exactly. A conversation is one value of the result, so its turns meet in one task.

Defined results
- null text or null role: the empty string;
- null ``turn``: before all others; equal turns: by role, then text; repeated
  rows: each is a turn of its own;
- null ``conv_id``: one conversation of its own; an empty table gives no rows;
- roles that the template does not list are formatted without loss and make
  the conversation invalid (``valid`` false, ``bad_turn`` the first offender).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings, roles under loss, and the turn order as a state machine.

    Control strings begin with a character that is neither letter nor digit and
    hold no backslash; a template in which ``end`` comes about where none is
    meant, even between empty texts, is refused.
    """

    open: str = "<|"
    close: str = "|>"
    end: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        for c in (self.open, self.close, self.end):
            if not c or c[0].isalnum() or "\\" in c:
                raise ValueError(f"{c!r} cannot be a control string")
        turn = self.open + self.close + self.end
        if (turn * 2).find(self.end) != len(self.open + self.close) or (turn * 2).find(self.end, len(turn)) != len(turn) + len(self.open + self.close):
            raise ValueError("the end of a turn would be found where none is")

    def escapes(self) -> tuple[tuple[str, str], ...]:
        """What stands for the backslash and for each first character of a control string, backslash first."""
        firsts = list(dict.fromkeys(c[0] for c in (self.open, self.close, self.end)))
        spare = iter("acdefghijkmno")
        return (("\\", "\\b"), *((c, {"<": "\\l", "|": "\\p"}.get(c) or "\\" + next(spare)) for c in firsts))

    def completes(self, before: str) -> str:
        """Characters with which a text after the control string ``before`` could go on to ``end``."""
        tails = [before[i:] for i in range(len(before))]
        return "".join(sorted({self.end[len(t)] for t in tails if self.end.startswith(t) and len(t) < len(self.end)}))


DEFAULT = Template()
#: Stands before a text that could complete a control string with what comes before it; it means nothing.
APART = "\\z"


def escape(col: Column, template: Template = DEFAULT, before: str = "") -> Column:
    """No first character of a control string is left, nor one at the start that completes ``before``, so no control string can come about."""
    for plain, coded in template.escapes():
        col = F.replace(col, F.lit(plain), F.lit(coded))
    risky = template.completes(before) if before else ""
    return F.when(F.substring(col, 1, 1).isin(*risky), F.concat(F.lit(APART), col)).otherwise(col) if risky else col


def unescape(col: Column, template: Template = DEFAULT) -> Column:
    """The inverse: the backslash comes last, as it was coded first."""
    col = F.replace(col, F.lit(APART), F.lit(""))
    for plain, coded in reversed(template.escapes()):
        col = F.replace(col, F.lit(coded), F.lit(plain))
    return col


def _final_state(roles: Column, template: Template) -> Column:
    """(state, number of turns read, first bad turn or null) after all roles."""
    table = F.create_map(*[F.lit(x) for (s, r), to in template.moves.items() for x in (f"{s}>{r}", to)])

    def step(acc: Column, role: Column) -> Column:
        to = F.try_element_at(table, F.concat(acc["state"], F.lit(">"), role))
        return F.struct(
            F.coalesce(to, F.lit("error")).alias("state"),
            (acc["n"] + 1).alias("n"),
            F.when(acc["bad"].isNull() & to.isNull(), acc["n"]).otherwise(acc["bad"]).alias("bad"),
        )

    first = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    return F.aggregate(roles, first, step)


def format_conversations(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, formatted, segments, valid, bad_turn.

    ``segments`` is the formatted string in order, cut into ``text`` with a
    ``loss`` flag each. The shuffle is on ``conv_id``; a conversation is one
    value of the result, so its rows must meet in one task.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    segments = F.flatten(
        F.transform(
            "t",
            lambda t: F.array(
                F.struct(F.concat(F.lit(template.open), escape(t["role"], template, template.open), F.lit(template.close)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"], template, template.close).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
                F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    end = _final_state(F.transform("t", lambda t: t["role"]), template)
    return grouped.select("conv_id", segments.alias("segments"), end.alias("end")).select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        F.col("end.state").isin(*template.final).alias("valid"),
        F.col("end.bad").alias("bad_turn"),
    )


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """array<struct<role, text>> read back from a formatted string alone."""
    pieces = F.split(formatted, "\\Q" + template.end + "\\E", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # nothing stands after the last end
    n, m = len(template.open), len(template.close)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(n + 1), F.locate(template.close, p, n + 1) - n - 1), template).alias("role"),
            unescape(F.substring(p, F.locate(template.close, p, n + 1) + m, F.length(p)), template).alias("text"),
        ),
    )


def loss_text(segments: Column, template: Template = DEFAULT) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"], template)), "")
