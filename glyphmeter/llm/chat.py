"""Chat formatting (DataFrame functions only).

A declarative template says how each role is written and which roles carry loss. A finite-state machine over the roles
checks the order of turns. Every turn becomes three segments (head, text, tail) with a loss flag of their own; control
strings inside texts and roles are escaped reversibly, so the output can be read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Template:
    """head + role + after_role + text + tail for each turn; loss_roles carry loss on their text."""

    head: str = "<|im_start|>"
    after_role: str = "\n"
    tail: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: From a state, the roles that may follow; the state after a turn is its role.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)


#: The control strings of common chat templates, without their first character, as one pattern. An
#: escaped one has "~" after its first character; each further escape adds one more.
CONTROL = r"(<|\[)(~*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|<SYS>>|</SYS>>|/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "$1~$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL.replace("(~*)", "~(~*)"), "$1$2$3")


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (start, end, loss; code points, end exclusive), valid.

    rows has conv_id, turn, role and text, in any order. Turns are ordered by turn, then role, then text; repeated
    rows stay. Null text and role count as empty, a null turn comes first, a null conv_id is a conversation of its own.
    valid says whether the state machine accepts the roles. An empty table gives an empty result. One conversation
    is put together in one task, as its text has to be in the end; conversations are independent of each other.
    """
    turns = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = turns.withColumn(
        "parts",
        F.transform("turns", lambda t: F.struct(
            F.concat(F.lit(template.head), F.replace(F.regexp_replace(escaped(t.role), "<(~*)n>", "<~$1n>"), F.lit("\n"), F.lit("<n>")), F.lit(template.after_role)).alias("head"),
            escaped(t.text).alias("body"), t.role.isin(*template.loss_roles).alias("loss"), t.role.alias("role"))),
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,loss:boolean>>").alias("segments"))

    def place(acc: Column, p: Column) -> Column:
        head, body, tail = F.length(p["head"]).cast("long"), F.length(p["body"]).cast("long"), len(template.tail)
        a = acc["at"]
        seg = lambda s, e, loss: F.struct(s.alias("start"), e.alias("end"), loss.alias("loss"))
        new = F.array(seg(a, a + head, F.lit(False)), seg(a + head, a + head + body, p["loss"]), seg(a + head + body, a + head + body + tail, F.lit(False)))
        return F.struct((a + head + body + tail).alias("at"), F.concat(acc["segments"], new).alias("segments"))

    def step(state: Column, t: Column) -> Column:
        allowed = F.lit(False)
        for source, roles in template.follows.items():
            allowed = allowed | ((state == source) & t.role.isin(*roles))
        return F.when(allowed, t.role).otherwise(F.lit("!"))

    return parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(template.tail))), "").alias("formatted"),
        F.aggregate("parts", zero, place)["segments"].alias("segments"),
        F.aggregate("turns", F.lit(""), step).isin(*template.ends).alias("valid"),
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, from formatted and segments alone."""
    pieces = F.split(F.col("formatted"), F.lit(f"\\Q{template.tail}\\E"))

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(template.head) + 1))
        cut = F.instr(inner, template.after_role)
        role = F.regexp_replace(F.replace(F.left(inner, cut - 1), F.lit("<n>"), F.lit("\n")), "<~(~*)n>", "<$1n>")
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(inner, cut + len(template.after_role))).alias("text"))

    return formatted.select(
        "conv_id", "formatted", "valid",
        F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescaped(F.substr("formatted", (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "").alias("loss_text"),
    )


def digests(back: DataFrame) -> DataFrame:
    return back.select(
        "conv_id",
        F.size("turns").cast(T.LongType()).alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast(T.LongType()).alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast(T.LongType()).alias("formatted_chars"),
        "valid",
    )
