"""Chat formatting with native expressions: a role machine, a declarative template, loss flags by segment.

The template marks turns with control strings. Control strings inside texts (and in roles) are escaped by writing their
first character as % and two hex digits, and % itself as %25, so the formatted text parses back to exactly the turns given.

A finite-state machine over roles validates the order of turns. Its state at any turn comes from composing transition
tables: first within blocks of turns, then over the blocks of a conversation, so a conversation of any length is never one
task's window. Only the finished text of a conversation, which is one value of the result, is assembled as a whole.

Defined cases: a null text or role is empty; turns are ordered by (turn, role, text), nulls first, and repeated rows are
kept as turns of their own; a row without conv_id is a conversation of its own (rows that are equal are its turns); columns of
other names are not read; an empty table gives no rows; an unknown role or a turn out of order makes the
conversation invalid (valid = false, first_bad = its first such place) but it is formatted all the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is written (prefix, role, middle, text, suffix), which roles are trained on, and which orders are valid.

    middle is one character; in a role it is escaped like a control string.
    """

    prefix: str = "<|im_start|>"
    middle: str = "\n"
    suffix: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Strings that must not appear in a text as they are; the template's own marks start with the first.
    controls: tuple[str, ...] = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    states: tuple[str, ...] = ("start", "system", "user", "assistant", "tool", "bad")
    #: State after a role, by state. What is missing leads to the last state, which nothing leaves.
    moves: dict = field(
        default_factory=lambda: {
            ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant",
            ("assistant", "user"): "user", ("assistant", "tool"): "tool", ("tool", "tool"): "tool", ("tool", "assistant"): "assistant",
        }
    )
    block: int = 128

    def escape(self, text: Column) -> Column:
        coded = F.replace(text, F.lit("%"), F.lit("%25"))
        return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(f"%{ord(c[0]):02X}{c[1:]}")), self.controls, coded)

    def unescape(self, text: Column) -> Column:
        firsts = dict.fromkeys([*(c[0] for c in self.controls), self.middle])
        plain = reduce(lambda x, c: F.replace(x, F.lit(f"%{ord(c):02X}"), F.lit(c)), firsts, text)
        return F.replace(plain, F.lit("%25"), F.lit("%"))

    def step(self, role: Column) -> Column:
        """Transition table of a role: for each state, the number of the next one."""
        index = {s: k for k, s in enumerate(self.states)}
        bad = len(self.states) - 1
        known = sorted({r for _, r in self.moves})
        table = {r: [index[self.moves[s, r]] if (s, r) in self.moves else bad for s in self.states] for r in known}
        out = F.when(F.lit(False), F.array(*[F.lit(bad)] * len(self.states)))
        for r in known:
            out = out.when(role == r, F.array(*map(F.lit, table[r])))
        return out.otherwise(F.array(*[F.lit(bad)] * len(self.states)))


def _compose(tables: Column, n: int) -> Column:
    """Table of running through an array of tables in order."""
    return F.aggregate(tables, F.array(*map(F.lit, range(n))), lambda acc, t: F.transform(acc, lambda s: F.get(t, s)))


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, formatted, segments (start, length, role, loss; in code points), valid, first_bad."""
    t = template or Template()
    n, bad = len(t.states), len(t.states) - 1
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head = F.concat(F.lit(t.prefix), F.replace(t.escape(role), F.lit(t.middle), F.lit(f"%{ord(t.middle):02X}")), F.lit(t.middle))
    own = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).alias("own")
    rows = turns.select(
        "conv_id", own, F.floor(F.col("turn") / t.block).alias("block"),
        F.struct(
            F.col("turn"), role.alias("role"), text.alias("text"), F.concat(head, t.escape(text), F.lit(t.suffix)).alias("out"),
            F.length(head).alias("head"), t.step(role).alias("step"), role.isin(*t.loss_roles).alias("loss"),
        ).alias("turn"),
    )
    # Within a block: the turns in order, what they become, the places of their segments and the block's transition table.
    blocks = rows.groupBy("conv_id", "own", "block").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    ends = F.aggregate("turns", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x["out"]))))
    blocks = blocks.withColumn("ends", ends).select(
        "conv_id", "own", "block", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda x: x["out"]), "").alias("out"),
        F.transform(
            "turns",
            lambda x, k: F.struct((F.get("ends", k) + x["head"]).alias("start"), (F.length(x["out"]) - x["head"] - len(t.suffix)).alias("length"), x["role"].alias("role"), x["loss"].alias("loss")),
        ).alias("segments"),
        F.transform("turns", lambda x: x["step"]).alias("steps"),
    )
    blocks = blocks.withColumn("table", _compose(F.col("steps"), n))
    whole = blocks.groupBy("conv_id", "own").agg(F.array_sort(F.collect_list(F.struct("block", "n", F.length("out").alias("size"), "out", "segments", "steps", "table"))).alias("blocks"))
    # Over the blocks: where each one starts in the text, and the machine's state there.
    at = F.aggregate(
        "blocks", F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("state"), F.lit(0).alias("turns"))),
        lambda acc, b: F.concat(acc, F.array(F.struct((F.element_at(acc, -1)["at"] + b["size"]).alias("at"), F.get(b["table"], F.element_at(acc, -1)["state"]).alias("state"), (F.element_at(acc, -1)["turns"] + b["n"]).alias("turns")))),
    )
    whole = whole.withColumn("at", at)
    segments = F.flatten(F.transform("blocks", lambda b, k: F.transform(b["segments"], lambda s: F.struct((s["start"] + F.get("at", k)["at"]).alias("start"), s["length"].alias("length"), s["role"].alias("role"), s["loss"].alias("loss")))))
    # The first block that ends in the bad state holds the first bad turn.
    first = F.array_position(F.transform("at", lambda x: (x["state"] == bad).cast("int")), 1) - 2
    scan = F.aggregate(
        F.get("blocks", first)["steps"], F.struct(F.get("at", first)["state"].alias("state"), F.lit(0).alias("seen")),
        lambda acc, s: F.when(acc["state"] == bad, acc).otherwise(F.struct(F.get(s, acc["state"]).alias("state"), (acc["seen"] + 1).alias("seen"))),
    )
    return whole.select(
        "conv_id", F.element_at("at", -1)["turns"].cast("long").alias("n_turns"), F.array_join(F.transform("blocks", lambda b: b["out"]), "").alias("formatted"), segments.alias("segments"),
        (F.element_at("at", -1)["state"] != bad).alias("valid"), F.when(first >= 0, F.get("at", first)["turns"] + scan["seen"] - 1).cast("long").alias("first_bad"),
    )


def parse_chats(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Reads formatted texts back: adds turns, an array of role and text, unescaped."""
    t = template or Template()
    parts = F.slice(F.split("formatted", r"\Q" + t.prefix + r"\E", -1), 2, 1 << 30)

    def turn(x: Column) -> Column:
        body = F.substring(x, F.lit(1), F.length(x) - len(t.suffix))
        cut = F.locate(t.middle, body)
        return F.struct(t.unescape(F.substring(body, F.lit(1), cut - 1)).alias("role"), t.unescape(F.substring(body, cut + len(t.middle), F.length(body))).alias("text"))

    return formatted.withColumn("turns", F.transform(parts, turn))
