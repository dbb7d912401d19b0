"""Chat formatting from a declarative template, with per-segment loss flags.

A template says, per role, what stands before and after a turn's text, whether
the text counts for the loss, and which roles may follow. The transitions are a
finite-state machine over the roles of a conversation; ``chats`` runs it by
looking one turn back, so each conversation gets ``valid`` and the number of the
first turn that breaks the order (``broken_at``). Conversations that break it
are formatted all the same.

Control strings inside a text are escaped: a backslash becomes two, and the k-th
control string becomes ``\\k;``. No control string is left in a text, none can
arise from its neighbours, and ``unescaped`` gives back the text exactly.

Null texts and roles count as empty. A role the template does not name is
written out inside the opener of ``other``, escaped too. Turns are ordered by
number (null first), equal numbers by role and text; repeated rows are turns of
their own. Columns other than the four named are not read.

One conversation is one row of the result and therefore one group; nothing else
is gathered. Long texts are escaped and read back in passes over the text. The
loss mask is a range within each turn of the output. An empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    opener: str
    closer: str
    loss: bool = False
    follows: tuple[str, ...] = ()


@dataclass(frozen=True)
class Template:
    """Roles of a chat. ``START`` in ``follows`` lets a role come first; ``final`` are the roles a conversation may end with.

    Every opener and closer is made of ``controls`` and blanks; these strings are escaped in texts.
    """

    roles: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("<<SYS>> ", " <</SYS>>", follows=("START",)),
        "user": Turn("<s>[INST] ", " [/INST]", follows=("START", "system", "assistant")),
        "assistant": Turn("[OUT] ", "</s>", loss=True, follows=("user",)),
    })
    other: Turn = Turn("[ROLE] ", " [/ROLE]")
    other_name_end: str = "[AS] "
    controls: tuple[str, ...] = ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[AS]", "[/ROLE]")
    final: tuple[str, ...] = ("user", "assistant")



TEMPLATE = Template()


def escaped(text: Column, template: Template = TEMPLATE) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for k, mark in enumerate(template.controls):
        out = F.replace(out, F.lit(mark), F.lit(f"\\{k};"))
    return out


def unescaped(text: Column, template: Template = TEMPLATE) -> Column:
    """Split at doubled backslashes; single ones in the parts are escapes."""

    def part(x: Column) -> Column:
        for k, mark in enumerate(template.controls):
            x = F.replace(x, F.lit(f"\\{k};"), F.lit(mark))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def segments(role: Column, text: Column, template: Template = TEMPLATE) -> Column:
    """The three segments of a turn as array<struct<text, loss>>: opener, text, closer."""

    def three(t: Turn, opener: Column) -> Column:
        return F.array(*[F.struct(c.alias("text"), F.lit(f).alias("loss")) for c, f in ((opener, False), (escaped(text, template), t.loss), (F.lit(t.closer), False))])

    out = three(template.other, F.concat(F.lit(template.other.opener), escaped(role, template), F.lit(template.other_name_end)))
    for name, t in template.roles.items():
        out = F.when(role == name, three(t, F.lit(t.opener))).otherwise(out)
    return out


def chats(turns: DataFrame, template: Template = TEMPLATE, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: ``segments`` in order, ``valid`` and ``broken_at``."""
    rows = turns.select(F.col(conversation).alias("c"), F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    made = rows.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("n", "r", "t"))).alias("turns"))

    def breaks(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit("START")).otherwise(F.get(F.col("turns"), i - 1)["r"])
        ok = F.lit(False)
        for name, t in template.roles.items():
            ok = F.when(x["r"] == name, before.isin(*t.follows)).otherwise(ok)
        return F.when(~ok, i)

    broken = F.array_min(F.transform("turns", breaks))
    last = F.element_at("turns", -1)["r"]
    return made.select(
        F.col("c").alias(conversation),
        F.flatten(F.transform("turns", lambda x: segments(x["r"], x["t"], template))).alias("segments"),
        (broken.isNull() & last.isin(*template.final)).alias("valid"),
        broken.cast("bigint").alias("broken_at"),
    )


def formatted(parts: Column) -> Column:
    """The training text: all segments end to end."""
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def loss_mask(parts: Column) -> Column:
    """Where each turn's output counts for the loss: struct<start, end> in code points from the turn's start, null for none."""

    def of(i: Column) -> Column:
        opener, text = F.get(parts, 3 * i), F.get(parts, 3 * i + 1)
        start = F.length(opener["text"])
        return F.when(text["loss"], F.struct(start.alias("start"), (start + F.length(text["text"])).alias("end")))

    turns = F.floor(F.size(parts) / 3).cast("int")
    return F.transform(F.when(turns > 0, F.sequence(F.lit(0), turns - 1)).otherwise(F.array().cast("array<int>")), of)


def pieces(text: Column, template: Template = TEMPLATE) -> Column:
    """A formatted text cut into its turns, found by the template's markers alone."""
    pattern = "|".join(f"{_quote(t.opener)}[\\s\\S]*?{_quote(t.closer)}" for t in (*template.roles.values(), template.other))
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def under_mask(text: Column, mask: Column, template: Template = TEMPLATE) -> Column:
    """What a formatted text holds under its loss mask, unescaped, in order."""
    parts = F.zip_with(pieces(text, template), mask, lambda p, m: F.when(m.isNotNull(), unescaped(p.substr(m["start"] + 1, m["end"] - m["start"]), template)).otherwise(""))
    return F.array_join(parts, "")


def read_back(text: Column, template: Template = TEMPLATE) -> Column:
    """The turns of a formatted text as array<struct<role, text>>, found by the template's markers alone."""
    names = [*template.roles, None]
    kinds = [*template.roles.values(), template.other]
    found = pieces(text, template)

    def turn(x: Column) -> Column:
        name_end = F.position(F.lit(template.other_name_end), x)
        start, stop = len(template.other.opener), len(template.other.closer)
        out = F.struct(unescaped(x.substr(F.lit(start + 1), name_end - start - 1), template).alias("role"),
                       unescaped(x.substr(name_end + len(template.other_name_end), F.length(x) - stop - name_end - len(template.other_name_end) + 1), template).alias("text"))
        for name, t in zip(names[:-1], kinds[:-1]):
            cut = x.substr(F.lit(len(t.opener) + 1), F.length(x) - len(t.opener) - len(t.closer))
            out = F.when(F.startswith(x, F.lit(t.opener)), F.struct(F.lit(name).alias("role"), unescaped(cut, template).alias("text"))).otherwise(out)
        return out

    return F.transform(found, turn)


def _quote(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|/<>&" else c for c in s)
