"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context and
only its reply is trainable. A conversation whose last turn isn't the assistant's gives one
more row, without anything trainable, so that no turn is lost. Formatting, and reading the
turns back, are built-in expressions on arrays of a conversation's turns.

The output repeats a conversation's beginning in each of its examples; that is the method,
and it makes the output of one conversation grow with the square of its turns. The rows
are exploded one by one, so memory holds one conversation and one example at a time.

Markers are control strings, escaped inside texts by a backslash after their first
character; backslashes are doubled first, so unescaping is exact. Turns are ordered by turn
(null first), then role, then text. Defined results: null roles and texts count as empty; a
repeated row is a turn as often as it occurs; rows with a null conversation id are one
conversation; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Markers of turns. All of them, as well as [NL], are control strings inside texts."""

    begin: str = "<s>"
    end: str = "</s>"
    ask: str = "[INST]"
    asked: str = "[/INST]"
    trainable: str = "assistant"

    def escape(self, text: Column) -> Column:
        doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for s in (self.begin, self.end, self.ask, self.asked, "[NL]"):
            doubled = F.replace(doubled, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}"))
        return doubled

    def unescape(self, text: Column) -> Column:
        for s in (self.begin, self.end, self.ask, self.asked, "[NL]"):
            text = F.replace(text, F.lit(f"{s[0]}\\{s[1:]}"), F.lit(s))
        return F.replace(text, F.lit("\\\\"), F.lit("\\"))

    def turn(self, role: Column, text: Column) -> Column:
        other = F.concat(F.lit(f"{self.begin}{self.ask} "), F.replace(self.escape(role), F.lit("\n"), F.lit("[NL]")), F.lit("\n"), self.escape(text), F.lit(f" {self.asked}"))
        return F.when(role == self.trainable, F.concat(F.lit(self.begin), self.escape(text), F.lit(self.end))).otherwise(other)

    def parse(self, formatted: Column) -> Column:
        """Array of (role, text) of a formatted text."""
        ask, asked = f"{self.ask} ", f" {self.asked}"

        def one(part: Column) -> Column:
            inner = F.substring(part, F.lit(len(ask) + 1), F.char_length(part) - len(ask) - len(asked))
            role = F.substring_index(inner, "\n", 1)
            text = F.substring(inner, F.char_length(role) + 2, F.char_length(inner))
            other = F.struct(self.unescape(F.replace(role, F.lit("[NL]"), F.lit("\n"))).alias("role"), self.unescape(text).alias("text"))
            reply = F.struct(F.lit(self.trainable).alias("role"), self.unescape(F.substring(part, F.lit(1), F.char_length(part) - len(self.end))).alias("text"))
            return F.when(F.startswith(part, F.lit(ask)), other).otherwise(reply)

        parts = F.split(formatted, "\\Q" + self.begin + "\\E")
        return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one)


def examples(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, example, target, formatted, loss_start and loss_length (code points) of every example.

    target is the place of the trainable turn, from 1; null in a row without one.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("t"))
    made = ordered.select("conv_id", F.transform("t", lambda t: F.struct((t["role"] == template.trainable).alias("own"), template.turn(t["role"], t["text"]).alias("s"))).alias("t"))
    n = F.size("t")
    places = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("t", i)["own"])
    tail = F.when(F.element_at("t", -1)["own"], F.array().cast("array<int>")).otherwise(F.array(n + 1))
    rows = made.select("conv_id", "t", F.posexplode(F.concat(places, tail)).alias("example", "at"))
    head = F.array_join(F.transform(F.slice("t", F.lit(1), F.col("at") - 1), lambda t: t["s"]), "")
    reply = F.when(F.col("at") <= n, F.try_element_at("t", F.col("at"))["s"]).otherwise("")
    parts = rows.select("conv_id", "example", F.when(F.col("at") <= n, F.col("at")).alias("target"), head.alias("head"), reply.alias("reply"))
    marks = len(template.begin) + len(template.end)
    own = F.col("target").isNotNull()
    return parts.select(
        "conv_id",
        "example",
        "target",
        F.concat("head", "reply").alias("formatted"),
        (F.char_length("head") + F.when(own, len(template.begin)).otherwise(0)).alias("loss_start"),
        F.when(own, F.char_length("reply") - marks).otherwise(0).alias("loss_length"),
    )


def read_back(made: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turns (array of role and text) and loss (the trained texts in order) from examples alone."""
    loss = template.unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))
    known = made.select("conv_id", "example", "formatted", loss.alias("loss"))
    whole = known.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.char_length("formatted").cast("long")).alias("formatted_chars"),
    )
    return whole.select("conv_id", template.parse(F.col("whole")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
