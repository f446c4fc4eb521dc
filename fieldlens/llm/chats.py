"""Chat formatting by Spark expressions: turns to one text with a loss mask, and back."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import carried

#: Elements of an array that are handled at once where a step's cost grows with the square of their number.
BLOCK = 256
RESULTS = ("formatted", "loss_spans", "n_runs")


class Template(NamedTuple):
    """The control strings. A turn is ``opening role newline text closing``; turns of one role in a row share the first and
    the last, with part between their texts. line stands for a newline inside a role.

    A control string has two characters or more and no backslash, and its first character stands in none of them again. So
    a text never makes one together with what follows it.
    """

    opening: str = "<turn>"
    closing: str = "</turn>\n"
    part: str = "<part/>"
    line: str = "<line/>"
    loss: tuple[str, ...] = ("assistant",)

    @property
    def marks(self) -> tuple[str, ...]:
        return self.opening, self.closing, self.part, self.line

    def checked(self) -> Template:
        firsts = {m[:1] for m in self.marks}
        if any(len(m) < 2 or "\\" in m or firsts & set(m[1:]) for m in self.marks) or len(set(self.marks)) < 4:
            raise ValueError(f"control strings can't be told from texts: {self.marks}")
        return self

    def escaped(self, text: Column) -> Column:
        """A backslash before each backslash, and one after the first character of each control string."""
        inside = "|".join(f"(?<={re.escape(m[0])})(?={_quoted(m[1:])})" for m in self.marks)
        return F.regexp_replace(text, rf"\\|{inside}", r"\\$0")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _quoted(mark: str) -> str:
    return rf"\Q{mark}\E"


def running_sums(name: str) -> Column:
    """The sums up to and with each element of an array column of longs, whose name is given.

    Sums of blocks come first and then those inside each block, so the cost is the length times the block's.
    """
    block = lambda b: F.slice(F.col(name), b * BLOCK + 1, F.lit(BLOCK))
    add = lambda s, x: s + x
    blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(name) - 1) / BLOCK).cast("int"), F.lit(0)))
    grow = lambda b: F.aggregate(
        block(b), F.array(F.aggregate(F.slice(F.col(name), F.lit(1), b * BLOCK), F.lit(0).cast("long"), add)),
        lambda s, x: F.array_append(s, F.element_at(s, -1) + x), lambda s: F.slice(s, F.lit(2), F.size(s) - 1),
    )
    return F.flatten(F.transform(blocks, grow))


def under_mask(text: str, spans: str) -> Column:
    """The pieces of a text column under spans (start, end), which don't overlap and rise; both columns by name.

    The text is cut for each block of spans first, so that places aren't counted from the text's start for each of them.
    """
    size = lambda s: s["end"] - s["start"]
    blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(spans) - 1) / BLOCK).cast("int"), F.lit(0)))
    held = F.transform(blocks, lambda b: F.slice(F.col(spans), b * BLOCK + 1, F.lit(BLOCK)))
    cut = F.transform(
        F.filter(held, lambda s: F.size(s) > 0),
        lambda s: F.struct(s.alias("s"), F.col(text).substr(s[0]["start"] + 1, F.element_at(s, -1)["end"] - s[0]["start"]).alias("t"), s[0]["start"].alias("at")),
    )
    return F.flatten(F.transform(cut, lambda c: F.transform(c["s"], lambda s: c["t"].substr(s["start"] - c["at"] + 1, size(s)))))


def format_chats(
    df: DataFrame, template: Template | None = None, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(id, formatted, loss_spans, n_runs) of each conversation: its text, the spans of it (code points) whose loss counts,
    one for each text of a role that the template trains, and how many turns it has once those of one role are merged.

    Rows go by turn, null first; ties by role and text, so repeated rows all stay. Null roles and texts count as empty, and
    so do rows without an id as one conversation. Empty texts have empty spans. No rows give no rows. Other columns don't
    go along; an id column named like a result column gets ``_in`` behind its name. A conversation has to fit into a row.

    Turns of a conversation are collected and sorted; those of one role in a row become one; all is then concatenated.
    """
    t = (template or Template()).checked()
    (_, name), = carried([id_col], RESULTS)
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = df.groupBy(F.col(id_col).alias("__id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    at = lambda i: F.get("turns", i)
    begins = rows.withColumn("begins", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (at(i)["role"] != at(i - 1)["role"])))
    ends = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(F.size("turns")))
    merged = F.zip_with("begins", ends, lambda a, b: F.struct(at(a)["role"].alias("role"), F.transform(F.slice("turns", a + 1, b - a), lambda x: x["text"]).alias("texts")))

    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    mark = lambda s: piece(s, F.lit(False))

    def turn_pieces(m: Column) -> Column:
        header = F.concat(F.lit(t.opening), F.replace(t.escaped(m["role"]), F.lit("\n"), F.lit(t.line)), F.lit("\n"))
        texts = F.transform(m["texts"], lambda x, k: F.array(mark(F.when(k == 0, header).otherwise(F.lit(t.part))), piece(t.escaped(x), m["role"].isin(*t.loss))))
        return F.concat(F.flatten(texts), F.array(mark(F.lit(t.closing))))

    pieces = begins.withColumn("pieces", F.flatten(F.transform(merged, turn_pieces)))
    sized = pieces.withColumn("sizes", F.transform("pieces", lambda p: F.length(p["s"]).cast("long")))
    span = lambda p, e: F.when(p["loss"], F.struct((e - F.length(p["s"])).alias("start"), e.alias("end")))
    return sized.select(
        F.col("__id").alias(name), F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        F.filter(F.zip_with("pieces", running_sums("sizes"), span), lambda s: s.isNotNull()).alias("loss_spans"), F.size("begins").cast("long").alias("n_runs"),
    )


def read_chats(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """formatted with turns (an array of role and text, merged turns apart again) and loss_texts, the texts under the spans;
    both are read from the formatted text, unescaped. Columns of these names are replaced."""
    t = (template or Template()).checked()
    blocks = F.split("formatted", _quoted(t.closing), -1)

    def turns_of(block: Column) -> Column:
        role = F.substring_index(F.substr(block, F.lit(len(t.opening) + 1)), "\n", 1)
        body = F.substr(block, F.length(role) + len(t.opening) + 2)
        own = t.unescaped(F.replace(role, F.lit(t.line), F.lit("\n")))
        return F.transform(F.split(body, _quoted(t.part), -1), lambda x: F.struct(own.alias("role"), t.unescaped(x).alias("text")))

    turns = F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turns_of))
    texts = F.transform(under_mask("formatted", "loss_spans"), t.unescaped)
    return formatted.withColumns({"turns": turns, "loss_texts": texts})
