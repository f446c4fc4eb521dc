"""Repair of a conversation's structure: the cheapest edits, found from both ends of the lattice of rows and roles."""

from __future__ import annotations

from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import carried

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: Where a role's initial leads: nothing yet, after the system's turn, after a user's, after an assistant's.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
RESULTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")
#: The blanks of ``[\x20\x09-\x0D]``.
BLANK = " \t\n\x0b\x0c\r"
_INSERTS = [(q, to, "I", INSERT) for q, step in enumerate(STEPS) for r, to in step.items() if r in ROLES]


@lru_cache(maxsize=64)
def _moves(row: str) -> list[tuple[int, int, str, int]]:
    """(state, next state, letter, cost) of what can be done with a row of a role's initial and a fault: ``b`` has to be
    deleted, ``t`` is cut short."""
    out = [(q, q, "D", DELETE) for q in range(4)]
    if row[1] == "b":
        return out
    more = CUT_SHORT if row[1] == "t" else 0
    for q, step in enumerate(STEPS):
        out += [(q, step[row[0]], "K", KEEP + more)] if row[0] in step else []
        out += [(q, to, "R", REROLE + more) for r, to in step.items() if r in ROLES]
    return out


@lru_cache(maxsize=64)
def _from(row: str, back: bool) -> list[list[tuple[int, str, int]]]:
    """_moves by the state that they leave, or, seen backwards, by the one they reach."""
    out: list[list[tuple[int, str, int]]] = [[] for _ in range(4)]
    for a, b, letter, cost in _INSERTS if row == "+" else _moves(row):
        out[b if back else a].append((a if back else b, letter, cost))
    return out


def _sooner(a, b) -> bool:
    """Whether the audit a, a chain of (letter, what is before, length), is ASCII-less than b; both lead to one place."""
    x, y = [], []
    while a is not b:
        if b is None or (a is not None and a[2] >= b[2]):
            x.append(a[0])
            a = a[1]
        else:
            y.append(b[0])
            b = b[1]
    return x[::-1] < y[::-1]


def _sooner_on(a, b) -> bool:
    """The same for chains of (letter, what follows, length)."""
    while a is not b:
        if a is None or b is None or a[0] != b[0]:
            return a is None or (b is not None and a[0] < b[0])
        a, b = a[1], b[1]
    return False


def _letters(chain) -> list[str]:
    out = []
    while chain is not None:
        out.append(chain[0])
        chain = chain[1]
    return out


@lru_cache(maxsize=1 << 14)
def cheapest(rows: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a conversation, ties ASCII-least; rows has two letters for each (see _moves).

    Dijkstra's search from both ends. A place is (rows passed, state). Each side takes its place of least cost next; of equal
    ones that with fewer rows before it on its side, for an edit of no cost always passes a row: so a place's audit is final
    when it is taken. Once a crossing is known, both go on until no equal one can be left, and the least audit wins.

    Of two audits of one cost that lead to one place, none is the other's beginning: letters fix the states. So the lesser
    stays the lesser whatever follows, and each place keeps one of them.
    """
    n = len(rows) // 2
    row = [rows[2 * i : 2 * i + 2] for i in range(n)]
    labels = ({(0, 0): (0, None)}, {(n, q): (0, None) for q in ENDS})
    heaps: tuple[list, list] = ([(0, 0, 0)], [(0, -n, q) for q in ENDS])
    taken: tuple[set, set] = (set(), set())
    best = None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = int(heaps[1][0][0] < heaps[0][0][0])
        cost, i, q = heappop(heaps[side])
        i = abs(i)
        if (i, q) in taken[side]:
            continue
        taken[side].add((i, q))
        own, other, sign = labels[side], labels[1 - side], -1 if side else 1
        chain, less = own[i, q][1], _sooner_on if side else _sooner
        length = chain[2] + 1 if chain else 1
        nexts = [(i, x) for x in _from("+", bool(side))[q]]
        if (i > 0) if side else (i < n):
            nexts += [(i + sign, x) for x in _from(row[i - 1 if side else i], bool(side))[q]]
        for j, (to, letter, more) in nexts:
            place, new = (j, to), (letter, chain, length)
            had = own.get(place)
            if had is None or cost + more < had[0] or (cost + more == had[0] and less(new, had[1])):
                own[place] = (cost + more, new)
                if had is None or cost + more < had[0]:
                    heappush(heaps[side], (cost + more, sign * j, to))
            if place in other:
                met = own[place][0] + other[place][0]
                best = met if best is None else min(best, met)
        if (i, q) in other:
            met = own[i, q][0] + other[i, q][0]
            best = met if best is None else min(best, met)
    crossings = [p for p in labels[0].keys() & labels[1].keys() if labels[0][p][0] + labels[1][p][0] == best]
    return best, min("".join(_letters(labels[0][p][1])[::-1] + _letters(labels[1][p][1])) for p in crossings)


def plan(rows: str, audit: str) -> tuple[list[int | None], list[str | None]]:
    """For each turn of the repaired conversation the row that it comes from (None: inserted), and its new role (None: its own)."""
    at, q, sources, roles = 0, 0, [], []
    for letter in audit:
        if letter in "IR":
            role = next(r for r in STEPS[q] if r in ROLES)
            roles.append(ROLES[role])
        elif letter == "K":
            role = rows[2 * at]
            roles.append(None)
        if letter != "D":
            sources.append(None if letter == "I" else at)
            q = STEPS[q][role]
        at += letter != "I"
    return sources, roles


def _repaired(rows: pd.Series) -> pd.DataFrame:
    found = [(*cheapest(r), r) for r in rows]
    return pd.DataFrame([(cost, audit, *plan(r, audit)) for cost, audit, r in found], columns=["cost", "audit", "sources", "roles"])


def repair(
    df: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", there: Column | None = None,
) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of each conversation.

    Rows go by turn, null first; ties by role and text. Null roles and texts count as one space. A row's first fault counts:
    blank (its text has blanks only), duplicate (its role and text came before), truncated (its text doesn't end with one of
    ``.!?``, blanks aside). gaps are the turns that miss between the least and the greatest, illegal the neighbours whose
    roles' initials aren't su, ua or au. repaired is an array of role and text, cost and audit those of its edits: Keep,
    Rerole to user or assistant, Delete (what blank and duplicate rows need) and Insert, so that the initials are an
    optional s and then pairs ua, or nothing. A role is known by its first letter; an empty one isn't any.

    Rows for which there is false only name their conversation; one with no other rows needs no edits. Rows without an id
    are one conversation. No rows give no rows. Other columns don't go along; an id column named like a result column gets
    ``_in`` behind its name. A conversation has to fit into a row; the search sees two letters of each turn, and no text.
    """
    (_, name), = carried([id_col], RESULTS)
    real = F.coalesce(there, F.lit(False)) if there is not None else F.lit(True)
    rows = df.select(
        F.col(id_col).alias("__id"), real.alias("real"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"),
    ).repartition("__id")
    again = F.row_number().over(Window.partitionBy("__id", "real", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    trimmed = F.rtrim("text", F.lit(BLANK))
    fault = F.when(trimmed == "", "blank").when(F.col("again"), "duplicate").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    turn = F.when(F.col("real"), F.struct("turn", "role", "text", "again", fault.alias("fault")))
    convs = rows.withColumn("again", again).groupBy("__id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))  # null, what isn't there, isn't collected

    initial = lambda t: F.when(F.substring(t["role"], 1, 1).isin("s", "u", "a"), F.substring(t["role"], 1, 1)).otherwise(F.lit("x"))
    code = lambda t: F.concat(initial(t), F.when(t["fault"].isin("blank", "duplicate"), "b").when(t["fault"] == "truncated", "t").otherwise("k"))
    coded = convs.withColumn("rows", F.array_join(F.transform("turns", code), "")).withColumn("r", F.pandas_udf(_repaired, "cost long, audit string, sources array<int>, roles array<string>")("rows"))
    numbers = F.filter(F.transform("turns", lambda t: t["turn"]), lambda x: x.isNotNull())
    n = lambda f: F.size(F.filter("turns", lambda t: t["fault"] == f)).cast("long").alias(f)
    pair = lambda i: F.concat(F.substring(F.get("turns", i - 1)["role"], 1, 1), F.substring(F.get("turns", i)["role"], 1, 1))
    illegal = F.when(F.size("turns") > 1, F.size(F.filter(F.sequence(F.lit(1), F.size("turns") - 1), lambda i: ~pair(i).isin("su", "ua", "au")))).otherwise(0)
    source = lambda s: F.get("turns", s)
    repaired = F.zip_with(
        "r.sources", "r.roles",
        lambda s, r: F.struct(F.coalesce(r, source(s)["role"]).alias("role"), F.coalesce(source(s)["text"], F.lit("")).alias("text")),
    )
    gaps = F.coalesce(F.array_max("numbers") - F.array_min("numbers") + 1 - F.size(F.array_distinct("numbers")), F.lit(0)).cast("long")
    return coded.withColumn("numbers", numbers).select(
        F.col("__id").alias(name), gaps.alias("gaps"), n("blank"), n("duplicate"), n("truncated"), illegal.cast("long").alias("illegal"),
        F.col("r.cost").alias("cost"), F.col("r.audit").alias("audit"), repaired.alias("repaired"),
    )
