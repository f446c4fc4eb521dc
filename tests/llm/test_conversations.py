"""Operators on conversations: brute force, round trips, and edge cases."""

import hashlib
import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldlens.llm import chats, conversation_queries, queries, repairs, tries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, formatted string, id string, depth long, turns string, rows string"


def talks(spark, rows):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "f", "i", 1, "t", "r") for r in rows], SCHEMA)


HARD = [
    (1, None, "user", "null turn"), (1, 0, None, None), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, 2, "assistant", ""), (1, 3, "assistant", "x" * 30_000),
    (2, 0, "user\nname", "\\"), (2, 1, "<turn>", "<turn></turn>\n<part/><line/>\\<"), (2, 2, "assistant", "\\\\<\\part/><part/"), (2, 3, "assistant", "<"), (2, 4, "assistant", "</turn>\n😀é"),
    (None, 0, "assistant", "no id"), (3, 0, "", " \n\t"), (4, 5, "system", "s"),
]


@pytest.mark.parametrize("name", sorted(conversation_queries.QUERIES))
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_equals_sql(spark, name, sf):
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    rows = lambda df: Counter(tuple(None if pd.isna(v) else v for v in r) for r in df[sorted(df)].astype(object).itertuples(index=False))
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(c.sql(queries.ORACLES[name]).df())


def test_op11_round_trip(spark):
    """Control strings, backslashes and newlines in roles and texts come back; merged turns come apart; spans hold the texts."""
    got = {r.conv_id: r for r in chats.read_chats(chats.format_chats(talks(spark, HARD))).collect()}
    by = defaultdict(list)
    for c, turn, role, text in HARD:
        by[c].append(((turn is not None, turn or 0), role or "", text or ""))
    assert got.keys() == by.keys()
    for c, rows in by.items():
        rows = [(role, text) for _, role, text in sorted(rows)]
        r = got[c]
        assert [(t.role, t.text) for t in r.turns] == rows
        assert r.loss_texts == [t for role, t in rows if role == "assistant"]
        assert r.n_runs == len(list(itertools.groupby(rows, lambda x: x[0])))
        assert r.formatted.count("<turn>") == r.n_runs and all(a.end <= b.start for a, b in itertools.pairwise(r.loss_spans))


def test_op11_other_templates(spark):
    one = chats.Template("<|im_start|>", "<|im_end|>\n", "<|and|>", "<|line|>", loss=("assistant", "tool"))
    rows = [(1, 0, "user", "say <|im_end|>\n"), (1, 1, "assistant", "<|im_start|>"), (1, 2, "tool", "5")]
    r = chats.read_chats(chats.format_chats(talks(spark, rows), one), one).first()
    assert r.formatted == "<|im_start|>user\nsay <\\|im_end|>\n<|im_end|>\n<|im_start|>assistant\n<\\|im_start|><|im_end|>\n<|im_start|>tool\n5<|im_end|>\n"
    assert [t.text for t in r.turns] == [x[3] for x in rows] and r.loss_texts == ["<|im_start|>", "5"]
    for bad in (chats.Template(opening="<"), chats.Template(closing="<a<b>"), chats.Template(part="<turn>"), chats.Template(line="<\\n>")):
        with pytest.raises(ValueError):
            chats.format_chats(talks(spark, rows), bad)


def test_op11_long_and_empty(spark):
    """A conversation of more turns than are summed at once, no rows, and an id column that clashes."""
    rows = [(1, k, "assistant" if k % 3 else "user", f"{k} é <turn>" * (k % 5)) for k in range(1500)]
    r = chats.read_chats(chats.format_chats(talks(spark, rows))).first()
    assert [t.text for t in r.turns] == [x[3] for x in rows] and r.loss_texts == [x[3] for x in rows if x[2] == "assistant"]
    assert chats.format_chats(talks(spark, [])).count() == 0
    assert chats.format_chats(talks(spark, rows[:2]), id_col="formatted").columns == ["formatted_in", "formatted", "loss_spans", "n_runs"]


def trie(seqs):
    """The nodes' rows by definition. seqs: id -> list of (role, text)."""
    members = defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].add(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        return [p, *itertools.chain.from_iterable(below(k) for k in kids[p])]

    words = lambda t: len([w for w in t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w])
    out = Counter()
    for p, m in members.items():
        sub = below(p)
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        out[
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in sub),
            sum((len(members[q]) - 1) * words(q[-1][1]) for q in sub if q), hashlib.sha256(ends.encode()).hexdigest(),
        ] += 1
    return out


@pytest.mark.parametrize("block", [2, 3, 7, 1000])
def test_op12_brute_force(spark, block):
    """Random tries with many repeats, empty sequences and prefixes of others, over several levels of blocks."""
    rng = random.Random(block)
    pool = [("user", "a b"), ("user", "a  b"), ("assistant", ""), ("assistant", "x\ty z"), (None, None)]
    seqs = {rng.randrange(-(10**6), 10**12): [rng.choice(pool[: rng.choice([1, 2, 5])]) for _ in range(rng.choice([1, 2, 2, 3, 6]))] for _ in range(120)}
    seqs |= {5_000_000_000 + k: [pool[0], pool[2]] for k in range(40)}
    rows = [(c, k, *t) for c, s in seqs.items() for k, t in enumerate(s)]
    s = tries.turn_sequences(talks(spark, rows))
    empty = spark.createDataFrame([(77, [], []), (78, [], [])], s.schema)
    got = tries.prefix_trie(s.unionByName(empty).repartition(5), block=block).collect()
    want = trie({c: [(r or "", t or "") for r, t in s] for c, s in seqs.items()} | {77: [], 78: []})
    assert Counter(tuple(r) for r in got) == want


def test_op12_edges(spark):
    assert tries.prefix_trie(tries.turn_sequences(talks(spark, []))).count() == 0
    none = spark.createDataFrame([(3, [], [])], "id long, keys array<binary>, words array<long>")
    assert [tuple(r)[:7] for r in tries.prefix_trie(none).collect()] == [(3, 0, None, 1, 0, 1, 0)]
    rows = [(None, 0, "user", "no id"), (20, 0, "user", "a"), (20, None, "user", "first"), (20, 0, "user", "a")]
    got = tries.prefix_trie(tries.turn_sequences(talks(spark, rows))).collect()
    assert sorted((r.conv_id, r.depth, r.n_convs) for r in got) == [(20, d, 1) for d in range(4)]
    long = [(c, k, "user", str(k)) for c in (1, 2) for k in range(3000)] + [(3, k, "user", str(k)) for k in range(1500)]
    got = tries.prefix_trie(tries.turn_sequences(talks(spark, long)), block=2).collect()
    assert len(got) == 3001 and {r.depth: r.n_convs for r in got} == {d: 3 if d <= 1500 else 2 for d in range(3001)} and all(r.n_leaves == 1 for r in got)


def test_op12_grafts(spark):
    rows = [(c, k, "user", f"{c}-{k}") for c in (20, 21, 22, 23, 24, 25, 41, 42, 43) for k in range(c % 5 + 1)]
    own = defaultdict(list)
    for c, _, role, text in rows:
        own[c].append((role, text))
    cut = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    want = trie({c: own.get(c - c % 20, [])[: cut[c]] + own[c][cut[c] :] for c in own})
    assert Counter(tuple(r) for r in tries.prefix_trie(tries.grafted(tries.turn_sequences(talks(spark, rows)))).collect()) == want


def cheapest_edits(rows):
    """(cost, audit) by trying, from the end, all edits at each row and state."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    after = {0: (0, ""), 3: (0, ""), 1: None, 2: None}
    inserts = lambda at: {q: min([x for x in [at[q], *((at[to][0] + 3, "I" + at[to][1]) for (p, r), to in step.items() if p == q and r != "s" and at[to])] if x], default=None) for q in at}
    settle = lambda at: inserts(inserts(inserts(at)))
    now = settle(after)
    for role, fault in reversed(rows):
        here = {}
        for q in range(4):
            found = [(now[q][0] + 4, "D" + now[q][1])] if now[q] else []
            if fault != "b":
                more = 3 if fault == "t" else 0
                found += [(now[to][0] + more, "K" + now[to][1]) for (p, r), to in step.items() if p == q and r == role and now[to]]
                found += [(now[to][0] + more + 3, "R" + now[to][1]) for (p, r), to in step.items() if p == q and r != "s" and now[to]]
            here[q] = min(found, default=None)
        now = settle(here)
    return now[0]


def test_op13_all_short_conversations():
    kinds = [(r, f) for r in "suax" for f in "kbt"]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert repairs.cheapest("".join(r + f for r, f in rows)) == cheapest_edits(rows), rows
    rng = random.Random(1)
    for n in [5, 8, 13, 40] * 60:
        rows = [(rng.choice("ssuuuaaax"), rng.choice("kkkkbt")) for _ in range(n)]
        assert repairs.cheapest("".join(r + f for r, f in rows)) == cheapest_edits(rows), rows


def test_op13_long_conversation_is_quick():
    rng = random.Random(2)
    rows = [(rng.choice("ua"), rng.choice("kkt")) for _ in range(20_000)]
    cost, audit = repairs.cheapest("".join(r + f for r, f in rows))
    assert len(audit.replace("I", "")) == 20_000 and cost > 0


def test_op13_edges(spark):
    rows = [
        (1, None, "user", "Hi."), (1, 0, "assistant", None), (1, 1, "assistant", "Yes!"), (1, 1, "assistant", "Yes!"), (1, 4, "user", "And"), (2, 0, "", "x."), (2, 1, "tool", "\t\n"),
        (3, None, "user", "a."), (None, 3, "system", "z" * 40_000 + ". \x0b"), (5, 0, "user", "q?"),
    ]
    got = {r.conv_id: r for r in repairs.repair(talks(spark, rows)).collect()}
    assert tuple(got[1])[1:8] == (2, 1, 1, 1, 2, 12, "KDKDD")
    assert [(t.role, t.text) for t in got[1].repaired] == [("user", "Hi."), ("assistant", "Yes!")]
    assert (got[2].blank, got[2].audit, got[2].repaired, got[3].gaps, got[3].audit) == (1, "DD", [], 0, "KI")
    assert (got[None].audit, got[None].truncated, got[5].audit) == ("D", 0, "KI") and [tuple(t) for t in got[5].repaired] == [("user", "q?"), ("assistant", "")]
    gone = repairs.repair(talks(spark, rows), there=F.lit(False)).collect()
    assert len(gone) == 5 and all((r.cost, r.audit, r.repaired, r.gaps, r.illegal) == (0, "", [], 0, 0) for r in gone)
    assert repairs.repair(talks(spark, [])).count() == 0
    assert repairs.repair(talks(spark, rows), id_col="rows").columns[0] == "rows"


def test_queries_are_registered():
    import __spark_entry__ as e

    assert {f"op{k}" for k in range(1, 14)} == {n.split("_")[0] for n in e.queries() if n.startswith("op") and n[2].isdigit()}
    assert os.path.isdir(SF)
