"""Prefix trie of conversations: range minima over the prefixes that neighbours in sorted order share, by sparse tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut
from .textkit import WORD

#: Neighbours whose sparse table is one task's at a time.
BLOCK = 2048
NOTHING = np.iinfo(np.int64).max
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

RANKED = "pid int, pos long, id long, turns long, low long, after long, shared long, words array<long>, border array<binary>"
PART = "n long, depth long, first long, last long, least long, leaves long, shared long, kids long, own long, turns long, before long, low long, ends string, chunk string"
ASK = "n long, depth long, left boolean, home long, at long"
ANSWER = "n long, depth long, left boolean, edge long, least long, leaves long, shared long, kids long, home long"


def turn_sequences(df: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, keys, words) of each conversation: its turns in order, null turns first and ties by key; a turn's key is the
    SHA-256 of its role and text, and its words are those of its text. Null roles and texts count as empty; rows without an
    id belong to no conversation. Texts aren't shuffled."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turn = F.struct(F.col(turn_col).alias("turn"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return rows.select("id", F.transform("t", lambda t: t["key"]).alias("keys"), F.transform("t", lambda t: t["words"]).alias("words"))


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range, numbered, each with how many turns it shares with the row before; a last row has the border."""
    pid, pos, last, schema = TaskContext.get().partitionId(), 0, None, None
    for b in batches:
        ids, keys, words = b["id"].to_pylist(), b["keys"].to_pylist(), b["words"].to_pylist()
        out = []
        for i, k, w in zip(ids, keys, words, strict=True):
            low = 0
            if last is not None:
                most = min(len(k), len(last))
                while low < most and k[low] == last[low]:
                    low += 1
            out.append((pid, pos, i, len(k), low, int(last is not None and low < len(last)), sum(w[:low]), w, k if last is None else None))
            last, pos = k, pos + 1
        schema = schema or _arrow(RANKED)
        yield _batch(out, schema)
    if last is not None:
        yield _batch([(pid, pos, None, len(last), None, None, None, None, last)], schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _ranked(sequences: DataFrame) -> DataFrame:
    """(n, id, turns, low, after, shared, words) of all conversations in sorted order, numbered from 0: low is the number of
    turns shared with the one before (-1 for the first), after is 1 if the one before goes on otherwise or ends elsewhere (it
    is a leaf), shared the words of the turns shared. Repeated sequences lie in order of ids, over as many ranges as they fill."""
    got = cut(sequences.repartitionByRange("keys", "id").sortWithinPartitions("keys", "id").mapInArrow(_rank, RANKED), "trie-ranked")
    stops = got.filter("id is null").select("pid", F.col("pos").alias("rows"), F.col("border").alias("last"))
    starts = got.filter("id is not null and pos = 0").select("pid", F.col("border").alias("first"))
    over = Window.orderBy("pid")  # a row for each task that had rows
    ends = stops.join(starts, "pid").select(
        "pid", "first", F.coalesce(F.sum("rows").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.lag("last").over(over).alias("last"),
    )
    both = F.least(F.size("first"), F.size("last"))
    differ = F.filter(F.sequence(F.lit(1), both), lambda i: F.get("first", i - 1) != F.get("last", i - 1))
    low = F.when(F.col("last").isNull(), -1).when(both == 0, 0).otherwise(F.coalesce(F.array_min(differ) - 1, both))
    borders = cut(ends.select(F.col("pid").alias("__pid"), "offset", low.cast("long").alias("__low"), F.size("last").cast("long").alias("__turns")), "trie-borders")
    at, first = got.filter("id is not null").join(F.broadcast(borders), F.col("pid") == F.col("__pid")), F.col("pos") == 0
    inner = F.when(F.col("__low") > 0, F.aggregate(F.slice("words", F.lit(1), F.greatest(F.col("__low"), F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(0)
    return at.select(
        (F.col("offset") + F.col("pos")).alias("n"), "id", "turns", F.when(first, F.col("__low")).otherwise(F.col("low")).alias("low"),
        F.when(first, (F.col("__low") >= 0) & (F.col("__low") < F.col("__turns"))).otherwise(F.col("after") == 1).cast("long").alias("after"),
        F.when(first, inner).otherwise(F.col("shared")).cast("long").alias("shared"), "words",
    )


def _sparse(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all stretches of 1, 2, 4 ... values."""
    out = [values]
    while 2 << (len(out) - 1) <= len(values):
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


class _Stretch:
    """The items of a block, and what lies between a place of it and the next or last item whose low is less than a depth."""

    def __init__(self, low: np.ndarray, kids: np.ndarray, least: np.ndarray, leaves: np.ndarray, shared: np.ndarray) -> None:
        self.size, self.lows, self.ids = len(low), _sparse(low), _sparse(least)
        self.sums = [np.r_[0, np.cumsum(x)] for x in (leaves, shared)]
        order = np.lexsort((np.arange(self.size), low))
        self.keys, self.kid_sums = self._key(low[order], order), np.r_[0, np.cumsum(kids[order])]

    def _key(self, low: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (low + 1) * (self.size + 1) + at

    def right(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, ...]:
        """The first item after at (-1 to size - 1) whose low is less than depth, size if there is none, and what lies between."""
        to = at + 1
        for k in reversed(range(len(self.lows))):
            t = self.lows[k]
            ok = (to + (1 << k) <= self.size) & (t[np.minimum(to, len(t) - 1)] >= depth)
            to = to + np.where(ok, 1 << k, 0)
        return to, *self._between(at + 1, to, depth)

    def left(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, ...]:
        """The last item up to at whose low is less than depth, -1 if there is none, and what lies between, at included."""
        to = at + 1  # all from here to at have depth
        for k in reversed(range(len(self.lows))):
            t = self.lows[k]
            ok = (to >= 1 << k) & (t[np.maximum(to - (1 << k), 0)] >= depth)
            to = to - np.where(ok, 1 << k, 0)
        return to - 1, *self._between(to, at + 1, depth)

    def _between(self, a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, ...]:
        power = np.frexp(np.maximum(b - a, 1))[1] - 1
        least = np.full(len(a), NOTHING)
        for k in np.unique(power[b > a]).tolist():
            rows = np.flatnonzero((power == k) & (b > a))
            least[rows] = np.minimum(self.ids[k][a[rows]], self.ids[k][b[rows] - (1 << k)])
        kids = self.kid_sums[np.searchsorted(self.keys, self._key(depth, b))] - self.kid_sums[np.searchsorted(self.keys, self._key(depth, a))]
        return least, *(s[b] - s[a] for s in self.sums), kids


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t[name].to_numpy().astype(np.int64)


def _first_level(block: int):
    """For a block of neighbours: a row for each prefix that begins at one of them, and for the prefix that it shares with
    the one before, with the extents that lie within the block; and the ids of repeated sequences that reach over its ends."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        n, ids, turns, low, after, shared = (_column(table, c) for c in ("n", "id", "turns", "low", "after", "shared"))
        listed = table["words"].combine_chunks()
        words, offsets = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64), listed.offsets.to_numpy().astype(np.int64)
        total, starts = np.r_[0, np.cumsum(words)], offsets[:-1] - offsets[0]
        s = _Stretch(low, (turns > low).astype(np.int64), ids, after, shared)
        from_ = np.maximum(low, 0)
        counts = turns - from_ + 1
        at = np.repeat(np.arange(len(n)), counts)
        depth = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) + from_[at]
        edge, least, leaves, sum_shared, kids = s.right(at, depth)
        probe = np.flatnonzero(depth == low[at])
        first, left_least = at.copy(), np.full(len(at), NOTHING)
        first[probe], got, *_ = s.left(at[probe], depth[probe])
        left_least[probe] = np.minimum(got, np.where(first[probe] >= 0, ids[np.maximum(first[probe], 0)], NOTHING))
        least = np.minimum(np.minimum(least, ids[at]), left_least)
        before = total[starts[at] + np.maximum(depth - 1, 0)] - total[starts[at]]

        ends, base = [None] * len(at), int(n[0])
        run_starts = np.flatnonzero(~((low == turns) & (after == 0)) | (np.arange(len(n)) == 0) | (low < 0))
        place = np.cumsum(counts) - 1  # a conversation's row of full depth
        chunks = []
        for a, b in zip(run_starts.tolist(), [*run_starts[1:].tolist(), len(n)], strict=True):
            text = ",".join(map(str, ids[a:b].tolist()))
            if b == len(n) or (a == 0 and low[0] == turns[0] and after[0] == 0):
                chunks.append((base + a, int(turns[a]), int(low[a] == turns[a] and after[a] == 0), text))
            else:
                ends[place[a]] = hashlib.sha256(text.encode()).hexdigest()
        null = lambda values, mask: pa.array(values, pa.int64(), mask=mask)
        node = pa.table([
            n[at], depth, null(n[0] + first, first < 0), null(n[0] + edge - 1, edge == s.size), least, leaves, sum_shared, kids,
            ids[at], turns[at], before, low[at], pa.array(ends, pa.string()), pa.nulls(len(at), pa.string()),
        ], schema=_arrow(PART))
        more = [(a, d, go_on, None, None, None, None, None, None, None, None, None, None, text) for a, d, go_on, text in chunks]
        return pa.concat_tables([node, pa.Table.from_batches([_batch(more, _arrow(PART))])])

    return run


def _further(block: int):
    """Answers asks from the items of one block: (edge or null, what lies between) for each."""

    def run(items: pa.Table, asks: pa.Table) -> pa.Table:
        if not len(items) or not len(asks):
            return _arrow(ANSWER).empty_table()
        items = items.sort_by("n")
        base = int(items["n"][0].as_py())
        s = _Stretch(*(_column(items, c) for c in ("low", "kids", "least", "leaves", "shared")))
        out = []
        for left in (False, True):
            some = asks.filter(pa.compute.equal(asks["left"], left))
            if len(some):
                at, depth = _column(some, "at") - base, _column(some, "depth")
                edge, *between = s.left(at, depth) if left else s.right(at, depth)
                none = edge < 0 if left else edge == s.size
                out.append(pa.table([some["n"], some["depth"], some["left"], pa.array(base + edge, pa.int64(), mask=none), *between, some["home"]], schema=_arrow(ANSWER)))
        return pa.concat_tables(out)

    return run


def _answers(items: DataFrame, asks: DataFrame, block: int) -> DataFrame:
    by = items.select("n", "low", "kids", "least", "leaves", "shared").groupBy(F.floor(F.col("n") / block).alias("home"))
    return cut(by.cogroup(asks.groupBy("home")).applyInArrow(_further(block), ANSWER), "trie-answers")


def _summed(items: DataFrame, block: int) -> DataFrame:
    """An item for each block of items; kids are those at the least low, which is all that a stretch over a whole block can need."""
    by_low = items.groupBy(F.floor(F.col("n") / block).alias("n"), "low").agg(*(F.sum(c).alias(c) for c in ("kids", "leaves", "shared")), F.min("least").alias("least"))
    return by_low.groupBy("n").agg(F.min("low").alias("low0"), F.min_by("kids", "low").alias("kids"), *(F.sum(c).alias(c) for c in ("leaves", "shared")), F.min("least").alias("least")).withColumnRenamed("low0", "low")


def _climb(items: DataFrame, count: int, open_: DataFrame, block: int) -> DataFrame:
    """ANSWERs of asks that leave their block: what whole blocks lie between, from a table of blocks (in turn by blocks of
    these, and so on), and the rest in the block where the edge is. Several rows an ask; the one with the edge has it."""
    blocks = cut(_summed(items, block), "trie-blocks")
    n = -(-count // block)
    up = open_.select("n", "depth", "left", F.floor((F.col("home") - F.col("left").cast("int")) / block).alias("home"), (F.col("home") - F.col("left").cast("int")).alias("at"))
    found = _answers(blocks, up, block)
    if n > block:
        beyond = found.filter("edge is null")
        if not beyond.isEmpty():
            found = found.filter("edge is not null").unionByName(beyond).unionByName(_climb(blocks, n, beyond, block))
    edges = found.filter("edge is not null")
    down = edges.select("n", "depth", "left", F.col("edge").alias("home"), (F.col("edge") * block + F.when(F.col("left"), block - 1).otherwise(-1)).alias("at"))
    last = _answers(items, down.withColumn("at", F.least("at", F.lit(count - 1))), block)
    return last.unionByName(found.withColumn("edge", F.lit(None).cast("long")))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, depth, ends): the SHA-256 of each key's chunks, comma-joined, from rows sorted by key and place."""
    schema, key, state = _arrow("n long, depth long, ends string"), None, None
    for b in batches:
        done = []
        for n, depth, chunk in zip(b["n"].to_pylist(), b["depth"].to_pylist(), b["chunk"].to_pylist(), strict=True):
            if (n, depth) == key:
                state.update(b"," + chunk.encode())
            else:
                done += [(*key, state.hexdigest())] if key else []
                key, state = (n, depth), hashlib.sha256(chunk.encode())
        yield _batch(done, schema)
    if key:
        yield _batch([(*key, state.hexdigest())], schema)


def prefix_trie(sequences: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the trie of
    sequences (id, keys, words): the distinct prefixes, from the root without a turn.

    A node's members are the conversations that begin with it; conv_id is the least of them, and the parent's is the least
    member of the prefix that is a turn shorter (null for the root). n_leaves counts the nodes without a child below it,
    itself included. saved_tokens sums, over it and what is below, the words of each node's last turn for all its members but
    one. ends_sha256 is of the ids of the members that end there, in rising order, joined by commas. Ids have to be distinct.
    Sequences may be empty or repeat; no sequences give no rows, and not even a root.

    Conversations are sorted, and each has the number of turns that it shares with the one before. A prefix is asked for at
    the first of its members, and the prefix shared with the one before at each: a binary search down a sparse table of minima
    finds how far right it reaches, another how far left. A task holds the table of a block of neighbours; what leaves its
    block goes on in a table of blocks, and so on, so no table grows with the data.

    saved_tokens of members l to r at depth d is the sum of what l + 1 to r share with the one before, in words, less (r - l)
    times the words of the first d - 1 turns; leaves are told likewise, by neighbours. A sequence that a third of the
    conversations have is spread over the sorted order: each block sends its ids as one row, and a task reads these one by
    one into the digest, which can't be taken in parts.
    """
    ranked = cut(_ranked(sequences), "trie-neighbours")
    count = ranked.count()
    home = F.floor(F.col("n") / block)
    parts = cut(ranked.groupBy(home.alias("home")).applyInArrow(_first_level(block), PART), "trie-parts")
    nodes, chunks = parts.filter("chunk is null"), parts.filter("chunk is not null")
    rows = nodes
    if count > block:
        ask = lambda left: F.struct(F.lit(left).alias("left"), home.alias("home"))
        asks = nodes.select("n", "depth", F.explode(F.array_compact(F.array(F.when(F.col("last").isNull(), ask(False)), F.when(F.col("first").isNull(), ask(True))))).alias("a")).select("n", "depth", "a.*")
        items = ranked.select("n", "low", (F.col("turns") > F.col("low")).cast("long").alias("kids"), F.col("id").alias("least"), F.col("after").alias("leaves"), "shared")
        got = _climb(items, count, asks, block)
        ids = ranked.select(F.col("n").alias("edge"), F.col("id").alias("edge_id"))
        left = got.filter(F.col("left")).join(ids, "edge", "left")
        none = F.lit(None).cast("long")
        zero = F.lit(0).cast("long")
        rows = nodes.unionByName(left.select(
            "n", "depth", F.col("edge").alias("first"), none.alias("last"), F.least("least", "edge_id").alias("least"), zero.alias("leaves"), zero.alias("shared"), zero.alias("kids"),
        ), allowMissingColumns=True).unionByName(got.filter(~F.col("left")).select(
            "n", "depth", none.alias("first"), (F.col("edge") - 1).alias("last"), "least", "leaves", "shared", "kids",
        ), allowMissingColumns=True)
    merged = cut(rows.repartition("n").groupBy("n", "depth").agg(
        *(F.max(c).alias(c) for c in ("first", "last", "own", "turns", "before", "low", "ends")), F.min("least").alias("least"), *(F.sum(c).alias(c) for c in ("leaves", "shared", "kids")),
    ).withColumn("parent", F.lag("least").over(Window.partitionBy("n").orderBy("depth"))), "trie-merged")
    last = F.coalesce("last", F.lit(count - 1))

    begun = chunks.withColumnsRenamed({"first": "goes_on"}).select("n", "depth", "goes_on", "chunk").join(merged.select("n", "depth", "first"), ["n", "depth"])
    keyed = begun.select(F.when(F.col("goes_on") == 1, F.col("first")).otherwise(F.col("n")).alias("key"), "depth", "n", "chunk")
    digests = keyed.repartition("key", "depth").sortWithinPartitions("key", "depth", "n").select(F.col("key").alias("n"), "depth", "chunk").mapInArrow(_hashed, "n long, depth long, ends string")
    own = merged.filter("depth > low").join(digests.withColumnRenamed("ends", "long_ends"), ["n", "depth"], "left")
    more = last - F.col("n")
    return own.select(
        F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), (more + 1).alias("n_convs"),
        (F.col("kids") + (F.col("turns") > F.col("depth")).cast("long")).alias("n_children"), (F.col("leaves") + 1).alias("n_leaves"),
        (F.col("shared") - more * F.col("before")).alias("saved_tokens"), F.coalesce("ends", "long_ends", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def crc32_of(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def grafted(sequences: DataFrame, *, every: int = 20, most: int = 4) -> DataFrame:
    """sequences whose first turns, 0 to most - 1 of them by the CRC-32 of the id, are those of the conversation with the last
    id before that every divides; fewer or none if it has no more or isn't there."""
    s = cut(sequences, "trie-sequences")
    base = F.col("id") - F.col("id") % every
    part = lambda c, a, b: F.slice(c, a, b)
    heads = s.filter(F.col("id") % every == 0).select(F.col("id").alias("__base"), *(part(c, F.lit(1), F.lit(most - 1)).alias(f"__{c}") for c in ("keys", "words")))
    h = (crc32_of(F.col("id")) % most).cast("int")
    on = s.join(heads, base == F.col("__base"), "left").withColumn("__h", h)
    new = lambda c, kind: F.concat(part(F.coalesce(f"__{c}", F.array().cast(kind)), F.lit(1), F.col("__h")), part(c, F.col("__h") + 1, F.size(c) + 1)).alias(c)
    return on.select("id", new("keys", "array<binary>"), new("words", "array<long>"))
