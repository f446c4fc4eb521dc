"""Benchmark decontamination with one Aho-Corasick automaton over the items' words."""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .storage import cut
from .textkit import carried

#: Bytes outside words, ``[\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are lower case, become spaces.
_PLAIN = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_built: dict = {}
RESULTS = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")


def normal_words(text: str | None) -> list[str]:
    return [w for w in text.encode().translate(_PLAIN).decode().split(" ") if w] if text else []


class Machine(NamedTuple):
    """An automaton over blocks of the items' words, each between two spaces, and a table of the items' windows.

    A block's value is its number of words, whether it is part of a longer item, and the short items that it is. Blocks don't
    overlap and are just so long that a window of width words holds a whole one wherever it begins, so the automaton is about
    as large as the items' text. An item of fewer words than a window is a block itself. windows has the first place (item,
    word) of each window by its hash, clashes those of other windows with a hash that is taken, owners the items of windows
    that more than one has.
    """

    blocks: ahocorasick.Automaton
    items: list[list[str]]
    width: int
    windows: dict[int, tuple[int, int]]
    clashes: dict[int, list[tuple[int, int]]]
    owners: dict[tuple[int, int], list[int]]

    def window(self, words: list[str]) -> tuple[int, int] | None:
        """The first place of a window of these words in the items."""
        key = _hash(words)
        place = self.windows.get(key)
        for i, k in () if place is None else (place, *self.clashes.get(key, ())):
            if self.items[i][k : k + self.width] == words:
                return i, k
        return None


def _hash(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words))


def automaton(items: list[tuple], width: int) -> Machine:
    size, words = (width + 1) // 2, [normal_words(text) for _, text in items]
    places: dict[str, tuple[bool, list[int]]] = {}
    machine = Machine(ahocorasick.Automaton(), words, width, {}, {}, {})
    for i, own in enumerate(words):
        if len(own) < width:
            if own:
                places.setdefault(f" {' '.join(own)} ", (False, []))[1].append(i)
            continue
        for k in range(0, len(own) - size + 1, size):
            block = f" {' '.join(own[k : k + size])} "
            places[block] = (True, places[block][1] if block in places else [])
        for k in range(len(own) - width + 1):
            window = own[k : k + width]
            place = machine.window(window)
            if place is None:
                key = _hash(window)
                if key in machine.windows:
                    machine.clashes.setdefault(key, []).append((i, k))
                else:
                    machine.windows[key] = (i, k)
            elif (found := machine.owners.setdefault(place, [place[0]]))[-1] != i:
                found.append(i)
    for block, value in places.items():
        machine.blocks.add_word(block, (block.count(" ") - 1, *value))
    if places:
        machine.blocks.make_automaton()
    return machine


def scan(text: str | None, machine: Machine) -> tuple[int, list[tuple[int, int]], set[int]]:
    """(words, hit ranges of word positions, positions of the items that occur).

    The text is scanned once. Where a block stands, the windows of the text that hold it are looked up, each once; the items
    of a window are taken once a text. So the time doesn't grow with the number of items that share a block.
    """
    words, width = normal_words(text), machine.width
    if not words or not len(machine.blocks):
        return len(words), [], set()
    hits = list(machine.blocks.iter(f" {' '.join(words)} "))
    if not hits:
        return len(words), [], set()
    ends = np.cumsum([len(w) + 1 for w in words])  # where the space after each word stands
    last = np.searchsorted(ends, [e for e, _ in hits]).tolist()
    ranges, owners, seen, tried = [], set(), set(), 0
    for end, (_, (n, part, whole)) in zip(last, hits, strict=True):
        if whole:
            ranges.append((end + 1 - n, end + 1))
            if (name := ("item", whole[0])) not in seen:
                seen.add(name)
                owners.update(whole)
        if part:
            for a in range(max(tried, end + 1 - width), min(end + 1 - n, len(words) - width) + 1):
                tried = a + 1
                if (place := machine.window(words[a : a + width])) is not None:
                    ranges.append((a, a + width))
                    if place not in seen:
                        seen.add(place)
                        owners.update(machine.owners.get(place, place[:1]))
    return len(words), ranges, owners


def placed(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """The stretches of words (from a to before b), joined where they touch, with where each begins and ends in the text.

    Normalising keeps every byte's place, so a word's bytes stand where they stand in the original; start and end count
    code points of the original.
    """
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    if not out:
        return []
    raw = text.encode()
    words = [m.span() for m in _WORD.finditer(raw.translate(_PLAIN))]
    points = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    return [{"a": a, "b": b, "start": int(points[words[a][0]]), "end": int(points[words[b - 1][1]])} for a, b in out]


_SPAN = "struct<a:long,b:long,start:long,end:long>"
_FOUND = "n_words long, ranges array<" + _SPAN + ">, items array<{kind}>"


def _blocks(bench: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The items in blocks of bounded text; an item larger than a block stands alone."""
    block, held = [], 0
    for row in bench.select(F.col(item_col), F.col(text_col)).toLocalIterator():
        if block and held + len(row[1] or "") > block_bytes:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += len(row[1] or "")
    if block:
        yield block


def contamination(
    df: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    width: int = 13, share: int = 20, block_bytes: int = 4 << 20, keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, keep..., n_words, n_hit, n_items, items, spans, contaminated) for each row.

    spans are the hit stretches of words: a to before b in words, start to before end in code points of the original text.
    Null and empty texts have no words and are clean; very long texts are scanned whole. Items without words have no window,
    and an empty benchmark has none. Repeated rows each get their result; repeated items count once for each item_id, and of
    windows that several items share, all items count. No rows give no rows. A kept column named like a result column gets
    ``_in`` behind its name.

    The benchmark goes to the tasks as one automaton; beyond block_bytes of its text, which bounds a task's memory (about 60
    times as much), it goes in blocks with one each: then rows are numbered in a written table, each text is scanned once a
    block, and findings meet by that number.
    """
    spark, kind = df.sparkSession, bench.schema[item_col].dataType.simpleString()
    columns = carried([id_col, *keep], RESULTS)
    base = df.select(F.struct(*(F.col(c).alias(f"c{i}") for i, (c, _) in enumerate(columns))).alias("row"), F.col(text_col).alias("text"))
    size = bench.select(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    blocks = _blocks(bench, item_col, item_text, block_bytes)
    one = size <= block_bytes
    if not one:
        base = cut(base.withColumn("at", F.monotonically_increasing_id()), "contamination-rows")
    key = "row" if one else "at"
    item_type, row_type = to_arrow_type(bench.schema[item_col].dataType), base.schema[key].dataType.simpleString()
    span_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("a", "b", "start", "end")]))

    def scanned(block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches):
            if _built.get("block") is not sent.value:  # once for each worker, not for each task
                _built.update(block=sent.value, machine=automaton(sent.value, width))
            machine, ids = _built["machine"], [i for i, _ in sent.value]
            for batch in batches:
                texts = batch.column(1).to_pylist()
                rows = [scan(x, machine) for x in texts]
                found = [
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([placed(x, r) if r else [] for x, (_, r, _) in zip(texts, rows, strict=True)], span_type),
                    pa.array([[ids[i] for i in sorted(hit)] for _, _, hit in rows], pa.list_(item_type)),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=[key, "n_words", "ranges", "items"])

        return base.select(key, "text").mapInArrow(run, f"{key} {row_type}, {_FOUND.format(kind=kind)}")

    if one:
        out = scanned(next(blocks, [])).withColumn("spans", F.col("ranges"))
    else:
        parts = reduce(DataFrame.unionByName, (scanned(b) for b in blocks))
        every = parts.groupBy("at").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items"))
        last = lambda acc: F.element_at(acc, -1)
        longer = lambda acc, x: F.struct(
            last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], x["b"]).alias("b"), last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end")
        )
        joined = F.aggregate(
            F.array_sort("ranges"),
            F.array().cast(f"array<{_SPAN}>"),
            lambda acc, x: F.when(
                (F.size(acc) > 0) & (last(acc)["b"] >= x["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer(acc, x))),
            ).otherwise(F.concat(acc, F.array(x))),
        )
        out = base.select("row", "at").join(every.withColumn("spans", joined), "at")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"])
    out = out.withColumn("items", F.array_distinct("items")).withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long")})
    dirty = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return out.withColumn("contaminated", dirty).select(*(F.col(f"row.c{i}").alias(n) for i, (_, n) in enumerate(columns)), *RESULTS)


def items_digest(items: Column) -> Column:
    """Lower-case hex SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256)
