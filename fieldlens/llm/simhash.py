"""SimHash fingerprints and their exact near-duplicate classes, compared tile by tile."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import cut
from .textkit import buffers, carried, slices

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


#: Shingles whose bits are summed together; memory is this many times some 100 bytes, whatever a text's length.
SHINGLES = 1 << 14


def _hashes(words: list[bytes], size: int) -> Iterator[list[int]]:
    """The hashes of the words' shingles, in blocks of SHINGLES at most."""
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        yield [digest(b" ".join(words), 42)]
        return
    for k in range(0, len(words) - size + 1, SHINGLES):
        own = words[k : k + SHINGLES + size - 1]
        text, ends = b" ".join(own), list(accumulate(map(len, own), lambda x, n: x + n + 1))
        starts = [0, *(e + 1 for e in ends[: len(own) - size])]
        yield [digest(text[a:b], 42) for a, b in zip(starts, ends[size - 1 :], strict=True)]


def _bits(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprint_texts(column: pa.Array, size: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text."""
    sums, counts = np.zeros((len(column), 64), np.int64), np.zeros(len(column), np.int64)
    for a, b in slices(column, 1 << 18):
        data, offsets = buffers(column.slice(a, b - a))
        low, every, rows = data.tobytes().translate(_LOWER), [], []
        for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), a):
            words = low[s:e].split()
            for block in _hashes(words, size) if words else ():
                counts[i] += len(block)
                if len(block) == SHINGLES:  # of a long text
                    sums[i] += _bits(block).sum(0, dtype=np.int64)
                else:
                    every += block
                    rows.append((i, len(block)))
        if rows:
            at, n = np.array(rows).T
            sums[at] += np.add.reduceat(_bits(every), np.cumsum(n) - n, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(df: DataFrame, *, text_col: str = "text", size: int = 4, columns: list[tuple[str, str]]) -> DataFrame:
    """The columns (name, name in the result) of each row and fp long, its 64-bit fingerprint as a signed long. A text
    without words, or null, has fingerprint 0."""

    def run(batches):
        for batch in batches:
            prints = fingerprint_texts(batch.column(len(columns)), size)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(prints.view(np.int64))], names=[*(n for _, n in columns), "fp"])

    schema = ", ".join(f"`{n}` {df.schema[c].dataType.simpleString()}" for c, n in columns)
    rows = df.select(*(F.col(c).alias(f"c{i}") for i, (c, _) in enumerate(columns)), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"{schema}, fp long")


def star_forest(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """root (the least member of each node's class so far), joined along the links a-b."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := root[root], root):
            root = up


def linked(one: np.ndarray, two: np.ndarray, radius: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """(fp, least fp of its class) within two tiles for every fingerprint that a link of at most radius bits joins.

    Both tiles are ordered by the bit count of their upper halves; of a block of one tile, only the stretch of the other
    whose halves' counts come within the radius is compared.
    """
    half = lambda x: np.bitwise_count(x >> np.uint64(32)).astype(np.int16)
    whole = lambda x: np.bitwise_count(x).astype(np.int16)
    one = one[np.lexsort((one, half(one)))]
    two = one if own else two[np.lexsort((two, half(two)))]
    every = one if own else np.concatenate([one, two])
    rank = np.argsort(every)
    place = np.empty(len(every), np.int64)
    place[rank] = np.arange(len(every))
    mine, other = place[: len(one)], place if own else place[len(one) :]
    root = np.arange(len(every))
    h1, h2, d = half(one), half(two), int(whole(two[:1])[0]) - int(whole(one[:1])[0]) if len(one) and len(two) else 0
    for s in range(0, len(one), 64):
        block = one[s : s + 64]
        # with x the difference of the upper halves and d that of the whole: |x| + |d - x| <= radius
        a = np.searchsorted(h2, h1[s] - (radius - d) // 2, "left")
        b = np.searchsorted(h2, h1[min(s + 64, len(one)) - 1] + (radius + d) // 2, "right")
        a = max(a, s) if own else a
        for t in range(a, b, 4096):
            near = np.bitwise_count(block[:, None] ^ two[None, t : min(t + 4096, b)]) <= radius
            i, j = np.nonzero(near)
            if len(i):
                root = star_forest(mine[s + i], other[t + j], root)
    away = np.flatnonzero(root != np.arange(len(every)))
    return every[rank][away], every[rank][root[away]]


def near_classes(prints: DataFrame, *, radius: int = 4, tile_rows: int = 16384) -> DataFrame:
    """(fp, root): for each distinct fingerprint that has a neighbour within radius bits, a common member of its class.

    Distinct fingerprints are put into tiles of one bit count and about tile_rows rows (1/64 of a small input). Tiles whose counts differ by more
    than the radius are never brought together; the others are packed into one binary each and compared pair by pair with
    exclusive-or and bit counts. A pair of tiles returns a forest, not its links, so a large class stays small. The work is
    that of all pairs of distinct fingerprints within the radius in bit count: exact, and quadratic in their number.
    """
    spark = prints.sparkSession
    distinct = cut(prints.select("fp").distinct().withColumn("ones", F.bit_count("fp").cast("int")), "simhash-fp")
    counts = {r["ones"]: r["n"] for r in distinct.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    rows = min(tile_rows, max(1024, sum(counts.values()) // 64))  # a small input still makes enough tiles for all tasks
    tiles = {c: -(-n // rows) for c, n in counts.items()}
    if not tiles:
        return spark.createDataFrame([], "fp long, root long")
    span = F.create_map(*[F.lit(x) for kv in sorted(tiles.items()) for x in kv])
    tiled = distinct.withColumn("tile", F.pmod(F.xxhash64("fp"), span[F.col("ones")]).cast("int"))

    def pack(key, table):
        blob = table["fp"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
        return pa.table({"ones": pa.array([key[0].as_py()], pa.int32()), "tile": pa.array([key[1].as_py()], pa.int32()), "fps": pa.array([blob], pa.binary())})

    packed = cut(tiled.groupBy("ones", "tile").applyInArrow(pack, "ones int, tile int, fps binary"), "simhash-tiles")
    # A tile meets each tile of 0 .. radius more ones; among tiles of its own count, those of its own or a higher number.
    reach = F.sequence(F.lit(0), F.lit(radius))
    over = packed.select("ones", "tile", "fps", F.explode(reach).alias("d")).withColumn("m", span[F.col("ones") + F.col("d")]).filter("m is not null")
    first = over.select(
        F.col("ones").alias("c1"), F.col("tile").alias("t1"), (F.col("ones") + F.col("d")).alias("c2"),
        F.explode(F.sequence(F.when(F.col("d") == 0, F.col("tile")).otherwise(0), F.col("m") - 1)).alias("t2"), F.lit(1).alias("side"), "fps",
    )
    under = packed.select("ones", "tile", "fps", F.explode(reach).alias("d")).withColumn("m", F.when(F.col("d") == 0, F.col("tile")).otherwise(span[F.col("ones") - F.col("d")])).filter("m > 0")
    second = under.select(
        (F.col("ones") - F.col("d")).alias("c1"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("t1"), F.col("ones").alias("c2"),
        F.col("tile").alias("t2"), F.lit(2).alias("side"), "fps",
    )

    def compare(key, table):
        sides = {s: np.frombuffer(x, np.uint64) for s, x in zip(table["side"].to_pylist(), table["fps"].to_pylist(), strict=True)}
        fp, root = linked(sides[1], sides.get(2, sides[1]), radius, 2 not in sides)
        return pa.table({"a": pa.array(fp.view(np.int64)), "b": pa.array(root.view(np.int64))})

    links = first.unionByName(second).groupBy("c1", "t1", "c2", "t2").applyInArrow(compare, "a long, b long")
    return components(links).select(F.col("node").alias("fp"), "root")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4, keep: tuple[str, ...] = (), salts: int = 16) -> DataFrame:
    """(id, keep..., fp, component_id, kept): component_id is the least id that is reachable over fingerprints within radius
    bits, and kept marks one row of each class, the first of those with the least id.

    Texts of fewer than size words have the fingerprint of all their words; null, empty and blank texts have 0 and are
    linked like others. Very long texts are read whole, in blocks of shingles. Repeated rows stay, each with its class; of
    equal ids in different classes each class has its own kept row. A null id is never a component_id unless all are null.
    No rows give no rows. A kept column named like a result column gets ``_in`` behind its name.
    salts: parts that a class's fingerprints are dealt out to where they learn their class's id.
    """
    columns = carried([id_col, *keep], ("fp", "component_id", "kept"))
    found = fingerprints(df, text_col=text_col, size=size, columns=columns).select(
        F.struct(*(F.col(f"`{n}`") for _, n in columns)).alias("row"), F.col(columns[0][1]).alias("id"), "fp",
        F.monotonically_increasing_id().alias("at"),
    )
    prints = cut(found, "simhash-docs")
    # the least id of each fingerprint first (partial sums), then of each class: no group of copies is gathered
    least = cut(prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("least")), "simhash-least")
    members = least.join(near_classes(least, radius=radius), "fp", "left").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)))
    members = cut(members, "simhash-members")
    top = members.filter("root is not null").groupBy("root").agg(F.min("least").alias("top")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    linked = members.filter("root is not null").join(top, ["root", "salt"]).select("fp", "top")
    named = cut(linked.unionByName(members.filter("root is null").select("fp", F.col("least").alias("top"))), "simhash-named")
    met = prints.join(named.hint("merge"), "fp")
    return met.select(*(F.col(f"row.`{n}`").alias(n) for _, n in columns), "fp", F.col("top.id").alias("component_id"), (F.col("at") == F.col("top.at")).alias("kept"))
