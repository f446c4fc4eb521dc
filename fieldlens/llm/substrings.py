"""Substring deduplication by recompression.

Every document's words are parsed into blocks by rounds that name runs of one symbol and pairs of neighbouring symbols. A
name is a 64-bit function of the names it replaces, so equal runs and pairs get the same name in every task, and no
dictionary has to travel. Each block carries its context, the words that its being a block depends on: where a text repeats,
all blocks whose context lies in the repeat appear again under the same names. Two rounds of counting follow, in Spark:

1. High-level names, and spans (stretches of whole blocks, somewhat longer than a window), are counted over the corpus. A
   window that holds the context of a name that occurs once occurs once itself; one inside a span that occurs twice repeats.
2. The windows that this leaves open are counted themselves, together with those inside the first of each span's copies.

Then the words that a repeating window covers are removed. Names alone never call a window repeated: spans and windows are
told apart by the BLAKE2b of their words, 128 bits, so the words of every repeat are verified.

Documents are dealt out in buckets by row number, and the text is shuffled once. A bucket sends each key of its own once, as
one row, so that a passage in a third of all documents costs a row for each bucket, and rows meet by key: there is no
message for each pair of bucket and receiver. What comes back to a bucket are its own keys that repeat.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import buffers, joined_words, mix, span_hashes, word_keys, words_of

#: Runs up to this length become one symbol; in longer ones each symbol stays, for the far end must not matter.
RUN = 4
#: Of each round, whether runs are named before pairs. A run takes both neighbours into a block's context, so only some do.
#: After six rounds a block has about six words and its context about twenty, so that a window of 35 holds some.
ROUNDS = (True, False, False, True, False, False)
#: A span begins at one in so many blocks, chosen by name.
THIN = 3
BLOCK, SPAN, WINDOW, FIRST = 0, 1, 2, 3

_ASKED = "kind int, k1 long, k2 long, bucket int, tag int, n int"
_NAMES = ["kind", "k1", "k2", "bucket", "tag", "n"]
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())


def _edge(values: np.ndarray, at: np.ndarray, doc: np.ndarray, own: np.ndarray, beyond: np.ndarray) -> np.ndarray:
    """values[at], or beyond where at leaves the document of own."""
    inside = (at >= 0) & (at < len(values))
    at = np.where(inside, at, 0)
    return np.where(inside & (doc[at] == doc[own]), values[at], beyond)


def parse(words: np.ndarray, offsets: np.ndarray, rounds: tuple[bool, ...] = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of all documents at once: names, first words, and the first and one past the last word of their contexts.

    A context that needs the document's edge reaches one word beyond it, so it lies in no window.
    """
    n = len(words)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first, last = offsets[:-1], offsets[1:]
    name, begin, left, right = words, np.arange(n), np.arange(n), np.arange(1, n + 1)
    for k, runs in enumerate(rounds):
        if not len(name):
            break
        if runs:
            equal = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
            head = np.flatnonzero(np.r_[True, ~equal])
            length = np.diff(np.r_[head, len(name)])
            long = np.repeat(length > RUN, length)
            take = long.copy()
            take[head] = True
            at = np.flatnonzero(take)
            size = np.where(long[at], 1, np.repeat(length, length)[at])
            reach = np.where(long[at], RUN, 1)
            new_left = _edge(left, at - reach, doc, at, first[doc[at]] - 1)
            new_right = _edge(right, at + size - 1 + reach, doc, at, last[doc[at]] + 1)
            name = np.where(size > 1, mix(name[at] + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(2 * k + 1)), name[at])
            doc, begin, left, right = doc[at], begin[at], new_left, new_right
        side = (mix(name + np.uint64(0x632BE59BD9B4E019 + k)) & np.uint64(1)).astype(bool)
        joins = ~side[:-1] & side[1:] & (doc[1:] == doc[:-1])
        starts, ends = np.r_[joins, False], np.r_[False, joins]
        at = np.flatnonzero(~ends)
        pair, back = starts[at], side[at]
        new_left = np.where(back, _edge(left, at - 1, doc, at, first[doc[at]] - 1), left[at])
        new_right = np.where(~back, _edge(right, at + 1, doc, at, last[doc[at]] + 1), right[at])
        mate = name[np.minimum(at + 1, len(name) - 1)]
        name = np.where(pair, mix(name[at] * np.uint64(0x9FB21C651E98DF25) + mix(mate + np.uint64(k))), name[at])
        doc, begin, left, right = doc[at], begin[at], new_left, new_right
    return name, begin, left, right


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... for each start and size."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) if len(sizes) else np.zeros(0, np.int64)


def candidates(known: np.ndarray, left: np.ndarray, right: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """First words of the windows in which every block with its context inside is known to repeat."""
    sizes = np.maximum(np.diff(offsets) - width + 1, 0)
    at = _ranges(offsets[:-1], sizes)
    left, right = np.minimum.accumulate(left[::-1])[::-1], np.maximum.accumulate(right)
    alone = np.r_[0, np.cumsum(~known)]
    a, b = np.searchsorted(left, at, "left"), np.searchsorted(right, at + width, "right")
    return at[(b <= a) | (alone[np.maximum(a, b)] == alone[a])]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each of n places: whether some [start, end) holds it."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change)[:-1] > 0


class Bucket:
    """One bucket's documents: words, blocks, spans, and what was answered about them."""

    def __init__(self, table: pa.Table, width: int, rounds: tuple[bool, ...] = ROUNDS) -> None:
        self.width = width
        self.table = table.sort_by("at")  # tags are places, so each round has to see the rows in one order
        data, offsets = buffers(self.table["text"])
        starts, ends, self.offsets = words_of(data, offsets)
        self.text, self.begins, self.ends = joined_words(data, starts, ends)
        self.words, self.others = word_keys(data, starts, ends, 1), word_keys(data, starts, ends, 2)
        self.name, begin, self.left, self.right = parse(self.words, self.offsets, rounds)
        # a span is a chosen block and those after it, up to the first end twice a window's width away or the document's end
        last = np.repeat(self.offsets[1:], np.diff(np.searchsorted(begin, self.offsets)))
        far = np.searchsorted(begin, begin + 2 * width)
        end = np.minimum(np.where(far < len(begin), begin[np.minimum(far, len(begin) - 1)], len(self.words)), last) if len(begin) else begin
        wide = (end - begin >= width) & (mix(self.name) % np.uint64(THIN) == 0)
        self.spans = begin[wide], end[wide]

    def alike(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each of the bucket's own stretches the first one with its words, by number; then those first ones, and how many
        stretches each stands for. Two independent 64-bit hashes tell stretches of one bucket apart."""
        one, two = span_hashes(self.words, starts, ends, 1), span_hashes(self.others, starts, ends, 2)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        head = np.flatnonzero(new)
        first = np.empty(len(order), np.int64)
        first[order] = order[head][np.cumsum(new) - 1]
        return first, order[head], np.diff(np.r_[head, len(order)])

    def rows(self, kind: int, bucket: int, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """A row for each distinct stretch: the digest of its words as key, its first start as tag, and how often it is here."""
        _, some, n = self.alike(starts, ends)
        text = self.text
        spans = zip(self.begins[starts[some]].tolist(), self.ends[ends[some] - 1].tolist(), strict=True)
        keys = np.frombuffer(b"".join(blake2b(text[a:b], digest_size=16).digest() for a, b in spans), np.int64).reshape(-1, 2)
        return [np.full(len(n), kind), keys[:, 0], keys[:, 1], np.full(len(n), bucket), starts[some], n]

    def block_rows(self, bucket: int) -> list[np.ndarray]:
        name, first, n = np.unique(self.name, return_index=True, return_counts=True)
        return [np.full(len(n), BLOCK), name.view(np.int64), np.zeros(len(n), np.int64), np.full(len(n), bucket), first, n]

    def known_blocks(self, answers: dict[int, np.ndarray]) -> np.ndarray:
        _, first, back = np.unique(self.name, return_index=True, return_inverse=True)
        return _marked(len(self.name), answers[BLOCK])[first[back]]

    def spread(self, answers: dict[int, np.ndarray], kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(whether a window that begins at each word lies in a span of these answers, whether the word itself does)."""
        a, b = self.spans
        some = _marked(len(self.words), answers[kind])[a[self.alike(a, b)[0]]]
        return covered(len(self.words), a[some], b[some] - self.width + 1), covered(len(self.words), a[some], b[some])

    def asked_windows(self, answers: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words of the windows to count, which of them are open, whether each word is in a span that repeats).

        Open are those that names leave open and that lie in no span that repeats; the others are inside the spans that this
        bucket counts for all buckets that hold a copy.
        """
        inside, gone = self.spread(answers, SPAN)
        open_ = _marked(len(self.words), candidates(self.known_blocks(answers), self.left, self.right, self.offsets, self.width)) & ~inside
        at = np.flatnonzero(open_ | self.spread(answers, FIRST)[0])
        return at, open_[at], gone

    def repeated(self, answers: dict[int, np.ndarray]) -> np.ndarray:
        """Of each word: whether a window that occurs twice or more covers it."""
        at, open_, gone = self.asked_windows(answers)
        first = at[self.alike(at, at + self.width)[0]]
        again = at[open_ & _marked(len(self.words), answers[WINDOW])[first]]
        return gone | covered(len(self.words), again, again + self.width)


def _marked(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[at] = True
    return out


def _table(parts: list[list[np.ndarray]]) -> pa.Table:
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(len(_NAMES))]
    return pa.table([pa.array(c.astype(np.int64), pa.int64()).cast(t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _answers(table: pa.Table) -> dict[int, np.ndarray]:
    kind, tag = (table[c].to_numpy() for c in ("kind", "tag"))
    found = {k: tag[kind % 4 == k] for k in (BLOCK, SPAN, WINDOW)}
    return found | {FIRST: tag[kind == SPAN + 4]}


def _again(asked: DataFrame) -> DataFrame:
    """(bucket, kind, tag) of the keys that occur twice or more; of a key's buckets the first has 4 more as kind.

    A key has a row for each bucket at most.
    """
    key = Window.partitionBy("k1", "k2")
    counted = asked.withColumns({"total": F.sum("n").over(key), "least": F.min("bucket").over(key)}).filter("total > 1")
    return counted.select("bucket", F.when(F.col("bucket") == F.col("least"), F.col("kind") + 4).otherwise(F.col("kind")).alias("kind"), "tag")


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 35, bucket_bytes: int = 4 << 20) -> DataFrame:
    """(id, n_words, n_removed, kept_text): every text without the words that a repeated window of width words covers.

    Null, empty and blank texts and those of fewer than width words lose nothing (without words, kept_text is empty). Rows
    with the same text or id, and rows without an id, count as separate documents; all occurrences of a window are removed,
    so there are no ties. No rows give no rows. Other columns are ignored, whatever their names. The order of the rows of a
    partition may change when df is read again, but not which rows it holds.
    bucket_bytes: text in one task's bucket. A longer text is a bucket of its own and has to fit in a task, which takes
    about 40 times its bytes.
    """
    base = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(96, total // bucket_bytes)
    # the rows are read three times, or again where an executor is lost: sorted, a partition's rows get the same numbers each time
    firm = base.sortWithinPartitions(F.xxhash64("doc_id", "text"), "doc_id", "text")
    dealt = firm.withColumn("at", F.monotonically_increasing_id()).withColumn("bucket", F.pmod(F.xxhash64("at"), F.lit(buckets)).cast("int"))

    def ask_names(key, table):
        bucket, number = Bucket(table, width), key[0].as_py()
        return _table([bucket.block_rows(number), bucket.rows(SPAN, number, *bucket.spans)])

    def ask_windows(key, table, back):
        if not len(table):
            return _table([])
        bucket = Bucket(table, width)
        at, _, _ = bucket.asked_windows(_answers(back))
        return _table([bucket.rows(WINDOW, key[0].as_py(), at, at + width)])

    def finish(key, table, back):
        bucket = Bucket(table, width)
        gone, off, lost, kept = bucket.repeated(_answers(back)), bucket.offsets, [], []
        for i, text in enumerate(bucket.table["text"].to_pylist()):
            words = (text or "").encode().split()
            drop = gone[off[i] : off[i + 1]]
            lost.append((len(words), int(drop.sum())))
            kept.append(b" ".join(compress(words, (~drop).tolist()) if lost[-1][1] else words).decode())
        return pa.table(
            [bucket.table["doc_id"], pa.array([a for a, _ in lost], pa.int64()), pa.array([b for _, b in lost], pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_text"],
        )

    by = dealt.groupBy("bucket")
    names = _again(by.applyInArrow(ask_names, _ASKED))
    windows = _again(by.cogroup(names.groupBy("bucket")).applyInArrow(ask_windows, _ASKED))
    id_type = df.schema[id_col].dataType.simpleString()
    out = by.cogroup(names.unionByName(windows).groupBy("bucket")).applyInArrow(finish, f"doc_id {id_type}, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("doc_id", id_col)
