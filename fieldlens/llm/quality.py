"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import SPACE, buffers, carried, row_sums, slices, span_hashes, word_names, words_of

STATS = (
    "log_chars log_words log_lines mean_word upper digit mark pipe bang wide blank marked_ends upper_words repeated_words repeated_lines "
    "long_words log_longest words_a_line stops empty"
).split()


class Features(NamedTuple):
    """Sparse word features by row (offsets, columns, values) and dense statistics."""

    offsets: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    stats: np.ndarray


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER, _DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_MARK = _table("#$%&*+/<=>@\\^_`{|}~[]()\"")
_STOPS = _table(".,;:?!")
_ROW = {k: _table(c) for k, c in (("pipe", "|"), ("bang", "!"), ("line", "\n"))}
_WIDE = (np.arange(256) >= 0xC0).astype(np.int64)
_TAIL = ((np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)).astype(np.int64)


def _repeats(names: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Of each row, how many of its names are not their first occurrence in it."""
    if not len(names):
        return np.zeros(rows)
    order = np.lexsort((names, row))
    n, r = names[order], row[order]
    return np.bincount(r[1:][(n[1:] == n[:-1]) & (r[1:] == r[:-1])], minlength=rows).astype(float)


def _dense(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, wo: np.ndarray, names: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    words = np.diff(wo).astype(float)
    per = np.maximum(size, 1)
    count = lambda table: row_sums(table[data], offsets).astype(float)
    row = np.repeat(np.arange(rows), np.diff(wo))
    length = (ends - starts).astype(np.int64)
    chars, lines = size - count(_TAIL), count(_ROW["line"]) + 1
    upper = np.r_[0, np.cumsum(_UPPER[data])]
    ups = upper[ends] - upper[starts]
    last = data[np.maximum(ends - 1, 0)] if len(ends) else np.zeros(0, np.uint8)
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.r_[offsets[:-1][size > 0], breaks + 1]).astype(np.int64)
    begin = begin[begin < len(data)]
    stop = np.r_[begin[1:], len(data)].astype(np.int64)[: len(begin)]
    line_row = np.searchsorted(offsets, begin, "right") - 1
    line_names = word_names(data, begin, np.maximum(begin, stop - (data[np.maximum(stop - 1, 0)] == 10))) if len(begin) else np.zeros(0, np.uint64)
    by_word = lambda x: row_sums(x.astype(np.int64), wo) / np.maximum(words, 1)
    longest = np.zeros(rows)
    np.maximum.at(longest, row, length)
    return np.stack(
        [
            np.log1p(chars), np.log1p(words), np.log1p(lines), by_word(length), count(_UPPER) / per, count(_DIGIT) / per, count(_MARK) / per,
            count(_ROW["pipe"]) / per, count(_ROW["bang"]) / per, count(_WIDE) / per, count(SPACE.astype(np.int64)) / per, by_word(_MARK[last] > 0), by_word((ups > 1) & (2 * ups >= length)),
            _repeats(names, row, rows) / np.maximum(words, 1), _repeats(line_names, line_row, rows) / np.maximum(lines, 1), by_word(length > 20), np.log1p(longest),
            words / lines, by_word(_STOPS[last] > 0), (words == 0).astype(float),
        ],
        axis=1,
    )


def features(column: pa.Array, buckets: int, metadata: Sequence[pa.Array] = ()) -> Features:
    """Features of each text: words hashed to buckets, as the root of their share, and the statistics, among them two of each
    numeric column of metadata: its logarithm (signed, null as 0) and whether it is null."""
    data, offsets = buffers(column)
    starts, ends, wo = words_of(data, offsets)
    names = word_names(data, starts, ends)
    rows = len(column)
    row = np.repeat(np.arange(rows), np.diff(wo))
    key, n = np.unique(row * buckets + (names % np.uint64(buckets)).astype(np.int64), return_counts=True)
    at = key // buckets
    values = np.sqrt(n / np.maximum(np.diff(wo), 1)[at])
    known = [c.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False) for c in metadata]
    extra = [x for c, v in zip(metadata, known, strict=True) for x in (np.sign(v) * np.log1p(np.abs(np.nan_to_num(v))), c.is_null().to_numpy(zero_copy_only=False).astype(float))]
    stats = np.column_stack([_dense(data, offsets, starts, ends, wo, names), *extra])
    return Features(np.searchsorted(at, np.arange(rows + 1)), key % buckets, values, stats)


class Machine(NamedTuple):
    """A fitted factorisation machine: bias, linear weights and factors of word buckets and of statistics, and the
    statistics' centre and spread."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    stat_linear: np.ndarray
    stat_factors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def parts(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(margins, sums of factors, scaled statistics). Pairwise terms by the sum-of-squares identity, in linear time."""
        s = np.clip((f.stats - self.centre) / self.spread, -5, 5)
        v = self.factors[f.columns] * f.values[:, None]
        by_row = lambda x, y: np.einsum("ij,jk->ik", x, y)  # noqa: E731  each row by itself, unlike a product of blocks
        total, square = by_row(s, self.stat_factors), by_row(s**2, self.stat_factors**2)
        margin = self.bias + by_row(s, self.stat_linear[:, None])[:, 0] + row_sums(self.linear[f.columns] * f.values, f.offsets)
        for k in range(v.shape[1]):
            total[:, k] += row_sums(v[:, k], f.offsets)
            square[:, k] += row_sums(v[:, k] ** 2, f.offsets)
        return margin + 0.5 * (total**2 - square).sum(1), total, s

    def scores(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(f)[0], -30, 30)))


def _take(f: Features, rows: np.ndarray) -> Features:
    sizes = np.diff(f.offsets)[rows]
    at = np.concatenate([np.arange(f.offsets[r], f.offsets[r + 1]) for r in rows]) if len(rows) else np.zeros(0, np.int64)
    return Features(np.r_[0, np.cumsum(sizes)], f.columns[at], f.values[at], f.stats[rows])


def fit_machine(f: Features, label: np.ndarray, *, buckets: int, rank: int = 4, epochs: int = 30, rate: float = 0.05, ridge: float = 1e-3, seed: int = 7) -> Machine:
    """Minimises log loss by adaptive gradients over shuffled batches. With one class, its share is the score."""
    rng = np.random.default_rng(seed)
    spread = np.maximum(f.stats.std(0), 1e-2 * np.maximum(1, np.abs(f.stats.mean(0)))) if len(label) else np.ones(f.stats.shape[1])
    centre = f.stats.mean(0) if len(label) else np.zeros(f.stats.shape[1])
    share = (label.sum() + 1) / (len(label) + 2)
    params = [
        np.array([np.log(share / (1 - share))]), np.zeros(buckets), rng.normal(0, 0.01, (buckets, rank)), np.zeros(f.stats.shape[1]),
        rng.normal(0, 0.05, (f.stats.shape[1], rank)),
    ]
    if len(set(label.tolist())) < 2:
        return Machine(float(params[0][0]), *[p * 0 for p in params[1:]], centre, spread)
    past = [np.full_like(p, 1e-6) for p in params]
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for k in range(0, len(order), 64):
            b = _take(f, order[k : k + 64])
            m = Machine(float(params[0][0]), *params[1:], centre, spread)
            margin, total, s = m.parts(b)
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[order[k : k + 64]]) / len(margin)
            row = np.repeat(np.arange(len(margin)), np.diff(b.offsets))
            e = (err[row] * b.values)[:, None]
            cols, back = np.unique(b.columns, return_inverse=True)
            g_lin, g_fac = np.zeros(len(cols)), np.zeros((len(cols), rank))
            np.add.at(g_lin, back, e[:, 0])
            np.add.at(g_fac, back, e * (total[row] - params[2][b.columns] * b.values[:, None]))
            steps = [
                (slice(None), np.array([err.sum()])),
                (cols, g_lin + ridge * params[1][cols]),
                (cols, g_fac + ridge * params[2][cols]),
                (slice(None), s.T @ err + ridge * params[3]),
                (slice(None), s.T @ (err[:, None] * total) - ((s**2).T @ err)[:, None] * params[4] + ridge * params[4]),
            ]
            for p, h, (at, g) in zip(params, past, steps, strict=True):
                h[at] += g**2
                p[at] -= rate * g / np.sqrt(h[at])
    return Machine(float(params[0][0]), *params[1:], centre, spread)


def fit(
    df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = (), most_rows: int = 6000,
    buckets: int = 1 << 14, rank: int = 4,
) -> Machine:
    """A machine fitted on the rows of df (id, text) that labels (id, label 0/1) names: of at most most_rows labels, those
    whose ids hash lowest. Of rows that repeat an id, the one whose text hashes lowest is taken.

    The bound is on fitting alone, which is done by the driver on word buckets and statistics, about 10 KB a row. Labels that
    are null are left out; a null text is empty. The chosen labels are broadcast, so only their texts are shuffled. metadata names
    numeric columns that are features too; score takes the same. Without labels, every text scores one half.
    """
    named = labels.filter(F.col("label").isNotNull()).select(F.col(id_col).alias("id"), F.col("label").cast("double").alias("label"))
    chosen = named.orderBy(F.xxhash64("id"), "id", "label").limit(most_rows)

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(0), 1 << 20):
                f = features(batch.column(0).slice(a, b - a), buckets, [c.slice(a, b - a) for c in batch.columns[3:]])
                cut = lambda x: [x[i:j].tolist() for i, j in zip(f.offsets[:-1], f.offsets[1:], strict=True)]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(cut(f.columns), pa.list_(pa.int32())),
                        pa.array(cut(f.values), pa.list_(pa.float64())), pa.array(f.stats.tolist(), pa.list_(pa.float64())),
                    ],
                    names=["label", "id", "columns", "values", "stats"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    extra = [F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata)]
    rows = df.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), *extra)
    more = [f"m{i}" for i in range(len(metadata))]
    one = rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("digest"), "text", *more)).alias("r"))
    picked = one.select("r.text", "label", "id", *(f"r.{m}" for m in more))
    found = picked.mapInArrow(run, f"label double, id {kind}, columns array<int>, values array<double>, stats array<double>").toArrow().to_pandas()
    found = found.assign(order=found["label"] * 0 + found["stats"].map(lambda x: x[0])).sort_values(["id", "label", "order"], kind="stable")
    sizes = found["columns"].map(len).to_numpy() if len(found) else np.zeros(0, np.int64)
    join = lambda c, t: np.concatenate(found[c].tolist()).astype(t) if len(found) else np.zeros(0, t)
    f = Features(
        np.r_[0, np.cumsum(sizes)].astype(np.int64), join("columns", np.int64), join("values", float),
        np.array(found["stats"].tolist(), float).reshape(-1, len(STATS) + 2 * len(metadata)),
    )
    return fit_machine(f, found["label"].to_numpy(float), buckets=buckets, rank=rank)


def score(
    df: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = (), threshold: float = 0.7,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, keep..., score, predicted) of each row.

    Null and empty texts have no words and the statistics of none; very long texts are read whole; every row gets a score
    between 0 and 1, and predicted is 1 from the threshold on, itself included. Repeated rows get the same score. No rows
    give no rows. A kept column named like a result column gets ``_in`` behind its name.
    """
    sent, columns = df.sparkSession.sparkContext.broadcast(machine), carried([id_col, *keep], ("score", "predicted"))
    buckets, n = len(machine.linear), len(columns)

    def run(batches):
        for batch in batches:
            text = batch.column(n)
            out = np.zeros(len(batch))
            for a, b in slices(text, 1 << 20):
                out[a:b] = sent.value.scores(features(text.slice(a, b - a), buckets, [c.slice(a, b - a) for c in batch.columns[n + 1 :]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out)], names=[*(c for _, c in columns), "score"])

    extra = [F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata)]
    rows = df.select(*(F.col(c).alias(f"c{i}") for i, (c, _) in enumerate(columns)), F.col(text_col).alias("text"), *extra)
    schema = ", ".join(f"`{name}` {df.schema[c].dataType.simpleString()}" for c, name in columns)
    return rows.mapInArrow(run, f"{schema}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
