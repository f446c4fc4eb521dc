"""Language identification by mixture inference over character n-grams."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of every code point: 2 if it is a letter, 1 if it is a mark, which belongs to the word that it combines in, 0 if it is
    neither. Numbers are no letters."""
    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8)


def grams(text: str | None, buckets: int) -> np.ndarray | None:
    """Counts of the hashed trigrams of the lower-case letters, words apart by one space; None without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _letters()[points]
    if not (kind == 2).any():
        return None
    inside = kind > 0
    kept = inside.copy()
    kept[1:] |= inside[:-1]  # of what is between two words, its first character stays, as a space
    plain = np.where(inside, points, np.uint32(32))[kept]
    x = np.concatenate([[32], plain, [32] if inside[-1] else []]).astype(np.uint64)
    h = (x[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (x[2:] * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.bincount((h >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets)


def gram_counts(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", buckets: int = 1 << 15) -> DataFrame:
    """(lang, bucket, n): the trigrams of all rows with a language, summed in each task before the shuffle."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = grams(text, buckets)
                if got is not None:
                    sums[lang] = sums.get(lang, 0) + got
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = df.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", buckets: int = 1 << 15, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities by bucket and language). The model has languages x buckets numbers, whatever the corpus."""
    found = gram_counts(df, text_col=text_col, lang_col=lang_col, buckets=buckets).toPandas()
    langs = sorted(found["lang"].unique())
    table = np.full((buckets, len(langs)), smooth)
    for k, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        table[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    return langs, table / table.sum(0)


def mixture(counts: np.ndarray, likely: np.ndarray, *, price: float = 3.0, rounds: int = 200) -> np.ndarray:
    """Proportions of the languages in a document with these counts (of n-grams with these likelihoods by language).

    Expectation-maximisation over a set of languages, and a set chosen by likelihood less price * log(n) / 2 for each
    language beyond the first. From the likeliest single language on, the language that gains most joins while it pays. No
    set can gain more than n * (greatest gradient - 1), so most documents of one language end at once.
    """
    n, logs = counts.sum(), counts @ np.log(likely)
    chosen = [int(np.argmax(logs))]
    share, best, cost = np.array([1.0]), float(logs[chosen[0]]), price * np.log(max(n, 2)) / 2
    while len(chosen) < likely.shape[1]:
        mix = likely[:, chosen] @ share
        slope = (counts / mix) @ likely / n
        slope[chosen] = 0
        if n * (slope.max() - 1) <= cost:
            break
        trial, value, sub = [*chosen, int(np.argmax(slope))], -np.inf, None
        sub, new = likely[:, trial], np.r_[share * 0.9, 0.1]
        for _ in range(rounds):
            mix = sub @ new
            value = float(counts @ np.log(mix))
            slope_in = (counts / mix) @ sub / n
            new = new * slope_in
            if value - best > cost and np.abs(slope_in - 1).max() < 0.01 or value + n * max(slope_in.max() - 1, 0) - best <= cost:
                break
        if value - best <= cost:
            break
        chosen, share, best = trial, new / new.sum(), value
    out = np.zeros(likely.shape[1])
    out[chosen] = share
    return out


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], *, id_col: str = "doc_id", text_col: str = "text", price: float = 3.0) -> DataFrame:
    """(id, lang_pred, score, langs, shares): the language with the greatest share, that share, and all of the set chosen.

    A text that is null or has no letters (general category L) is ``und`` with score 0 and an empty set; so is every text if
    nothing was learnt. Of equal shares the language that sorts first wins. Very long texts are read whole. Repeated rows
    each get their prediction, no rows give no rows, and other columns are ignored, whatever their names.
    """
    langs, table = model
    sent, buckets = df.sparkSession.sparkContext.broadcast(table), len(table)

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                got = grams(text, buckets) if langs else None
                if got is None:
                    rows.append((UNKNOWN, 0.0, [], []))
                    continue
                at = np.flatnonzero(got)
                share = mixture(got[at].astype(float), sent.value[at], price=price)
                order = [k for k in np.argsort(-share, kind="stable").tolist() if share[k] > 0]
                rows.append((langs[order[0]], min(1.0, float(share[order[0]])), [langs[k] for k in order], [float(share[k]) for k in order]))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "lang_pred", "score", "langs", "shares"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, lang_pred string, score double, langs array<string>, shares array<double>",
    )
    return out.withColumnRenamed("id", id_col)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds, F.lit(0))
