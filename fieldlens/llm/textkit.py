"""Small vectorised helpers on UTF-8 bytes that the text operators share inside their tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

#: The six bytes of the word class ``[\x20\x09-\x0D]``; all are ASCII, so UTF-8 bytes split like code points.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a polynomial hash depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=4)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i (mod 2 ** 64) for i below size."""
    up, down = np.full(size, _BASE), np.full(size, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(1 << max(16, int(n + 1).bit_length()))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; equal spans hash alike wherever they stand."""
    up, down = _powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    return mix(raw ^ mix((ends - starts).astype(np.uint64) + np.uint64(seed)))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its len + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most_bytes: int):
    """(first row, one past the last row) of runs of rows of about most_bytes at most; a longer text stands alone."""
    _, offsets = buffers(column)
    at, n = 0, len(column)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the len + 1 offsets of each row's words; rows never share a word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = solid[cut]
    stops[cut - 1] = solid[cut - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit bucket name of each word, the same in every task; for features, not for equality."""
    return span_hashes(_BYTE[data], starts, ends, seed)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit key of each word. Words of up to 7 bytes are packed with their length and scrambled one to one, so no two of
    them share a key; longer ones have their keyed XXH3."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    kept = np.minimum(8 * size, 56).astype(np.uint64)
    packed = (eight[starts] & ((np.uint64(1) << kept) - np.uint64(1))) | (size.astype(np.uint64) << np.uint64(56))
    out = mix(packed ^ mix(np.full(1, seed + 1, np.uint64)))
    far = np.flatnonzero(size > 7)
    if len(far):
        raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
        out[far] = np.array([digest(raw[a:b], seed) for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)], np.uint64)
    return out


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space after each, and where each begins and ends in that."""
    sizes = ends - starts
    at = np.r_[0, np.cumsum(sizes + 1)]
    begins = at[:-1]
    out = np.full(int(at[-1]), 0x20, np.uint8)
    shift = np.repeat(begins - starts, sizes)
    where = np.arange(int(sizes.sum())) + np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) if len(sizes) else np.zeros(0, np.int64)
    out[where + shift] = data[where]
    return out.tobytes(), begins, begins + sizes


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between the offsets; empty rows give 0. A row's sum depends on its own values alone."""
    out = np.zeros(len(offsets) - 1, np.float64 if values.dtype.kind == "f" else np.int64)
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(some):
        out[some] = np.add.reduceat(values[: offsets[some[-1] + 1]], offsets[some], dtype=out.dtype)
    return out


def carried(columns: list[str] | tuple[str, ...], results: tuple[str, ...]) -> list[tuple[str, str]]:
    """(column, its name in the result) of the columns that go with a row; one named like a result column gets ``_in``."""
    out: list[tuple[str, str]] = []
    for c in dict.fromkeys(columns):
        name = c
        while name in results or name in [n for _, n in out]:
            name += "_in"
        out.append((c, name))
    return out
