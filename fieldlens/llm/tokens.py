"""Token counts of byte-level BPE tokenizers by finite-state transducers.

Two machines are compiled. The first cuts a text into pretokens: a letter-class table and a rule that looks one character
back and three ahead, so it needs no state beyond the previous character. The second reads a pretoken's bytes. Its state is
what the rest of the pretoken can depend on: for every earlier position from which some vocabulary entry may still end
later, the last token of the encoding up to there and how many tokens fewer it took. A byte's transition is annotated with
the change in the number of emitted tokens, and a pretoken's count is the sum of its transitions. States are made when
first met; there are finitely many, for entries are of bounded length.

A long text is read in chunks. A chunk's map takes the state in which the second machine enters it to the state in which it
leaves it and the change in the number of tokens; a pretoken border in the chunk resets the machine, so behind the first
border the map is constant, and before it the machine runs from whatever state it is given. Maps compose, so the chunks of
a text are combined in a tree, in any grouping. A text is one row and so read in one task; Spark's tasks are its rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import row_sums

# fixed values: classes of characters in the pretoken pattern, and its contractions
OTHER, LETTER, NUMBER, BLANK, SPACE, EDGE = range(6)
MARK = 0x110000
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, and of the mark that stands between texts, one past the last of them."""
    out = np.zeros(MARK + 1, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    out[0x20], out[MARK] = SPACE, EDGE
    return out


def pretoken_starts(points: np.ndarray) -> np.ndarray:
    """True where a pretoken begins in the code points of texts, between which marks stand as pretokens of their own."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[points]
    white = (kind == BLANK) | (kind == SPACE)
    core = np.where(white, BLANK, kind)
    start, tail = np.ones(n, bool), np.zeros(n, bool)
    start[1:] = (core[1:] != core[:-1]) | (core[1:] == EDGE)
    # the last blank of a run that something follows is cut off; a plain space there opens the next pretoken
    tail[:-1] = white[:-1] & ~white[1:] & (core[1:] != EDGE)
    start |= tail
    start[1:] &= ~(tail & (kind == SPACE))[:-1]
    for a in np.flatnonzero((points == 39) & start).tolist():
        for text in CONTRACTIONS:
            b = a + len(text)
            if b <= n and points[a + 1] == ord(text[1]) and (len(text) == 2 or points[a + 2] == ord(text[2])):
                start[a + 1 : b] = False
                start[b : b + 1] = True
                break
    return start


class Transducer:
    """The deterministic machine that counts a pretoken's tokens, compiled as far as its input needs."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.parts = {}
        for a, b in merges:
            self.parts.setdefault(a + b, (a, b))
        self.tokens = set(vocab)
        self.longer = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Back to the start state alone."""
        self.keys: list[tuple] = [((b"", None, 0),)]
        self.known = {self.keys[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]
        if len(self.fits) > 1_000_000:
            self.fits.clear()

    def _follows(self, left: bytes, right: bytes) -> bool:
        """Whether BPE leaves left and right as they are when they stand side by side.

        Undo the two tokens' merges from the latest on: a merge across the border that would have come earlier than the
        one that made either neighbour shows that the pair can't stand.
        """
        got = self.fits.get((left, right))
        if got is None:
            got = self.fits[left, right] = self._stands(left, right)
        return got

    def _stands(self, left: bytes, right: bytes) -> bool:
        most = len(self.rank)
        limit = most
        while True:
            across = self.rank.get((left, right), most)
            if across < limit:
                return False
            one, two = self.parts.get(left), self.parts.get(right)
            r1 = self.rank[one] if one else -1
            r2 = self.rank[two] if two else -1
            if r1 < 0 and r2 < 0:
                return True
            # of equal merges the leftmost comes first: one across the border precedes its equal in the right token only
            if r1 > r2:
                left, limit = one[1], r1
            else:
                right, limit = two[0], r2 + 1

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change in the number of tokens)."""
        move = self.moves[state].get(byte)
        if move is None:
            move = self.moves[state][byte] = self._compile(state, byte)
        return move

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        b, last, took, alive = bytes([byte]), None, None, []
        for read, token, less in self.keys[state]:
            now = read + b
            if last is None and now in self.tokens and (token is None or self._follows(token, now)):
                last, took = now, 1 - less
            if now in self.longer:
                alive.append((now, token, less))
        if last is None:
            raise ValueError(f"no token ends after byte {byte}")
        key = (*((read, token, less + took) for read, token, less in alive), (b"", last, 0))
        at = self.known.setdefault(key, len(self.keys))
        if at == len(self.keys):
            self.keys.append(key)
            self.moves.append({})
        return at, took

    def run(self, data: bytes, state: int = 0) -> tuple[int, int]:
        """(state after data, tokens emitted)."""
        moves, total = self.moves, 0
        for byte in data:
            move = moves[state].get(byte)
            if move is None:
                move = self.step(state, byte)
            state, n = move
            total += n
        return state, total


@dataclass(frozen=True)
class ChunkMap:
    """A map of states: entered in a state, the machine reads head from it; then, if there is a border, it is reset, emits
    rest and stands in end. A map without a border has no end."""

    head: tuple[bytes, ...]
    end: int | None = None
    rest: int = 0

    def __call__(self, state: int, machine: Transducer) -> tuple[int, int]:
        """(state in which the chunk is left, change in the number of tokens)."""
        total = 0
        for piece in self.head:
            state, n = machine.run(piece, state)
            total += n
        return (state, total) if self.end is None else (self.end, total + self.rest)

    def then(self, other: ChunkMap, machine: Transducer) -> ChunkMap:
        """The map of this chunk and the next, as one."""
        if self.end is None:
            return ChunkMap(self.head + other.head, other.end, other.rest)
        end, n = other(self.end, machine)
        return ChunkMap(self.head, end, self.rest + n)


def scan_maps(maps: list[ChunkMap], machine: Transducer) -> ChunkMap:
    """All maps composed, as a tree of neighbours."""
    while len(maps) > 1:
        maps = [maps[i].then(maps[i + 1], machine) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0] if maps else ChunkMap(())


def _checked(spec: dict) -> dict:
    """spec, if it is a tokenizer of the kind that is counted here; ValueError otherwise, for counts would be wrong."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", [before])
    wrong = [
        what
        for what, bad in (
            ("model", model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback") or model.get("unk_token")),
            ("affixes", model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")),
            ("normalizer", spec.get("normalizer") is not None),
            ("pre_tokenizer", [s.get("type") for s in steps] != ["ByteLevel"] or steps[0].get("add_prefix_space") or not steps[0].get("use_regex", True)),
            ("added token", any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"])),
        )
        if bad
    ]
    if wrong:
        raise ValueError(f"not a plain byte-level BPE tokenizer: {', '.join(wrong)}")
    return spec


def _byte_letters() -> dict[str, int]:
    """How a byte-level vocabulary file writes bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Counter:
    """Token counts of texts as the tokenizer file's own library gives them, without special tokens added."""

    def __init__(self, tokenizer_json: str, *, most_known: int = 800_000, most_states: int = 300_000) -> None:
        spec, letters = _checked(json.loads(tokenizer_json)), _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        special = [t["content"] for t in spec["added_tokens"] if t["content"]]
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.machine = Transducer(vocab, [(raw(a), raw(b)) for a, b in pairs])
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[bytes, int] = {b"": 0}
        self.short: dict[int, int] = {}
        self.most_known, self.most_states = most_known, most_states

    def fresh(self, data: bytes) -> int:
        if len(self.machine.keys) > self.most_states:  # compiled anew as needed, so that memory stays bounded
            self.machine.forget()
        return self.machine.run(data)[1]

    def pretoken(self, data: bytes) -> int:
        n = self.known.get(data)
        if n is None:
            n = self.fresh(data)
            if len(self.known) >= self.most_known:
                self.known = {b"": 0}
            if len(data) <= 64:
                self.known[data] = n
        return n

    def chunk_map(self, data: bytes, starts: list[int]) -> ChunkMap:
        """data's map; starts are the pretoken borders in it."""
        if not starts:
            return ChunkMap((data,))
        whole = sum(self.pretoken(data[a:b]) for a, b in zip(starts, starts[1:]))  # noqa: B905  the last border opens the tail
        end, n = self.machine.run(data[starts[-1] :])
        return ChunkMap((data[: starts[0]],), end, whole + n)

    def borders(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The texts' bytes on end, where pretokens start in them, and at which of these starts each text begins (and ends)."""
        points = np.frombuffer(chr(0xFFFF).join(texts).encode("utf-32-le"), np.uint32)
        data = "".join(texts).encode()
        sizes = np.array([len(x) for x in texts])
        marks = (np.cumsum(sizes) + np.arange(len(texts)))[:-1]
        if len(marks):
            points = points.copy()
            points[marks] = MARK
        wide = np.ones(len(points), np.int64) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        wide[marks] = 0
        at = np.flatnonzero(pretoken_starts(points))
        return data, (np.cumsum(wide) - wide)[at], np.searchsorted(at, np.r_[0, marks, len(points)])

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each of several short texts without special strings. Equal short pretokens are counted together."""
        data, starts, rows = self.borders(texts)
        if not len(starts):
            return [0] * len(texts)
        sizes = np.diff(np.r_[starts, len(data)])
        padded = np.frombuffer(data + bytes(8), np.uint8)
        eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        short = sizes < 8
        key = (eight[starts[short]] & ((np.uint64(1) << (8 * sizes[short]).astype(np.uint64)) - np.uint64(1))) | (sizes[short].astype(np.uint64) << np.uint64(56))
        every, back = np.unique(key, return_inverse=True)
        got = [self.packed(k) for k in every.tolist()]
        out = np.zeros(len(starts), np.int64)
        out[short] = np.array(got, np.int64)[back] if got else 0
        long = np.flatnonzero(~short)
        get, slow = self.known.get, self.pretoken
        found = [get(data[a:b]) or slow(data[a:b]) for a, b in zip(starts[long].tolist(), (starts + sizes)[long].tolist(), strict=True)]
        out[long] = found
        return row_sums(out, rows).tolist()

    def packed(self, key: int) -> int:
        """The count of a pretoken of less than 8 bytes, given as its length in the top byte above its bytes."""
        n = self.short.get(key)
        if n is None:
            if len(self.short) >= self.most_known:
                self.short = {}
            n = self.short[key] = self.fresh(key.to_bytes(8, "little")[: key >> 56])
        return n

    def plain(self, text: str, chunk: int = 1 << 16) -> int:
        """Tokens of a long text without special strings, from the maps of its chunks of so many bytes."""
        data, starts, _ = self.borders([text])
        if len(self.machine.keys) > self.most_states:
            self.machine.forget()
        cuts = np.searchsorted(starts, np.arange(0, len(data) + chunk, chunk))
        kept, self.most_states = self.most_states, 1 << 62  # maps name states, which have to last as long as the maps
        maps = [self.chunk_map(data[k * chunk : (k + 1) * chunk], (starts[a:b] - k * chunk).tolist()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        _, total = scan_maps(maps, self.machine)(0, self.machine)
        self.most_states = kept
        return total

    def count(self, text: str | None) -> int:
        return self.count_all([text])[0]

    def count_all(self, texts: list[str | None], *, together: int = 1 << 18, long: int = 1 << 16) -> list[int]:
        """Tokens of each text; texts longer than long code points are read in chunks, the others in groups."""
        out, group, held = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            pieces = [text] if text else []
            if text and self.special is not None and self.special.search(text):
                out[i], pieces = len(self.special.findall(text)), [p for p in self.special.split(text) if p]
            for p in pieces:
                if len(p) > long:
                    out[i] += self.plain(p)
                else:
                    group.append((i, p))
                    held += len(p)
            if group and (held >= together or i + 1 == len(texts)):
                self._add(out, group)
                group, held = [], 0
        if group:
            self._add(out, group)
        return out

    def _add(self, out: list[int], group: list[tuple[int, str]]) -> None:
        for (i, _), n in zip(group, self.counts([p for _, p in group]), strict=True):
            out[i] += n


_loaded: dict = {}


def token_counts(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each whole text; null counts as empty, with 0 bytes and tokens.

    tokenizer_path is a local byte-level BPE file in the JSON form of the tokenizers library; it is read once, by the driver,
    and sent to the tasks (a few MB, whatever the corpus). A file of another kind raises ValueError. Strings of special
    tokens inside a text count one token each, as the library does by default. Very long texts are read in chunks. Repeated
    rows each get their counts, no rows give no rows, and other columns are ignored, whatever their names.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        if _loaded.get("file") is not sent.value:  # once for each worker, not for each task
            _loaded.update(file=sent.value, counter=Counter(sent.value))
        counter = _loaded["counter"]
        for batch in batches:
            counts = counter.count_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)

