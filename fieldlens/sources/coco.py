"""COCO documents without loss: one large JSON document read by many tasks, and tables streamed into documents.

A document is read as text cut at each closing brace, which Spark splits by byte ranges. What a brace means depends on all
text before it, so a first pass tells for each range what it does to the state (inside a string or not, brackets left open),
the ranges' states are put together in order, and a second pass reads each range from its own state. Only objects that lie
over the border of two ranges are put together from pieces. A large document is a folder of files that make it up one after
another, so that many tasks write it; reading takes their ranges as those of one file.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.sources.shared import cut

IMAGE = "id bigint, file_name string, width int, height int, license int, date_captured string, coco_url string, flickr_url string"
ANNOTATION = (
    "id bigint, image_id bigint, category_id bigint, bbox array<double>, area double, iscrowd int, segmentation variant, "
    "keypoints array<double>, num_keypoints int"
)
CATEGORY = "id bigint, name string, supercategory string, keypoints array<string>, skeleton array<array<bigint>>"
LICENSE = "id int, name string, url string"
INFO = "description string, url string, version string, year int, contributor string, date_created string"

_ESCAPED = re.compile(rb"\\.", re.S)
_ESCAPE, _STRING, _BRACKET = re.compile(r"\\."), re.compile(r'"[^"]*"'), re.compile(r"[\[\]{}]")
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"\s*:?|$)|[\[\]{}]', re.S)
#: Folders of documents in files: this, "=" and a number.
_FOLDER = "document_in_files"
_IN_FOLDER = re.compile(f"(.*/{_FOLDER}=[0-9]+)/([^/]*)", re.S)
_MARKS = np.isin(np.arange(256), list(b'"[]{}'))
_REST = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_RANGES = "file string, start string, inside boolean, flips boolean, closes int, opens string"
_PIECES = "file string, start string, kind string, name string, part long, begins boolean, ends boolean, value string"


class Coco(NamedTuple):
    """The tables of a dataset. images, annotations and categories may have more columns, which go along into documents."""

    images: DataFrame
    annotations: DataFrame
    categories: DataFrame
    info: DataFrame | None = None
    licenses: DataFrame | None = None


def rings(segmentation: Column) -> Column:
    """Polygons of a segmentation: those of a list of lists, one of a flat list, null for run lengths."""
    first = lambda path: F.try_variant_get(segmentation, path, "double").isNotNull()
    nested, flat = F.try_variant_get(segmentation, "$", "array<array<double>>"), F.array(F.try_variant_get(segmentation, "$", "array<double>"))
    return F.when(first("$[0][0]"), nested).when(first("$[0]"), flat)


def _brackets(text: str, inside: bool) -> tuple[str, bool]:
    """The brackets of a text outside strings, and whether it ends inside one. No escape reaches over a text's end: a cut
    lies after a brace."""
    if "\\" in text:
        text = _ESCAPE.sub("", text)
    if inside:
        text = '"' + text
    if '"' in text:
        odd = text.count('"') % 2
        text = _STRING.sub("", text)
        if odd:
            return "".join(_BRACKET.findall(text[: text.index('"')])), True
    return "".join(_BRACKET.findall(text)), False


def _text(values: pa.Array) -> bytes:
    """Texts that end in braces, one after another."""
    one = pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values.cast(pa.large_string()))
    return pc.binary_join(one, pa.scalar("}", pa.large_string()))[0].as_buffer().to_pybytes() + b"}"


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The places of brackets, what they are, and whether an odd number of quotes stands before; and whether there is an odd
    number in all."""
    plain = np.frombuffer(_ESCAPED.sub(b"  ", data) if b"\\" in data else data, np.uint8)
    at = np.flatnonzero(_MARKS[plain])
    kinds = plain[at]
    quotes = kinds == ord('"')
    odd = (np.cumsum(quotes) & 1).astype(bool)
    return at[~quotes], kinds[~quotes], odd[~quotes], bool(len(odd) and odd[-1])


def _both(texts: pa.Array) -> tuple[tuple[str, str], bool]:
    """As _brackets of texts that end in braces, begun outside a string and inside, without those that close one another;
    and whether the texts end in the other state than they begin with."""
    _, kinds, odd, flips = _marks(_text(texts))
    found = []
    for own in (~odd, odd):
        left, now = None, kinds[own].tobytes()
        while left != now:
            left, now = now, now.replace(b"[]", b"").replace(b"{}", b"")
        found.append(now.decode())
    return (found[0], found[1]), flips


def _follow(stack: list[str], brackets: str) -> int:
    """Brackets opened and closed on the stack; how many from before it are closed."""
    closes = 0
    for b in brackets:
        if b in "[{":
            stack.append(b)
        elif stack:
            stack.pop()
        else:
            closes += 1
    return closes


def _chunks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, at, value): the texts between closing braces of each range of each file, in order within a task."""
    rows = spark.read.option("lineSep", "}").text(paths)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")


def _range(path: str, at: int) -> tuple[str, str]:
    """(file, start) of a range: the document that it belongs to, by the folder of one in files, and what sorts its ranges."""
    if folder := _IN_FOLDER.fullmatch(path):
        return folder[1], f"{folder[2]}:{at:020d}"
    return path, f"{at:020d}"


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Array]]:
    """((file, start), texts) of stretches of a task's rows that belong to one range."""
    for b in batches:
        if not b.num_rows:
            continue
        paths, starts, values = b["path"].dictionary_encode(), b["at"].to_numpy(), b["value"]
        which = paths.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((which[1:] != which[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist(), len(values)]
        for begin, end in pairwise(cuts):
            yield _range(paths[begin].as_py(), int(starts[begin])), values.slice(begin, end - begin)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range does, once if it begins outside a string and once if inside."""
    key, states = None, []

    def done() -> pa.RecordBatch:
        rows = [(*key, begin, now != begin, closes, "".join(stack)) for begin, now, closes, stack in states]
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _RANGES.split(", ")])

    for found, texts in _by_range(batches):
        if found != key:
            if key:
                yield done()
            key, states = found, [(False, False, 0, []), (True, True, 0, [])]
        both, flips = _both(texts)
        states = [(begin, now ^ flips, closes + _follow(stack, both[now]), stack) for begin, now, closes, stack in states]
    if key:
        yield done()


def _starts(table: pa.Table) -> pa.Table:
    """(file, start, inside, opens) that each range of a file begins with: a row for each range, in order."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["start"], r["inside"]))
    inside, opens, out = False, "", []
    for k in range(0, len(rows), 2):
        r = rows[k + inside]
        out.append({"file": r["file"], "start": r["start"], "inside": inside, "opens": opens})
        opens = (opens[: len(opens) - r["closes"]] if r["closes"] else opens) + r["opens"]
        inside ^= r["flips"]
    return pa.Table.from_pylist(out, schema=pa.schema([("file", pa.string()), ("start", pa.string()), ("inside", pa.bool_()), ("opens", pa.string())]))


class _Reader:
    """Reads a range's chunks from a state: the objects that a member of the document's object is or lists come out whole or,
    at the range's ends, in pieces; and last the name of the member that the range ends in."""

    def __init__(self, file: str, start: str, inside: bool, opens: str) -> None:
        self.key, self.inside, self.opens = (file, start), inside, list(opens)
        self.base = self._base()
        self.name: str | None = None
        self.part, self.begins, self.held, self.out = 0, not self.base, [], []
        self.whole: list[tuple[str | None, int, list[bytes]]] = []

    def _base(self) -> int:
        """The number of brackets around the object that is being read; 0 if there is none."""
        return 1 if self.opens[:2] == ["{", "{"] else 2 if self.opens[:3] == ["{", "[", "{"] else 0

    def chunks(self, values: pa.Array) -> None:
        at, ahead = 0, 64
        while at < len(values):
            taken = 0
            if not self.base and not self.inside and self.opens == ["{", "["]:
                taken = self._list(values.slice(at, ahead))
                ahead = ahead * 2 if taken == ahead else 64
            if not taken:
                self.chunk(values[at].as_py())
            at += taken or 1

    def _list(self, values: pa.Array) -> int:
        """The objects of a list that end in chunks between two of which the reader stands: how many chunks they take, of those
        before the list's end. The reader is as before, then."""
        data = _text(values)
        at, kinds, odd, _ = _marks(data)
        at, kinds = at[~odd], kinds[~odd]
        up = (kinds == ord("{")) | (kinds == ord("["))
        depth = np.cumsum(np.where(up, 1, -1))
        within = int(np.append(np.flatnonzero(depth < 0), len(depth))[0])
        ends = np.flatnonzero((depth[:within] == 0) & (kinds[:within] == ord("}")))
        if not len(ends):
            return 0
        last = int(ends[-1]) + 1
        opened, closed = np.flatnonzero(up[:last] & (depth[:last] == 1)), np.flatnonzero(~up[:last] & (depth[:last] == 0))
        objects = kinds[opened] == ord("{")  # others are lists in the list
        texts = [data[a:b] for a, b in zip(at[opened[objects]].tolist(), (at[closed[objects]] + 1).tolist(), strict=True)]
        self.whole.append((self.name, self.part, texts))
        self.part += len(texts)
        return int(np.searchsorted(np.cumsum(pc.binary_length(values).to_numpy().astype(np.int64) + 1), at[last - 1] + 1)) + 1

    def chunk(self, text: str) -> None:
        if not self.base:
            if not self.inside and self.opens == ["{", "["]:  # mostly it is the next object of a list, whole and without braces of its own
                rest = text.lstrip(" \t\r\n,")
                if rest[:1] == "{" and rest.rfind("{") == 0 and "\\" not in rest and not rest.count('"') % 2 and rest.count("[") == rest.count("]"):
                    self.held.append(rest + "}")
                    self._give(True)
                    return
            text = self._begin(text)
            if text is None:
                return
        brackets, self.inside = _brackets(text + "}", self.inside)
        _follow(self.opens, brackets)
        self.held.append(text + "}")
        if not self.inside and len(self.opens) <= self.base:
            self._give(True)
            self.base = 0

    def _begin(self, text: str) -> str | None:
        """The rest of a chunk from the next object on, after the members' names before it; None if there is none."""
        at = 0
        if self.inside:
            rest = _REST.match(text)
            if not rest:
                return None
            at, self.inside = rest.end(), False
        for m in _TOKEN.finditer(text + "}", at):
            token = m[0]
            if token[0] == '"':
                if token[-1] == ":" and self.opens == ["{"]:
                    self.name = json.loads(token[:-1].rstrip())
                elif m.end() > len(text):
                    self.inside = True
            else:
                _follow(self.opens, token)
                if base := self._base():
                    self.base = base
                    self.opens.pop()
                    return text[m.start() :]
        return None

    def _give(self, ends: bool) -> None:
        self.out.append((*self.key, "object", self.name, self.part, self.begins, ends, "".join(self.held)))
        self.part, self.begins, self.held = self.part + 1, True, []

    def close(self) -> None:
        if self.held:
            self._give(False)
        self.out.append((*self.key, "name", self.name, None, None, None, None))


def _pieces(batches: Iterator[pa.RecordBatch], states: dict[tuple[str, str], tuple[bool, str]]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
    schema = pa.schema(list(zip([c.split()[0] for c in _PIECES.split(", ")], kinds, strict=True)))
    reader = None

    def rows() -> Iterator[pa.RecordBatch]:
        out, reader.out = reader.out, []
        whole, reader.whole = reader.whole, []
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], schema=schema)
        for name, part, texts in whole:
            same = [pa.repeat(pa.scalar(v, k), len(texts)) for v, k in zip((*reader.key, "object", name, True), (*kinds[:4], pa.bool_()), strict=True)]
            parts = pa.array(np.arange(part, part + len(texts)))
            yield pa.RecordBatch.from_arrays([*same[:4], parts, same[4], same[4], pa.array(texts, pa.binary()).cast(pa.string())], schema=schema)

    for key, texts in _by_range(batches):
        if reader is None or key != reader.key:
            if reader:
                reader.close()
                yield from rows()
            reader = _Reader(*key, *states[key])
        reader.chunks(texts)
        yield from rows()
    if reader:
        reader.close()
        yield from rows()


def document_objects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, name, value) of JSON documents: the objects that a member of each document's object is or lists, as JSON.

    Documents may have any size and layout; each is read by as many tasks as it has ranges of spark.sql.files.maxPartitionBytes.
    One object has to fit into a row. Members that are neither objects nor lists of objects are left out.
    """
    chunks = _chunks(spark, paths)
    ranges = cut(chunks.mapInArrow(_summaries, _RANGES), "coco-ranges")
    starts = ranges.groupBy("file").applyInArrow(_starts, "file string, start string, inside boolean, opens string")
    states = {(r.file, r.start): (r.inside, r.opens) for r in starts.collect()}  # a row for each range, as Spark's own list of splits has
    got = cut(chunks.mapInArrow(lambda b: _pieces(b, states), _PIECES), "coco-pieces", compression="zstd")
    ended = {(r.file, r.start): r.name for r in got.filter("kind = 'name'").collect()}  # again a row for each range
    named, last = [], {}
    for file, start in sorted(states):
        named.append((file, start, last.get(file)))
        last[file] = ended[file, start] or last.get(file)
    known = spark.createDataFrame(named, "file string, start string, before string")
    objects = got.filter("kind = 'object'").join(F.broadcast(known), ["file", "start"]).withColumn("name", F.coalesce("name", "before"))
    whole = objects.filter("begins and ends").select("file", "name", "value")
    return whole.unionByName(cut(_joined(objects.filter("not (begins and ends)")), "coco-joined"))


def _joined(pieces: DataFrame) -> DataFrame:
    """Objects from pieces: those of one object lie one after another, the last one ends it. A range has two at most."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["start"], r["part"]))
        out, held, name = [], [], None
        for r in rows:
            name = r["name"] if not held else name
            held.append(r["value"])
            if r["ends"]:
                out.append({"file": r["file"], "name": name, "value": "".join(held)})
                held = []
        return pa.Table.from_pylist(out, schema=pa.schema([("file", pa.string()), ("name", pa.string()), ("value", pa.string())]))

    return pieces.groupBy("file").applyInArrow(run, "file string, name string, value string")


def read_coco(
    spark: SparkSession, paths: str | list[str], *, image: str = IMAGE, annotation: str = ANNOTATION, category: str = CATEGORY, info: str = INFO, license_: str = LICENSE,
) -> Coco:
    """The tables of all documents below paths, each row with its document (src).

    Numbers may be written as strings. What isn't of a field's type is null; segmentation stays as it is (see rings). Other
    fields than the schemas' are left out: give a schema with them to keep them.
    """
    objects = document_objects(spark, paths)
    table = lambda name, schema: _fields(objects.filter(F.col("name") == name).withColumnRenamed("file", "src"), schema)
    return Coco(table("images", image), with_sides(table("annotations", annotation)), table("categories", category), table("info", info), table("licenses", license_))


def _fields(rows: DataFrame, schema: str) -> DataFrame:
    """(src, the schema's fields) of JSON objects (src, value).

    Objects whose fields are all of their types are parsed as such, the others as variants, whose parts are cast one by one.
    What is text in part is a variant in both, for it may be written as a number. What isn't JSON gives nulls. Of a name that
    stands twice the last one counts; an object that is cast gives nulls then.
    """
    fields = rows.sparkSession.createDataFrame([], schema).schema
    kinds = {f.name: f.dataType.simpleString() for f in fields}
    typed = {n: "variant" if "string" in k else k for n, k in kinds.items()}
    strict = ", ".join([*(f"`{n}` {k}" for n, k in typed.items()), "`__other` string"])
    parsed = rows.select("src", "value", F.from_json("value", strict, {"columnNameOfCorruptRecord": "__other", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}).alias("p"))
    other = F.col("p.__other").isNotNull()
    parsed = parsed.select("src", "p", F.when(other, F.try_parse_json("value")).alias("v"))
    plain = lambda n: F.try_variant_get(F.col(f"p.`{n}`"), "$", kinds[n]) if typed[n] != kinds[n] else F.col(f"p.`{n}`")
    found = (F.when(other, F.try_variant_get("v", f"$.{n}", k)).otherwise(plain(n)).alias(n) for n, k in kinds.items())
    # inline, for a join's filters on fields would otherwise go below the parsing and parse each row again
    return parsed.select("src", F.inline(F.array(F.struct(*found))))


def with_sides(annotations: DataFrame) -> DataFrame:
    """annotations with x, y, w and h instead of bbox."""
    return annotations.select("*", *(F.get("bbox", F.lit(k)).alias(c) for k, c in enumerate("xywh"))).drop("bbox")


def _listed(df: DataFrame | None, most: int) -> list[str]:
    if df is None:
        return []
    rows = [r.j for r in df.select(F.to_json(F.struct(*df.columns)).alias("j")).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} categories or licences: they stand in each document")
    return rows


def annotation_fields(annotations: DataFrame) -> DataFrame:
    """annotations with bbox instead of x, y, w, h."""
    if not {*"xywh"} <= set(annotations.columns):
        return annotations
    box = F.when(F.col("x").isNotNull(), F.array(*(F.col(c).cast("double") for c in "xywh")))
    return annotations.select(*(c for c in annotations.columns if c not in "xywh"), box.alias("bbox"))


def write_coco(coco: Coco, path: str, documents: int = 1, *, most_categories: int = 100_000, rows_a_file: int = 500_000, compression: str | None = None) -> None:
    """COCO documents below path, so many of them, each with the images and annotations of a range of image ids, in order, and
    all categories, licences and the info.

    A document of up to rows_a_file images and annotations is a file, written by one task, row by row. If one has more, each is
    a folder of files of about as many rows, each written by a task; one after another by name they are the document (as cat
    joins them, or zcat if compression is gzip), and read_coco reads them so. A compressed file is read by one task. Null fields
    are left out. An annotation whose image isn't there goes with the document of its image_id's range. No images and no
    annotations give no document. The tables' ids are counted before, so tables that aren't the same whenever they are made have
    to be written first.
    """
    drop = lambda df: None if df is None else df.drop("src")
    head = {
        "info": next(iter(_listed(drop(coco.info), 1)), "{}"), "licenses": "[" + ", ".join(_listed(drop(coco.licenses), most_categories)) + "]",
        "categories": "[" + ", ".join(_listed(drop(coco.categories), most_categories)) + "]",
    }
    opening = "{" + "".join(f'"{k}": {v},\n' for k, v in head.items()) + '"images": ['
    images, annotations = drop(coco.images), annotation_fields(drop(coco.annotations))
    keys = images.select(F.lit(0).alias("kind"), F.col("id").alias("image")).unionByName(annotations.select(F.lit(1).alias("kind"), F.col("image_id").alias("image")))
    row = lambda df, of, kind: df.select(F.col(of).alias("image"), F.lit(kind).alias("kind"), F.col("id").alias("id"), F.to_json(F.struct(*df.columns)).alias("value"))
    bounds = [] if documents == 1 else sorted({*(keys.agg(F.percentile_approx("image", [k / documents for k in range(1, documents)]).alias("b")).first().b or [])})
    document = F.when(F.col("image").isNull(), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("image")))) if bounds else F.lit(0)
    every = row(images, "id", 0).unionByName(row(annotations, "image_id", 1)).withColumn("document", document)
    keys = keys.withColumn("document", document)
    sizes = {(r.document, r.kind): r["count"] for r in keys.groupBy("document", "kind").count().collect()}  # two rows for each document
    totals: dict[int, int] = {}
    for (d, _), n in sizes.items():
        totals[d] = totals.get(d, 0) + n
    if not sizes:
        every.sparkSession.createDataFrame([], "value string").write.text(path, compression=compression)
    elif max(totals.values()) > rows_a_file:
        _write_files(every, _ends(keys, annotations, sizes, rows_a_file), opening, path, compression)
    else:
        ordered = every.repartitionById(documents, "document").sortWithinPartitions("kind", "image", "id")
        ordered.select("kind", "value").mapInArrow(lambda b: _document(b, opening), "value string").write.text(path, compression=compression)


def _document(batches: Iterator[pa.RecordBatch], opening: str) -> Iterator[pa.RecordBatch]:
    """The lines of a document of a task's rows (kind, value)."""
    line = lambda lines: pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    names, now, first = ("images", "annotations"), 0, True
    yield line([opening])
    for b in batches:
        lines = []
        for kind, value in zip(b["kind"].to_pylist(), b["value"].to_pylist(), strict=True):
            if kind != now:
                lines.append(f'],\n"{names[kind]}": [')
                now, first = kind, True
            lines.append(value if first else f",{value}")
            first = False
        yield line(lines)
    yield line(["]}" if now else '],\n"annotations": []}'])


def _ends(keys: DataFrame, annotations: DataFrame, sizes: dict[tuple[int, int], int], rows_a_file: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """For each (document, kind) the (image, id) that files of about so many rows end with, but for the last file. An image with
    more annotations than a file has ends by their ids."""
    files = [max((-(-n // rows_a_file) for (_, k), n in sizes.items() if k == kind), default=1) for kind in (0, 1)]
    cuts = lambda column, n: F.percentile_approx(column, [j / n for j in range(1, n)], max(10_000, 100 * n))
    found = [keys.filter(F.col("kind") == k).groupBy("document", "kind").agg(cuts("image", n).alias("ends")) for k, n in enumerate(files) if n > 1]
    ends = {(r.document, r.kind): Counter(r.ends or []) for df in found for r in df.collect()}
    crowded = {i: n for (_, kind), c in ends.items() for i, n in c.items() if kind and n > 1}
    ids = {}
    if crowded:
        own = annotations.filter(F.col("image_id").isin(*crowded)).groupBy("image_id").agg(cuts("id", max(crowded.values())).alias("ends"))
        ids = {r.image_id: sorted({*r.ends}) for r in own.collect()}
    return {(d, kind): [(i, e) for i in sorted(ends.get((d, kind), [])) for e in (*(ids.get(i, []) if kind else []), 2**63 - 1)] for d, kind in sizes}


def _write_files(rows: DataFrame, ends: dict[tuple[int, int], list[tuple[int, int]]], opening: str, path: str, compression: str | None) -> None:
    """Documents of rows (document, image, kind, id, value), each as a folder of files with the ends given.

    A file is a partition of its own. What stands before the first image and the first annotation is written with the first row
    of their first files, which have the least rows and so aren't empty. Each line ends in a brace, which the sink writes: a
    file's end is no other text.
    """
    between, groups = '],\n"annotations": [', sorted(ends)
    # which ends lie below a row is looked up in two steps, among the ends of stretches of them and in one of these
    firsts, stretches, coarse, at, n = [], [], [], [], 0
    for g in groups:
        step = max(1, isqrt(len(ends[g])))
        own = [ends[g][k : k + step] for k in range(0, len(ends[g]), step)] + [[]]
        firsts.append((n, step, len(stretches)))
        stretches += own
        coarse.append([x[-1] for x in own if len(x) == step])
        at.append(n)
        n += len(ends[g]) + 1
    struct = "array<array<struct<image:bigint,id:bigint>>>"
    known = lambda lists: F.array(*(F.array(*(F.struct(F.lit(i).cast("long").alias("image"), F.lit(e).cast("long").alias("id")) for i, e in x)) for x in lists)).cast(struct)
    numbers = lambda k: F.array(*(F.lit(x[k]) for x in firsts))
    below = lambda some: F.size(F.filter(some, lambda b: (b["image"] < F.col("image")) | ((b["image"] == F.col("image")) & (b["id"] < F.col("id")))))
    group = F.array_position(F.array(*(F.lit(2 * d + kind).cast("int") for d, kind in groups)), (2 * F.col("document") + F.col("kind")).cast("int")).cast("int") - 1
    some = rows.withColumn("group", group).withColumn("stretch", below(F.get(known(coarse), F.col("group"))))
    part = F.get(numbers(0), F.col("group")) + F.col("stretch") * F.get(numbers(1), F.col("group")) + below(F.get(known(stretches), F.get(numbers(2), F.col("group")) + F.col("stretch")))
    some = some.withColumn("part", part).select("document", "part", "kind", "image", "id", "value")

    before, marks = {}, []
    for k, (d, kind) in enumerate(groups):
        begun = kind and (d, 0) in ends
        before[at[k]] = (between if begun else opening + between if kind else opening) + "\n"
        if kind or (d, 1) not in ends:
            marks.append((d, (at[k + 1] if k + 1 < len(at) else n) - 1, 2, None, None, "]}" if kind else between + "]}"))
    every = some.unionByName(rows.sparkSession.createDataFrame(marks, some.schema))
    ordered = every.repartitionById(n, "part").sortWithinPartitions("document", "kind", "image", "id")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)) == 0
    openings = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))
    start = F.when(F.col("kind") == 2, "").when(first, F.coalesce(F.try_element_at(openings, F.col("part")), F.lit(",\n"))).otherwise(",\n")
    line = F.concat(start, F.col("value"))
    lines = ordered.select(F.col("document").alias(_FOLDER), F.substr(line, F.lit(1), F.length(line) - 1).alias("value"))
    lines.write.partitionBy(_FOLDER).text(path, compression=compression, lineSep="}")


def write_coco_lines(coco: Coco, path: str) -> None:
    """For datasets of any size: JSON lines of each table in folders of their names below path. Null fields are left out."""
    for name, df in coco._asdict().items():
        if df is not None:
            rows = annotation_fields(df) if name == "annotations" else df
            rows.drop("src").write.json(f"{path}/{name}")


def read_coco_lines(
    spark: SparkSession, path: str, *, image: str = IMAGE, annotation: str = ANNOTATION, category: str = CATEGORY, info: str | None = None, license_: str | None = None,
) -> Coco:
    """The tables of what write_coco_lines wrote; files are split among the tasks. info and licences are read if they have a
    schema; for the fields see read_coco."""

    def table(name: str, schema: str | None) -> DataFrame | None:
        return schema and _fields(spark.read.text(f"{path}/{name}").select(F.input_file_name().alias("src"), "value"), schema).drop("src")

    return Coco(table("images", image), with_sides(table("annotations", annotation)), table("categories", category), table("info", info), table("licenses", license_))
