"""Legacy ARC archives, converted to WARC; WARC archives written and read by Spark."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut

# fixed values: the fields of an ARC record's header line, by version of the file
ARC_FIELDS = {1: ("url", "ip", "date", "type", "length"), 2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length")}
# fixed value: an empty gzip member, which ends each file that write_warc writes
_TAIL = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for URLs


class Entry(NamedTuple):
    """One record of an ARC file: a document, or the version block, with its version."""

    url: str
    ip: str
    date: str
    kind: str
    location: str | None
    payload: bytes
    version: int | None = None


def _field(value: str | None) -> str:
    """A header field: without blanks or line ends, for they part the fields; '-' if there is nothing."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "") or "-"


def arc_file(entries: list[Entry], version: int) -> bytes:
    """An ARC file: the version block, then each record's header line, payload and a line end."""
    names = " ".join({
        1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
        2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
    }[version])
    block = f"{version} 0 fieldlens\n{names}\n".encode()
    first = {
        1: f"filedesc://pages.arc 0.0.0.0 19700101000000 text/plain {len(block)}\n",
        2: f"filedesc://pages.arc 0.0.0.0 19700101000000 text/plain 200 - - 0 pages.arc {len(block)}\n",
    }[version]
    out, at = [first.encode() + block + b"\n"], 0
    for e in entries:
        at += len(out[-1])
        middle = f" 200 - {_field(e.location)} {at} pages.arc" if version == 2 else ""
        out.append(f"{_field(e.url)} {_field(e.ip)} {e.date} {_field(e.kind)}{middle} {len(e.payload)}\n".encode() + e.payload + b"\n")
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[Entry]:
    """The records of an ARC file, the version block among them, which says how the header lines after it are to be read.

    A payload is as long as its header line declares, whatever it holds. Blank lines between records are passed over. A
    header line with another number of fields than the version's, a length that isn't a number, and a payload cut short
    raise ValueError, with the offset.
    """
    at, version, begun = 0, 1, False
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].rstrip(b"\r").decode()
        if not line:
            at = end + 1
            continue
        got = line.split(" ")
        block = not begun and line.startswith("filedesc:")
        fields = ARC_FIELDS[(1 if len(got) == len(ARC_FIELDS[1]) else 2) if block else version]
        if len(got) != len(fields) or not got[-1].isdigit():
            raise ValueError(f"ARC header line of {len(got)} fields at {at}")
        head, size = dict(zip(fields, got, strict=True)), int(got[-1])
        payload = data[end + 1 : end + 1 + size]
        if len(payload) < size:
            raise ValueError(f"ARC record at {at} is cut short")
        at = end + 1 + size
        if block:
            version = int(payload.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
        begun = True
        location = None if head.get("location", "-") == "-" else head["location"]
        yield Entry(head["url"], head["ip"], head["date"], head["type"], location, payload, version if block else None)


def digest32(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """(HTTP head with the blank line that ends it, payload) of a captured document; without a head, all of it is payload."""
    end = content.find(b"\r\n\r\n") + 4 if content.startswith(b"HTTP/") else 0
    return (content[:end], content[end:]) if end > 3 else (b"", content)


def record_id(entry: Entry) -> str:
    """The same entry has the same identifier in every conversion."""
    return _named(entry.url, entry.date, entry.location, digest32(http_parts(entry.payload)[1]))


def _named(url: str, date: str, location: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{url}|{date}|{location}|{digest}')}>"


def warc_date(date: str) -> str:
    """A 14-digit ARC date (shorter ones are filled up) as a WARC timestamp."""
    d = (date + "19700101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_type(entry: Entry) -> str:
    """What an ARC record is in WARC: the version block is warcinfo, what has an HTTP head a response, anything else a resource."""
    return "warcinfo" if entry.version is not None else "response" if http_parts(entry.payload)[0] else "resource"


class Target(NamedTuple):
    """The response that a revisit refers to."""

    location: str | None
    url: str


def warc_record(entry: Entry, target: Target | None) -> bytes:
    """The equivalent WARC record, without the two line ends after it.

    With a target the record is a revisit of it, which keeps its HTTP head, and of its payload the length and digest only. A
    version block keeps its text as the warcinfo's content and its file's name as WARC-Filename.
    """
    kind, (head, payload) = warc_type(entry), http_parts(entry.payload)
    body, digest = entry.payload if target is None else head, digest32(payload)
    lines = ["WARC/1.0", f"WARC-Type: {kind if target is None else 'revisit'}", f"WARC-Record-ID: {record_id(entry)}", f"WARC-Date: {warc_date(entry.date)}"]
    if kind == "warcinfo":
        lines.append(f"WARC-Filename: {entry.url.removeprefix('filedesc:').lstrip('/')}")
    else:
        lines += [f"WARC-Target-URI: {entry.url}", f"WARC-IP-Address: {entry.ip}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
        lines.append(f"WARC-Source-Location: {entry.location or '-'}")
    if target is not None:
        named = _named(target.url, entry.date, target.location, digest)
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {named}"]
        lines += [f"WARC-Refers-To-Target-URI: {target.url}", f"WARC-Refers-To-Date: {warc_date(entry.date)}", f"WARC-Refers-To-Source-Location: {target.location or '-'}"]
    lines += [f"WARC-Block-Digest: sha1:{digest32(body)}", f"Content-Type: {'application/http; msgtype=response' if head else entry.kind}"]
    return "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode() + body


def read_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers by lower-case name, content) of each record of a WARC file, by declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at {at}")
        pairs = [line.split(":", 1) for line in data[at:end].decode().split("\r\n")[1:]]
        head = {k.lower(): v.strip() for k, v in pairs}
        size = int(head["content-length"])
        content = data[end + 4 : end + 4 + size]
        if len(content) < size:
            raise ValueError(f"WARC record at {at} is cut short")
        at = end + 4 + size
        yield head, content


def _captured(html: bytes) -> bytes:
    return b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html) + html


def convert(df: DataFrame, *, version: int = 2) -> DataFrame:
    """(record binary): WARC records of the rows (key, url, date, payload string, target struct<key, url>).

    Each task writes its rows as ARC files in memory, of 64 rows each, every page behind an HTTP head as crawlers keep it, and
    converts them record by record: a warcinfo of each file, and a record for each row. A row without a target, or that is
    its own, is a response.
    """

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 64):
                keys, urls, dates, payloads, targets = (batch.column(k).slice(a, 64).to_pylist() for k in range(5))
                ids = [None if k is None else str(k) for k in keys]
                entries = [Entry(u, "0.0.0.0", d, "text/html", k, _captured((p or "").encode())) for k, u, d, p in zip(ids, urls, dates, payloads, strict=True)]
                info, *read = read_arc(arc_file(entries, version))
                back = [warc_record(info, None)]
                for e, key, t in zip(read, ids, targets, strict=True):
                    to = None if t is None or t["key"] is None or str(t["key"]) == key else Target(str(t["key"]), _field(t["url"]))
                    back.append(warc_record(e._replace(location=key), to))  # version 1 has no location
                yield pa.RecordBatch.from_arrays([pa.array(back, pa.binary())], names=["record"])

    return df.select("key", "url", "date", "payload", "target").mapInArrow(run, "record binary")


def write_warc(records: DataFrame, path: str, *, file_bytes: int = 16 << 20) -> None:
    """The records (record binary) as WARC files below path, each record a gzip member of its own.

    Files have about file_bytes, which a task holds at once. Spark's text sink writes and commits them, a row a file, so path
    may be on any file system that Spark can write to, and a lost task leaves nothing; its names end in .txt all the same.
    It ends a row by a fixed separator, here an empty gzip member, in which no record is.
    """

    def pack(batches):
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for record in batch.column(0):
                held.append(gzip.compress(record.as_py() + b"\r\n\r\n", 6, mtime=0))
                size += len(held[-1])
                if size >= file_bytes:
                    yield _file(held)
                    held, size = [], 0
        if held:
            yield _file(held)

    files = records.select("record").mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.mode("append").option("maxRecordsPerFile", 1).options(lineSep=_TAIL.decode("latin-1"), encoding="ISO-8859-1").text(path)


def _file(members: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["value"])


_SCANNED = (
    ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("location", pa.string()), ("refers_to", pa.string()),
    ("refers_to_id", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("content", pa.binary()),
)


def _scanned(head: dict, content: bytes) -> tuple:
    """One record's row. What a record has with it is measured again, and has to agree with what its header declares."""
    own = lambda name: None if head.get(name, "-") == "-" else head[name]
    kind, block, declared = head["warc-type"], own("warc-block-digest"), own("warc-payload-digest")
    payload = http_parts(content)[1] if head.get("content-type", "").startswith("application/http") else content
    size = int(head.get("warc-payload-length", len(payload)))
    if kind == "revisit":
        digest = (declared or "").removeprefix("sha1:")
    else:
        digest = digest32(payload)
        if (declared or "sha1:" + digest, size) != ("sha1:" + digest, len(payload)):
            raise ValueError(f"record {head['warc-record-id']}: digest or length isn't that of its payload")
    if block and block != "sha1:" + (digest32(content) if kind == "revisit" or len(payload) < len(content) else digest):
        raise ValueError(f"record {head['warc-record-id']}: digest isn't that of its content")
    return kind, head["warc-record-id"], head.get("warc-target-uri"), head["warc-date"], own("warc-source-location"), own("warc-refers-to-source-location"), own("warc-refers-to"), digest, size, payload


def gzip_members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """What each member of a gzip file holds, one at a time; a member cut short raises ValueError."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            fed = view[at : at + step]
            if not fed:
                raise ValueError("a gzip member is cut short")
            parts.append(member.decompress(fed))
            at += len(fed) - len(member.unused_data)
        yield b"".join(parts)


def scan_warc(spark, path: str) -> DataFrame:
    """The records of all WARC files below path: type, id, location, what a revisit refers to, digest, length, content.

    The content is the payload, without an HTTP head. Digest and length are computed from it; a revisit, which has none,
    gives those that it declares. A file is one row of a task; those of write_warc are of a bounded size.
    """
    names = [n for n, _ in _SCANNED]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_SCANNED)], names=names)

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                records = chain.from_iterable(map(read_warc, gzip_members(data))) if data[:2] == b"\x1f\x8b" else read_warc(data)
                for head, content in records:
                    rows.append(_scanned(head, content))
                    if len(rows) == 200:
                        yield table(rows)
                        rows = []
                yield table(rows)

    schema = ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'binary' if n == 'content' else 'string'}" for n in names)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, schema)


def pages_to_warc(
    df: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0,
    date: str = "19700101000000", version: int = 2, broadcast_groups: int = 500_000,
) -> DataFrame:
    """Writes a WARC record for each page below path by way of ARC, and returns the pages' records as read back.

    Of pages with equal payloads of at least least_bytes, that with the largest id is the response and the others revisit
    it; smaller payloads are all responses. Null html is an empty payload; very long pages go whole. A null or blank URL is
    written as '-'. Null ids come before all others, and are read back as null; rows that repeat the largest id are
    responses too. No pages give no records. The id must have no blanks as text, and not be '-'. Other columns are ignored.

    Payloads are equal if their SHA-256 and lengths are. Each task sends a digest's largest id only, and the responses of
    repeated payloads go to the pages up to broadcast_groups of them; beyond, both are shuffled by digest.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    base = df.select(
        F.col(id_col).alias("key"), F.col(url_col).alias("url"), payload.alias("payload"), F.octet_length(payload).alias("size"),
    ).withColumn("sha", F.unhex(F.sha2("payload", 256)))
    groups = base.filter(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.max(F.struct("key", "url")).alias("target"), F.count("*").alias("n"))
    first = cut(groups.filter("n > 1").select("sha", "size", "target"), "warc-first")
    first = F.broadcast(first) if first.count() <= broadcast_groups else first.hint("merge")
    write_warc(convert(base.join(first, ["sha", "size"], "left").withColumn("date", F.lit(date)), version=version), path)
    return scan_warc(df.sparkSession, path).filter("record_type in ('response', 'revisit')")
