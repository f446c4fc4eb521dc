"""Main text of web pages: structure first, then line differencing against the page of the nearest URL on the host."""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut

# fixed values: elements and attribute words of the parts of a page that are not its article
SKIP = frozenset("nav aside footer form script style noscript template button select option textarea iframe object svg canvas dialog menu datalist head title".split())
CRUFT = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar side widget menu menubar nav navbar navigation breadcrumb breadcrumbs toc pagination pager skip footer header masthead topbar toolbar "
    "comment comments commentlist disqus respond response responses reply replies share sharing social related recommended newsletter subscribe signup login search hidden".split()
)
CRUFT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
) | (SKIP - {"button", "select", "option", "svg", "canvas", "object"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of these ends an open p.
_CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head", "title"}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORDS = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")


# fixed values: words that say no more about a part than that it is one
_PLAIN = frozenset(
    "area bar block box button buttons card cards container form group inner item items links list outer post posts section slot stories story thread threads unit wrap wrapper reader readers "
    "response responses site user".split()
)
_ADS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
_SIZE = re.compile(r"[0-9]+(x[0-9]+)?")


def _cruft(tag: str, attrs: list, main: bool) -> bool:
    """Whether an element is a part of another kind. Inside an article one word of a name isn't enough: all have to say so."""
    if tag in SKIP:
        return True
    for name, value in attrs:
        if name in ("class", "id") and value and not (main and tag in _HEADINGS):
            named = [frozenset(_WORDS.split(_CAMEL.sub(r"\1-\2", n).lower())) - {""} for n in value.split()]
            if any(n & CRUFT and (not main or _only_cruft(n)) for n in named):
                return True
        if name == "role" and (value or "").lower() in CRUFT_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


def _doubtful(tag: str, attrs: list) -> bool:
    """Whether a block inside an article has a name with a word of another part, but not only such: its lines are in doubt."""
    if tag not in BLOCKS or tag in _HEADINGS or tag in ("body", "html", "article", "main"):
        return False
    named = (frozenset(_WORDS.split(_CAMEL.sub(r"\1-\2", n).lower())) for name, value in attrs if name in ("class", "id") and value for n in value.split())
    return any(words & CRUFT for words in named)


def _only_cruft(words: frozenset) -> bool:
    """Whether all words of a name are those of other parts, or plain; numbers and sizes say nothing."""
    rest = {w for w in words - CRUFT - _PLAIN if not _SIZE.fullmatch(w)}
    return not rest or rest == {"content"} and bool(words & _ADS)


_NO_COMMENT, _COMMENT_END = re.compile("<!---?>"), re.compile("--!?>")
_TAG = re.compile(r"<[a-zA-Z/!?]")
DOUBT = 2


class Lines(HTMLParser):
    """The page's blocks in order: (text, within the article, within a part that is not the article). Within the article is 0
    or 1, or DOUBT in a part of it that may be another one by its name."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # tag, main, cruft, as they hold inside
        self.places: dict[str, list[int]] = {}  # of the open elements, by tag
        self.walls: list[int] = []  # places of the open blocks
        self.text: list[str] = []
        self.blocks: list[tuple[str, int, bool]] = []

    def at(self) -> tuple[int, bool]:
        return self.open[-1][1:] if self.open else (0, False)

    def end_block(self) -> None:
        if self.text:
            if words := "".join(self.text).split():
                self.blocks.append((" ".join(words), *self.at()))
            self.text = []

    def push(self, tag: str, main: int, cruft: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.walls.append(len(self.open))
        self.open.append((tag, main, cruft))

    def drop_to(self, k: int) -> None:
        while len(self.open) > k:
            tag, _, _ = self.open.pop()
            self.places[tag].pop()
            if tag in BLOCKS:
                self.walls.pop()

    def pop_to(self, k: int) -> None:
        self.end_block()
        self.drop_to(k)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag in _CLOSES_P and self.walls and self.open[self.walls[-1]][0] == "p":
            self.pop_to(self.walls[-1])
        if tag in ("li", "tr", "td", "th", "dd", "dt", "option") and self.open and self.open[-1][0] == tag:
            self.pop_to(len(self.open) - 1)
        main, cruft = self.at()
        into = tag in ("article", "main") or any((n, (v or "").lower()) in (("role", "main"), ("itemprop", "articlebody")) for n, v in attrs)
        away = tag not in ("body", "html", "article", "main") and (_cruft(tag, attrs, main) or tag == "header" and not main)
        if tag in BLOCKS or away != cruft and away:
            self.end_block()
        if tag not in VOID:
            self.push(tag, DOUBT if main and _doubtful(tag, attrs) else main or int(into and not cruft), cruft or away)

    def handle_endtag(self, tag: str) -> None:
        """Closes the last open element of the tag; what is no block isn't closed from within a later block."""
        if not self.places.get(tag):
            return
        k = self.places[tag][-1]
        if tag in BLOCKS or not self.walls or self.walls[-1] < k:
            if tag in BLOCKS or self.open[k][2] != (self.open[k - 1][2] if k else False):
                self.pop_to(k)
            else:
                self.drop_to(k)

    def parse_html_declaration(self, i: int) -> int:
        """As browsers do: a declaration that is no doctype or comment ends at the next >, whatever it holds."""
        if self.rawdata.startswith("<![", i):
            end = self.rawdata.find(">", i + 3)
            return end + 1 if end >= 0 else -1
        return super().parse_html_declaration(i)

    def parse_comment(self, i: int, report: bool = True) -> int:
        """As browsers do: a comment without an end goes on to the page's end."""
        if (empty := _NO_COMMENT.match(self.rawdata, i)) or (empty := _COMMENT_END.search(self.rawdata, i + 4)):
            return empty.end()
        return len(self.rawdata)

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][0] in ("script", "style")):
            self.text.append(data)


def lines_of(html: str | None) -> list[tuple[str, int, bool]]:
    """What is begun behind the last >, but not ended, is no element."""
    html, parser = html or "", Lines()
    begun = _TAG.search(html, html.rfind(">") + 1)
    parser.feed(html[: begun.start()] if begun else html)
    parser.close()
    parser.end_block()
    return parser.blocks


#: Pairs of equal lines up to which they are listed, and bits of a table of rows that is kept whole.
PAIRS, BITS = 1 << 20, 1 << 29


def shared_lines(one: list[int], two: list[int]) -> set[int]:
    """Positions in one of a longest common subsequence with two.

    Equal beginnings and ends go first, and lines that only one side has. With few pairs of equal lines their longest chain
    is sought; with many, rows of the table of lengths, as bits of integers, are, and where they would fill the memory, one
    is halved at the best border in two. Time grows with the pairs or with a 64th of the table; memory is bounded.
    """
    return {i for i in _shared(list(enumerate(one)), list(two))}


def _shared(one: list[tuple[int, int]], two: list[int]) -> list[int]:
    head = 0
    while head < min(len(one), len(two)) and one[head][1] == two[head]:
        head += 1
    tail = 0
    while tail < min(len(one), len(two)) - head and one[-1 - tail][1] == two[-1 - tail]:
        tail += 1
    out = [i for i, _ in one[:head] + one[len(one) - tail :]]
    left, right = one[head : len(one) - tail], two[head : len(two) - tail]
    both = {x for _, x in left} & set(right)
    left, right = [p for p in left if p[1] in both], [x for x in right if x in both]
    if not left:
        return out
    n, m = Counter(x for _, x in left), Counter(right)
    if sum(n[x] * m[x] for x in both) <= PAIRS:
        return out + _chain(left, right)
    if len(left) * len(right) <= BITS or len(left) == 1:
        return out + _by_rows(left, right)
    half = len(left) // 2
    before, after = _lengths([x for _, x in left[:half]], right), _lengths([x for _, x in left[:half - 1 : -1]], right[::-1])
    cut_at = max(range(len(right) + 1), key=lambda j: before[j] + after[len(right) - j])
    return out + _shared(left[:half], right[:cut_at]) + _shared(left[half:], right[cut_at:])


def _chain(one: list[tuple[int, int]], two: list[int]) -> list[int]:
    """By the pairs of equal lines (Hunt and Szymanski)."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(two):
        where.setdefault(x, []).append(j)
    tails: list[int] = []
    chain: list[tuple] = []
    for i, x in one:
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chain.append(link)
            else:
                tails[k], chain[k] = j, link
    out, link = [], chain[-1]
    while link:
        out.append(link[0])
        link = link[1]
    return out


def _rows(one: list[int], two: list[int]):
    """Rows of the table of lengths, a line of one each: bit j is 0 where the length grows from two[:j] to two[:j + 1]."""
    where: dict[int, int] = {}
    for j, x in enumerate(two):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(two)) - 1
    row = full
    for x in one:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(one: list[int], two: list[int]) -> list[int]:
    """The length of the longest common subsequence of one with two[:j], for each j."""
    row = (1 << len(two)) - 1
    for row in _rows(one, two):  # noqa: B007  the last one counts
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(two) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(two)]
    return [0, *np.cumsum(bits == 0).tolist()]


def _by_rows(one: list[tuple[int, int]], two: list[int]) -> list[int]:
    rows, out, j = list(_rows([x for _, x in one], two)), [], len(two)
    for i in range(len(one) - 1, -1, -1):
        above = rows[i - 1] if i else (1 << len(two)) - 1
        below = (1 << j) - 1
        # line i adds to two[:j] if the row above has fewer zeros below j; its partner is the last zero that came or moved
        if ((~rows[i] & below).bit_count()) > ((~above & below).bit_count()):
            out.append(one[i][0])
            # the shortest two[:j'] that still has this length with line i
            need, low, high = (~rows[i] & below).bit_count(), 1, j
            while low < high:
                mid = (low + high) // 2
                if (~rows[i] & ((1 << mid) - 1)).bit_count() >= need:
                    high = mid
                else:
                    low = mid + 1
            j = low - 1
    return out


def _address(url) -> tuple:
    """Host and path columns of a URL; what is no URL has the host ''."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _bounds(keys: DataFrame, n: int, a_part: int = 100) -> list[tuple]:
    """The n - 1 keys (host, path, url) that part the keys into about equal shares, from a sample of about a_part a share."""
    total = keys.count()
    if not total or n < 2:
        return []
    found = sorted(tuple(r) for r in keys.select("host", "path", "key").sample(min(1.0, a_part * n / total), seed=42).collect())
    return sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []


def _compared(reps: DataFrame, n: int) -> DataFrame:
    """(host, path, key, before, after): the lines of the page of the nearest URL on either side of each URL on its host.

    reps (host, path, key, sig, hashes) has each content once on a host, so the two always differ from the URL's own pages;
    a URL of several contents is compared by the one with the least sig. Each task gets the pages that border on its own.
    """
    pages = cut(reps.groupBy("host", "path", "key").agg(F.min_by("hashes", "sig").alias("hashes")), "op5-urls")
    bounds = _bounds(pages, n)

    def deal(batches):
        for b in batches:
            keys = zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bisect_right(bounds, k) for k in keys], pa.int32())], names=[*b.schema.names, "part"])

    kind = "host string, path string, key string, hashes array<long>"
    dealt = pages.mapInArrow(deal, f"{kind}, part int").withColumn("guest", F.lit(False))
    one, order = F.struct("host", "path", "key", "hashes"), F.struct("host", "path", "key")
    ends = cut(dealt.groupBy("part").agg(F.min_by(one, order).alias("first"), F.max_by(one, order).alias("last")), "op5-ends")
    parts = sorted(r.part for r in ends.select("part").collect())
    pairs = list(zip(parts, parts[1:], strict=False))
    for name, moves in (("last", pairs), ("first", [(b, a) for a, b in pairs])):
        to = reps.sparkSession.createDataFrame(moves, "part int, to int")
        dealt = dealt.unionByName(ends.join(F.broadcast(to), "part").select(f"{name}.*", F.col("to").alias("part"), F.lit(True).alias("guest")))
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("host", "path", "key").drop("part")

    def neighbours(batches):
        near = lambda x, y: y["hashes"] if y and y["host"] == x["host"] else None
        last, this = None, None
        types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["host", "path", "key", "before", "after"])

        for batch in batches:
            rows = []
            for page in batch.to_pylist():
                if this and not this["guest"]:
                    rows.append((this["host"], this["path"], this["key"], near(this, last), near(this, page)))
                last, this = this, page
            yield table(rows)
        if this and not this["guest"]:
            yield table([(this["host"], this["path"], this["key"], near(this, last), None)])

    return dealt.mapInArrow(neighbours, "host string, path string, key string, before array<long>, after array<long>")


def main_text(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", partitions: int | None = None, broadcast_contents: int = 200_000) -> DataFrame:
    """(id, url, text, n_chars, n_shared) of each page: its article's blocks, white space as single spaces, one to a line.

    A page's lines are aligned with those of the pages of the nearest URLs before and after it on its host, by host, path and
    URL (a longest common subsequence each). Pages with the same lines on a host are copies: they stand at the least of their
    URLs, aren't compared with one another, and all get the same result; nor are different contents of one URL compared.
    The result doesn't depend on the tasks, and neither many copies nor a large host meet in one task. Pages are parsed
    twice, for the hashes of their lines and for their text; what the lines share goes to the texts for up to
    broadcast_contents contents, and beyond that both are shuffled. n_shared counts the lines deleted as shared. On a page
    that marks no article, what is neither shared with its neighbours nor in a part of another kind is the text. Inside an
    article or main element a shared line is the article's own, but for parts whose name has a word of another kind beside
    its own (DOUBT): there what the neighbours share goes, unless they share half of the article's other lines too, as almost copies
    do. Pages at different URLs that are almost copies and mark no article do share their article's lines.
    Null html is empty and gives an empty text; null and malformed URLs count as one host without a name. Malformed markup is
    read as browsers do, and very long pages whole. Repeated rows stay. No rows give no rows. Other columns are ignored,
    whatever their names.
    """
    spark = df.sparkSession
    key_type = df.schema[id_col].dataType.simpleString()
    host, path = _address(F.col(url_col))
    base = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def hashed(blocks: list) -> tuple[bytes, list[int]]:
        hashes = [xxhash.xxh64_intdigest(text) - (1 << 63) for text, _, _ in blocks]
        return hashlib.blake2b(array("q", hashes).tobytes(), digest_size=16).digest(), hashes

    def marked(blocks: list) -> bool:
        return any(main and not cruft for _, main, cruft in blocks)

    def parse_lines(batches):
        for batch in batches:
            got = [hashed(lines_of(x)) for x in batch.column(3).to_pylist()]
            found = [pa.array([s for s, _ in got], pa.binary()), pa.array([h for _, h in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *found], names=["host", "path", "key", "sig", "hashes"])

    def parse_text(batches):
        """places are those of the lines; those of lines that stay even if they are shared are negative (-1 - place)."""
        for batch in batches:
            got = [lines_of(x) for x in batch.column(3).to_pylist()]
            marks = [marked(blocks) for blocks in got]
            kept = [[i for i, (_, main, cruft) in enumerate(blocks) if not cruft and (main or not mark)] for blocks, mark in zip(got, marks, strict=True)]
            texts = [[blocks[i][0] for i in own] for blocks, own in zip(got, kept, strict=True)]
            places = [[-1 - i if mark and blocks[i][1] != DOUBT else i for i in own] for blocks, own, mark in zip(got, kept, marks, strict=True)]
            sigs = [hashed(blocks)[0] for blocks in got]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array(sigs, pa.binary()), pa.array(texts, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32()))],
                names=["id", "url", "host", "sig", "lines", "places"],
            )

    def align(batches):
        for batch in batches:
            rows = batch.to_pylist()
            found = [sorted(set().union(*(shared_lines(r["hashes"], r[near]) for near in ("before", "after") if r[near]))) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["host", "sig", "shared"])

    def finish(batches):
        for batch in batches:
            texts, counts = [], []
            for lines, places, shared in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                shared = set(shared or ())
                sure = [-1 - i for i in places if i < 0]
                gone = set() if sure and 2 * len(shared.intersection(sure)) >= len(sure) else shared.intersection(places)
                texts.append("\n".join([x for x, i in zip(lines, places, strict=True) if i not in gone]))
                counts.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array(counts, pa.int64())],
                names=["id", "url", "text", "n_chars", "n_shared"],
            )

    addressed = base.select("host", "path", F.coalesce("url", F.lit("")).alias("key"), "html")
    seen = addressed.mapInArrow(parse_lines, "host string, path string, key string, sig binary, hashes array<long>").filter(F.size("hashes") > 0)
    least = F.min(F.struct("path", "key", "hashes")).alias("r")
    reps = cut(seen.groupBy("host", "sig").agg(least).select("host", "sig", "r.*"), "op5-contents")
    near = reps.drop("path").join(_compared(reps, n).drop("path"), ["host", "key"]).select("host", "sig", "hashes", "before", "after")
    shared = cut(near.mapInArrow(align, "host string, sig binary, shared array<int>").filter(F.size("shared") > 0), "op5-shared")
    shared = F.broadcast(shared) if shared.count() <= broadcast_contents else shared.hint("merge")
    parsed = base.select("id", "url", "host", "html").mapInArrow(parse_text, f"id {key_type}, url string, host string, sig binary, lines array<string>, places array<int>")
    met = parsed.join(shared, ["host", "sig"], "left").select("id", "url", "lines", "places", "shared")
    out = met.mapInArrow(finish, f"id {key_type}, url string, text string, n_chars long, n_shared long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
