"""Main text of web pages: structural blocks, less the lines that the page with the nearest URL shares."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import saved

CELLS = 1 << 26  # of the table of an alignment whose rows are kept at once, a bit each
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = set("aside audio button canvas datalist dialog footer form head header iframe input label math menu nav noscript object option script select style svg template textarea title video".split())
LISTS = ("ul", "ol", "menu", "dl", "table")
_CELL = {"td", "th", "tr", "tbody", "tfoot"}
#: Elements that end unclosed where one of these starts; all but p may hold blocks, and lists with such elements inside.
IMPLIED = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": _CELL, "th": _CELL, "tr": {"tr", "tbody", "tfoot"}, "option": {"option"}}
MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|notices?|alert|menu|nav|navbar|navigation|sidebar|breadcrumbs?|footer|header|masthead|comments?|replies|disqus|share|social|related|newsletter|subscribe|signup|login|popup|modal|widget)(?:$|[\s_-])")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[bool, str]] = []
        self.held: list[str] = []
        self.within, self.skip, self.wrapper = 0, "", False
        self.open: list[str] = []  # elements around the current place, outside a skip
        self.inner: Counter = Counter()  # elements open inside the skipped one, and itself

    def flush(self) -> None:
        if self.held and (text := " ".join("".join(self.held).split())):
            self.blocks.append((self.within > 0, text))
        self.held = []

    def handle_starttag(self, tag, attrs):
        if self.skip:
            ends = tag in IMPLIED.get(self.skip, ()) and (self.skip == "p" or not any(self.inner[x] for x in LISTS))
            if not ends and not (self.wrapper and tag in ("article", "main")):
                self.inner[tag] += tag not in VOID
                return
            self.skip = ""
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.held.append(" ")
        if tag in ("article", "main"):
            self.within += 1
        named = dict(attrs)
        if tag in VOID:
            return
        marked = tag not in ("html", "body", "main") and (named.get("role") in ROLES or "hidden" in named or MARKED.search(f"{named.get('class') or ''} {named.get('id') or ''}".lower()))
        if marked or tag in SKIPPED:
            self.within -= tag == "article"
            self.skip, self.inner = tag, Counter([tag])
            self.wrapper = tag == "form" and not marked  # a form around the whole page
        else:
            if tag in IMPLIED and self.open and self.open[-1] == tag:
                self.open.pop()
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        if not self.skip and tag in BLOCKS:
            self.flush()
        elif not self.skip and tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag):
        if self.skip:
            if self.inner[tag]:
                self.inner[tag] -= 1
                if not self.inner[self.skip]:
                    self.skip = ""
                return
            if tag not in self.open:
                return
            self.skip = ""  # what was left unclosed ends with its parent
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        if tag in BLOCKS:
            self.flush()
        if tag in ("article", "main"):
            self.within = max(0, self.within - 1)

    def handle_data(self, data):
        if not self.skip:
            self.held.append(data)


def blocks(html: str | None) -> tuple[list[str], bool]:
    """The page's text blocks in order, and whether the page marks them as its article.

    Where the page has an article or main element with text, its blocks alone; else all that no menu, header, footer,
    sidebar, notice, advert, form, script, style or comment holds.
    """
    page = _Page()
    page.feed(html or "")
    page.close()
    page.flush()
    own = [t for inside, t in page.blocks if inside]
    return (own, True) if own else ([t for _, t in page.blocks], False)


def _rows(x: list, y: list) -> Iterator[int]:
    """Bit rows of the alignment of x and y, one a line of y: a prefix of x has as many common lines as it has bits that are 0."""
    places: dict = {}
    for i, v in enumerate(x):
        places[v] = places.get(v, 0) | 1 << i
    full = v = (1 << len(x)) - 1
    for item in y:
        u = v & places.get(item, 0)
        v = (v + u | v - u) & full
        yield v


def _lengths(x: list, y: list) -> np.ndarray:
    """How many lines each prefix of x has in common with y."""
    last = (1 << len(x)) - 1
    for last in _rows(x, y):
        pass
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(x) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(x)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _common(x: list, y: list) -> list[int]:
    if not x or not y:
        return []
    if len(x) * len(y) > CELLS and len(y) > 1:
        half = len(y) // 2
        cut = int(np.argmax(_lengths(x, y[:half]) + _lengths(x[::-1], y[half:][::-1])[::-1]))
        return _common(x[:cut], y[:half]) + [cut + i for i in _common(x[cut:], y[half:])]
    rows, found, i, j = list(_rows(x, y)), [], len(x), len(y)
    while i and j:
        if rows[j - 1] >> i - 1 & 1:
            i -= 1
        else:
            j -= 1
            if not (j and not rows[j - 1] >> i - 1 & 1):
                i -= 1
                found.append(i)
    return found[::-1]


def shared_lines(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence of a and b. Long alignments are halved until their bit rows take some MB."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    found = _common(a[lo : len(a) - hi], b[lo : len(b) - hi])
    return [*range(lo), *(lo + i for i in found), *range(len(a) - hi, len(a))]


def url_key(url: str | None) -> tuple[str, str]:
    """Host and path segments; a URL that can't be split is a path without a host."""
    try:
        parts = urlsplit((url or "").strip())
        return (parts.hostname or "").lower(), "/".join(x for x in parts.path.split("/") if x)
    except ValueError:
        return "", url or ""


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    uid = TaskContext.get().partitionId() << 36
    for batch in batches:
        urls, pages = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for lo in range(0, len(pages), 256):
            rows = []
            for url, html in zip(urls[lo : lo + 256], pages[lo : lo + 256]):
                lines, marked = blocks(html)
                host, path = url_key(url)
                rows.append((uid, host, path, lines, [_hash(x) for x in lines] if lines else None, marked))
                uid += 1
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(rows)), batch.column(1).slice(lo, len(rows)), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.bool_())))], ["page_id", "url", "uid", "host", "path", "lines", "keys", "marked"])


def _near(a: str, b: str | None) -> tuple[int, int]:
    """Common leading segments, then common leading characters: more is nearer."""
    if b is None:
        return -1, -1
    x, y = a.split("/"), b.split("/")
    k = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    return k, next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for uid, marked, path, keys, p_path, p_keys, n_path, n_keys in zip(*(c.to_pylist() for c in batch.columns)):
            other = p_keys if _near(path, p_path) >= _near(path, n_path) else n_keys
            if other is not None and (found := shared_lines(keys, other)):
                out.append((uid, [] if marked or len(found) == len(keys) else found, len(found)))
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int32()), pa.int64()))], ["uid", "gone", "n_shared"])


def _read(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kind = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, uid bigint, host string, path string, lines array<string>, keys array<bigint>, marked boolean"
    return saved(rows.withColumn("url", F.col("url").cast("string")).mapInArrow(_parse, kind), "blocks", codec="zstd")


def _aligned(read: DataFrame) -> DataFrame:
    """uid, gone (places of lines), n_shared of pages that share a line with their nearer neighbour. Only keys of lines are dealt."""
    sort = ["host", "path", "uid"]
    open_ = read.filter("keys is not null").select("uid", "host", "path", "keys", "marked")
    dealt = saved(open_.repartitionByRange(*sort).sortWithinPartitions(*sort).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "by_url")
    before, n = [], 0
    for r in dealt.groupBy("part").agg(F.count("*").alias("k"), F.min("at").alias("least")).orderBy("part").collect():  # a row a partition
        before.append((r["part"], n - r["least"]))
        n += r["k"]
    shift = read.sparkSession.createDataFrame(before, "part int, shift bigint")
    placed = dealt.join(F.broadcast(shift), "part").select("uid", "host", "path", "keys", "marked", (F.col("at") + F.col("shift")).alias("at"))
    beside = lambda by, c: placed.select((F.col("at") + by).alias("at"), "host", F.col("path").alias(f"{c}_path"), F.col("keys").alias(f"{c}_keys"))
    trio = placed.join(beside(1, "p"), ["at", "host"], "left").join(beside(-1, "n"), ["at", "host"], "left")
    return trio.select("uid", "marked", "path", "keys", "p_path", "p_keys", "n_path", "n_keys").mapInArrow(_differ, "uid bigint, gone array<int>, n_shared bigint")


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text (the article's blocks joined by one newline) and n_deleted lines.

    Pages are sorted by host and URL path and dealt by range, so a large host is many partitions. Each page is aligned
    with its nearer neighbour of the same host (more common path segments, then characters; the earlier one on ties);
    lines in their longest common subsequence go. Where all of a page's lines are shared (a copy of its neighbour, or a
    part of it) they stay, and so do those inside an article element: quoted passages and licence lines belong to the
    text. Lines meet the places of those that go only where a page loses some.
    Null or unreadable html: empty text. A null url has no host; such pages are neighbours. Repeated rows are each
    returned, other columns are not read, an empty table gives an empty result.
    """
    read = _read(pages)
    gone = saved(_aligned(read).filter(F.size("gone") > 0).select("uid", "gone"), "gone")
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    lines = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(stay)
    return read.join(gone, "uid", "left").select("page_id", "url", F.array_join(lines, "\n").alias("text"), F.when(F.col("gone").isNotNull(), F.size("gone")).otherwise(0).cast("long").alias("n_deleted"))


def alignment(pages: DataFrame) -> DataFrame:
    """page_id, url, n_shared and n_deleted of pages that share lines with their nearer neighbour: what main_text goes by."""
    read = _read(pages)
    return read.select("page_id", "url", "uid").join(_aligned(read), "uid").select("page_id", "url", "n_shared", F.size("gone").cast("long").alias("n_deleted"))


def report(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_deleted")
