"""Main text of web pages: line differences between near pages, with markup rules as their guard."""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Elements whose text is never shown.
SILENT = frozenset("head title noscript template svg math iframe object canvas audio video map".split())
#: Elements whose text never belongs to the main text.
DROPPED = SILENT | frozenset("nav header footer aside form button select option textarea input label menu dialog figcaption".split())
#: Words of class, id and role that mark the same, where the name is made of these alone and of words of layout.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion promotions banner banners nav navbar navigation menu menus "
    "menubar breadcrumb breadcrumbs pagination pager header masthead topbar toolbar footer sidebar complementary contentinfo search searchbox cookie cookies "
    "consent gdpr notice notices disclaimer popup modal overlay dialog newsletter subscribe subscription signup login share sharing sharebar social related recommended "
    "recommendations trending comment comments commentlist discussion disqus reply replies skiplink outbrain taboola toc".split()
)
LAYOUT = frozenset(
    "site page main global top bottom left right side bar box block wrap wrapper container widget area section list item links link text inner outer content "
    "primary secondary module panel row col column group holder unit slot zone form button buttons icons bg js el the mobile desktop sticky fixed".split()
)
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figure h1 h2 h3 h4 h5 h6 hgroup hr html li "
    "main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Where a line stands: in an article, in a main element, in neither, or in what markup rules out.
ARTICLE, MAIN, BODY, RULED = range(4)
#: By how much more text another zone takes the place of articles.
TEASER = 2
RANGE_BYTES, MAX_RANGES = 32 << 20, 20_000
DIRECT_BITS = 1 << 23
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<!\[CDATA\[|\]\]>|<[!?][^<>]*>", re.S | re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][\w:-]*)((?:[^"'<>]|"[^"<]*"|'[^'<]*'|["'])*+)>""")
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!-)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_CUT = re.compile(r"<[a-zA-Z/!][^<>]*\Z")

#: A line: its text, its zone and a checksum of the tags around it.
Line = tuple[str, int, int]


def _dropped(name: str, attributes: str, inside: bool) -> bool:
    """inside: within an article, whose own header is part of it."""
    if name in DROPPED:
        return not (inside and name in ("header", "figcaption"))
    if not attributes or name in ("html", "body"):
        return False
    if _HIDDEN.search(attributes):
        return True
    if name not in BLOCKS:  # what stands in a line belongs to it
        return False
    marks = {w for m in _MARK.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().split() for w in _marks(n)}
    return bool(marks) and not (inside and marks <= {"header", "masthead"})


@lru_cache(maxsize=10_000)
def _marks(name: str) -> frozenset[str]:
    """The marks that a name is made of; none if it has a word that is neither mark nor layout, as in
    ``ad-hoc`` or ``search-results``."""
    parts = [w for w in re.split(r"[_-]+", name) if w]
    if "".join(parts) in MARKS:
        return frozenset(["".join(parts)])
    found = MARKS.intersection(parts)
    return frozenset(found) if found and LAYOUT.union(MARKS).issuperset(parts) else frozenset()


def lines_of(page: str) -> list[Line]:
    """All lines of a page that can be shown, those that markup rules out too. An element ends
    with its own end tag or that of an element around it; white space in a block becomes one
    space; comments, scripts and styles leave nothing behind."""
    page = _CUT.sub("", _RAW.sub("", page))
    stack: list[tuple[str, bool, int]] = []  # open elements: name, whether dropped, checksum of the tags so far
    open_: Counter[str] = Counter()
    out: list[Line] = []
    shown: list[str] = []  # text of the block so far
    ruled: list[str] = []  # the same inside a dropped element
    at = dropped = silent = tags = 0
    depth = {"article": 0, "main": 0}

    def end() -> None:
        block = ruled if dropped else shown
        line = " ".join(html.unescape("".join(block)).split())
        block.clear()
        if line:
            out.append((line, RULED if dropped else ARTICLE if depth["article"] else MAIN if depth["main"] else BODY, tags))

    def close() -> None:
        nonlocal dropped, silent, tags
        name, was, _ = stack.pop()
        open_[name] -= 1
        silent -= name in SILENT
        if was:
            end()
            dropped -= 1
        if name in depth and not dropped:
            depth[name] -= 1
        tags = stack[-1][2] if stack else 0

    for tag in _TAG.finditer(page):
        block = ruled if dropped else shown
        if not silent:
            block.append(page[at : tag.start()])
        at = tag.end()
        name = tag[2].lower()
        if name in BLOCKS or name in DROPPED:
            end()
        elif name == "br":
            block.append(" ")
        if tag[1]:
            if open_[name]:
                while stack[-1][0] != name:
                    close()
                close()
        elif name not in VOID and not tag[3].endswith("/"):
            if name in ("p", "li") and stack and stack[-1][0] == name:  # their end tags may be left out
                close()
            drop = not dropped and _dropped(name, tag[3], depth["article"] > 0)
            if name in depth and not dropped and not drop:
                depth[name] += 1
            dropped += drop
            silent += name in SILENT
            open_[name] += 1
            tags = zlib.crc32(name.encode(), tags)
            stack.append((name, bool(drop), tags))
    if not silent:
        (ruled if dropped else shown).append(page[at:])
    end()
    return out


def _bit_rows(a: list, b: list, keep: bool) -> tuple[int, list[int]]:
    """The last row of a longest-common-subsequence table, one bit for each element of ``b`` (a
    zero where the length grows), and with ``keep`` all rows."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hits = row & where.get(x, 0)
        row = (row + hits | row - hits) & full
        if keep:
            rows.append(row)
    return row, rows


def _lengths(row: int, n: int) -> np.ndarray:
    """Of a row: the length for each number of elements of ``b``, 0 to n."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list, b: list) -> set[int]:
    """The places in ``a`` of a longest common subsequence of the two. What both begin and end
    with goes first, then what only one of them has. A table of over DIRECT_BITS is halved
    (rows of ``a`` from both ends), so memory stays in proportion to the lines."""
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    top = 0
    while top < high - low and a[-1 - top] == b[-1 - top]:
        top += 1
    found = {*range(low), *range(len(a) - top, len(a))}
    both = set(a[low : len(a) - top]) & set(b[low : len(b) - top])
    places = [i for i in range(low, len(a) - top) if a[i] in both]
    x, y = [a[i] for i in places], [z for z in b[low : len(b) - top] if z in both]
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i, j, k, n = todo.pop()
        if i == j or k == n:
            continue
        if (j - i) * (n - k) > DIRECT_BITS and j - i > 1:
            mid = (i + j) // 2
            ahead = _lengths(_bit_rows(x[i:mid], y[k:n], False)[0], n - k)
            back = _lengths(_bit_rows(x[mid:j][::-1], y[k:n][::-1], False)[0], n - k)[::-1]
            cut = k + int(np.argmax(ahead + back))
            todo += [(i, mid, k, cut), (mid, j, cut, n)]
            continue
        rows = _bit_rows(x[i:j], y[k:n], True)[1]
        full, at = (1 << (n - k)) - 1, n - k - 1
        for row in range(j - i - 1, -1, -1):
            before = rows[row - 1] if row else full
            # a zero bit: the length grows there; go left while this row's does not
            while at >= 0 and rows[row] >> at & 1:
                at -= 1
            if at < 0:
                break
            if before >> at & 1:
                found.add(places[i + row])
                at -= 1
    return found


def main_text(lines: list[Line], other: list[Line] | None) -> tuple[str, int, int]:
    """(text, lines shared with the near page, lines that only this took out).

    Lines (with the tags around them) that the near page has too, in the same order, are
    taken out, and what markup rules out goes. Then the zone with most text is the main text: all
    lines in articles, those in a main element or those in neither. Articles are a guard: their
    lines stay though the near page has them, and they are the main text unless another zone
    has over TEASER times as much, as where an article is a teaser beside the text. If no line
    would be left the page is a copy of its neighbour in all that counts, and stays whole."""
    shared = common_lines([(x[0], x[2]) for x in lines], [(x[0], x[2]) for x in other]) if other else set()

    def chosen(taken: set[int]) -> list[int]:
        zones = {zone: [i for i, x in enumerate(lines) if x[1] == zone and (zone == ARTICLE or i not in taken)] for zone in (ARTICLE, MAIN, BODY)}
        size = {zone: sum(len(lines[i][0]) for i in own) * (TEASER if zone == ARTICLE else 1) for zone, own in zones.items()}
        return zones[max(zones, key=lambda zone: (size[zone], -zone))]

    kept = chosen(shared) or chosen(set())
    left_out = sum(x[1] == lines[kept[0]][1] for x in lines) - len(kept) if kept else 0
    return "\n".join(lines[i][0] for i in kept), len(shared), left_out


def _shared_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _part(url: str, part: str) -> Column:
    return F.coalesce(F.try_parse_url(F.col(url), F.lit(part)), F.lit(""))


def keyed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(key, page_id, url, html): the key sorts by host, path, url, id and html."""
    content = F.lpad(F.hex(F.xxhash64(F.coalesce(F.col(html_col), F.lit("")))), 16, "0")
    key = F.concat_ws("\0", _part(url_col, "HOST"), _part(url_col, "PATH"), F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit("")), content)
    return pages.select(key.alias("key"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))


def range_cuts(keys: DataFrame, rows: int, parts: int) -> list[str]:
    """At most ``parts`` - 1 keys that cut the table into ranges of about equal size, from about
    20 keys for each range."""
    thin = max(1, rows // (20 * parts))
    picked = sorted(r.key for r in keys.filter(F.pmod(F.xxhash64("key"), F.lit(thin)) == 0).select("key").distinct().toLocalIterator())
    return sorted(set(picked[:: max(1, -(-len(picked) // parts))][1:]))


def _content(key: str) -> str:
    return key[-16:]


def neighbours_over_cuts(keys: DataFrame, cuts: list[str]) -> dict[str, list[int]]:
    """For each range the last page before it that differs from its first one, and the first
    page after it that differs from its last one: key -> ranges it goes to besides its own.
    Four keys come to the driver for each range: the first and last of its first (last)
    content and of the content next to it."""
    number = _range_number(cuts)
    runs = keys.select("key", number("key").alias("part")).groupBy("part", F.substring("key", -16, 16).alias("content"))
    runs = runs.agg(F.min("key").alias("low"), F.max("key").alias("high"))
    up, down = Window.partitionBy("part").orderBy("low"), Window.partitionBy("part").orderBy(F.desc("high"))
    first = runs.withColumn("n", F.row_number().over(up)).filter("n <= 2").select("part", "n", F.col("low").alias("key"), F.lit(True).alias("first"))
    last = runs.withColumn("n", F.row_number().over(down)).filter("n <= 2").select("part", "n", F.col("high").alias("key"), F.lit(False).alias("first"))
    firsts: dict[int, list[str]] = {}
    lasts: dict[int, list[str]] = {}
    for r in first.union(last).orderBy("part", "first", "n").toLocalIterator():
        (firsts if r.first else lasts).setdefault(r.part, []).append(r.key)
    goes: dict[str, list[int]] = {}
    order = sorted(firsts)
    for ranges, own, others in ((order, firsts, lasts), (order[::-1], lasts, firsts)):
        seen: list[str] = []  # the nearest key so far and the nearest of another content
        for part in ranges:
            for key in seen:
                if _content(key) != _content(own[part][0]):
                    goes.setdefault(key, []).append(part)
                    break
            found = [*others[part], *seen]
            seen = [found[0], *[k for k in found if _content(k) != _content(found[0])][:1]]
    return goes


def _range_number(cuts: list[str]):
    @F.pandas_udf("int")
    def number(keys: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, k) for k in keys], dtype="int32")

    return number


@dataclass
class _Run:
    """Pages of one content that follow each other: the paths of the first and the last, the
    lines, and path and ids of those whose text is asked for."""

    host: str
    content: str
    first: str
    last: str
    lines: list[Line]
    rows: list[tuple[str, pa.RecordBatch]] = field(default_factory=list)


def _texts(run: _Run, before: _Run | None, after: _Run | None) -> list[tuple]:
    near = [x if x and x.host and x.host == run.host else None for x in (before, after)]
    made: dict[int, tuple] = {}
    out = []
    for path, ids in run.rows:
        x, y = (-1 if n is None else _shared_start(path, p) for n, p in zip(near, (before and before.last, after and after.first)))
        which = 0 if x >= y else 1
        if which not in made:
            made[which] = main_text(run.lines, near[which] and near[which].lines)
        out.append((ids, *made[which]))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", parts: int | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared, n_removed) for each page: the blocks of its main
    text, joined by line feeds, in the order of the page; how many of its lines the nearest page
    has too, and how many lines went for this alone (markup would have kept them).

    Pages are sorted by host and path; the nearest page is that neighbour of the same host, of
    another html, with which the path shares more (ties: the one before). So the pages are dealt
    by ranges of the key, and each range gets the pages next to it as well: the result does not
    depend on the number of ranges (``parts``; by default by the bytes of html), and a host with
    very many pages is spread over tasks. Null html is the empty page; a page with a null or
    broken url has no neighbour. Repeated rows come out as often as they came in, and a copy is
    no neighbour of its like. A very long page is read once, its tags and lines in linear memory.
    An empty table gives an empty one.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = keyed(pages, id_col, url_col, html_col)
    keys = materialise(rows.select("key", F.octet_length("html").cast("long").alias("n")), "page-keys")  # one scan for the plan, one for the texts
    size = keys.agg(F.count("*").alias("rows"), F.sum("n").alias("bytes")).first()
    if parts is None:
        parts = min(MAX_RANGES, max(pages.sparkSession.sparkContext.defaultParallelism, (size.bytes or 0) // RANGE_BYTES))
    cuts = range_cuts(keys.select("key"), size.rows, parts)
    goes = neighbours_over_cuts(keys.select("key"), cuts) if cuts else {}

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        """The page's own range, then (below zero) those to which it is only shown."""
        return pd.Series([[bisect_right(cuts, k), *(-1 - g for g in goes.get(k, ()))] for k in keys])

    dealt = (
        rows.withColumn("place", F.explode(places("key")))
        .select(F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("part"), (F.col("place") < 0).alias("shown"), "key", "page_id", "url", "html")
        .repartitionById(len(cuts) + 1, F.col("part"))
        .sortWithinPartitions("key")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: _Run | None = None
        now: _Run | None = None
        for batch in small_batches(batches, "html"):
            done = []
            for i, (key, shown, page) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "shown", "html")))):
                host, path, content = (*key.split("\0", 2)[:2], _content(key))
                if not now or (now.host, now.content) != (host, content):
                    fresh = _Run(host, content, path, path, lines_of(page or ""))
                    if now:
                        done += _texts(now, before, fresh)
                        now.rows.clear()
                    before, now = now, fresh
                now.last = path
                if not shown:
                    now.rows.append((path, batch.slice(i, 1).select(["page_id", "url"])))
            yield from _emit(done)
        if now:
            yield from _emit(_texts(now, before, None))

    return dealt.select("key", "shown", "page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_shared long, n_removed long")


def _emit(rows: list[tuple[pa.RecordBatch, str, int, int]]) -> Iterator[pa.RecordBatch]:
    if rows:
        keys = pa.Table.from_batches([r[0] for r in rows]).combine_chunks()
        texts = [r[1] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [keys.column(0).combine_chunks(), keys.column(1).combine_chunks(), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in (map(len, texts), [r[2] for r in rows], [r[3] for r in rows]))],
            ["page_id", "url", "text", "n_chars", "n_shared", "n_removed"],
        )
