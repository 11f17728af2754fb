"""Operator 1: main text of web pages by structure and nearest-URL page differencing.

A page becomes lines, one per block, in page order. The method takes two steps.

*Differencing*, on every page with a neighbour: pages are ordered by host and path, and of the two beside a page on
its host the one with the longer common path is taken (one without lines only if the other has none either). The
lines of both whole pages, menus included, are aligned by longest common subsequence. What the neighbour shares is
boilerplate so far; the *fresh* lines are the page's own. Where nearly all that may be text is shared (a mirrored
page), all of it counts as fresh.

*An exact check* against the structure follows, since menus differ between pages of a host and articles share
passages. Each line knows where it stands:

* *chrome*: inside navigation, page headers, footers, asides, forms, adverts, notices, comments (by tag,
  role, class or id); scripts, styles, comments of the markup and the head are no lines at all. Never text.
* *article*, *main*, *content*: inside an article, a main element, an element named as content. The first of these
  regions that holds fresh lines is the text, and what it shares with the neighbour comes back. Where no region
  holds fresh lines, the first one on the page is the text.
* *plain*: none of these. On pages without such a region the fresh lines are the text.

White space is what `str.split` splits on. Defined results: null and empty html give an empty text; a null
url is a host of its own; on a page alone on its host all lines are fresh; of pages with equal urls the id
orders; repeated rows come back repeated; unclosed elements end with the element around them, an unclosed
tag or script at the end of a page is dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewatch.llm.common import long_rows, partitions
from zonewatch.llm.neighbours import beside, cuts
from zonewatch.llm.urlrank import host_of, path_of

MIRROR = 0.9
PAIRS = 1_000_000  # pairs of equal lines of two pages up to which they are gone through one by one
REGIONS = ("article", "main", "content")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_WORDS = re.compile(r"[a-z]+")
RAW = frozenset("script style template noscript textarea title iframe svg math object canvas select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var img wbr picture".split())
CHROME_TAGS = frozenset("nav footer aside form dialog menu button fieldset head".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id values that mark what is not the article: fixed values.
CHROME_WORDS = frozenset("""ad ads advert adverts advertisement adsense sponsor sponsored promo promotion nav navbar navigation menu
breadcrumb breadcrumbs masthead footer sidebar cookie cookies consent gdpr newsletter subscribe signup login popup modal
overlay share sharing social related recommended comment comments disqus reply replies pagination pager skip copyright""".split())
#: The same, but only where no word of `CONTENT_WORDS` stands beside them.
WEAK_WORDS = frozenset("header banner notice notices alert legal disclaimer widget toolbar topbar aside form search tags meta".split())
CONTENT_WORDS = frozenset("article content post entry story main body text".split())
BLOCKS_OF_CONTENT = frozenset("div section td main".split())


def lines_of(source: str | None) -> list[tuple[str, str]]:
    """(kind, text) of every line with text; kind is chrome, article, main, content or plain."""
    if not source:
        return []
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # (tag, kind in force inside)
    parts: list[str] = []
    at, n = 0, len(source)

    def kind() -> str:
        return stack[-1][1] if stack else "plain"

    def add(text: str) -> None:
        parts.append(references.unescape(text) if "&" in text else text)

    def end_line() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append((kind(), text))

    while at < n:
        m = _TAG.search(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at:m.start()])
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            continue
        name, closing, attributes = name.lower(), (m.group(1) or m.group(4)) == "/", m.group(3) or m.group(6) or ""
        if m.group(5) and not m.group().endswith(">"):
            break
        if name in RAW and not closing:
            if name not in ("svg", "math", "iframe", "textarea") or not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{name}[\s/>]", re.I).search(source, at)
                at = n if end is None else source.find(">", end.start()) + 1 or n
            continue
        if name == "br" or name == "hr":
            parts.append(" ")
            continue
        if name in VOID:
            continue
        if name in INLINE:
            if not closing and attributes and _chrome(name, attributes, kind()):
                end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                if end is not None and "<" + name not in source[at:end.start()].lower():
                    at = end.end()  # an inline element of that kind: leave out what it holds
            continue
        end_line()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        if name in ("li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == name:
            stack.pop()
        if name == "body":
            stack.clear()
        stack.append((name, _kind_inside(name, attributes, kind())))
    end_line()
    return out


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): (a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(text)}


def _chrome(name: str, attributes: str, around: str) -> bool:
    if name in CHROME_TAGS or (name == "header" and around == "plain"):
        return True
    if not attributes.strip():
        return False
    a = _attributes(attributes)
    if a.get("role", "").lower() in CHROME_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return True
    words = set(_WORDS.findall(f"{a.get('class', '')} {a.get('id', '')}".lower()))
    return name not in ("body", "html", "article", "main") and bool(
        words & CHROME_WORDS or (words & WEAK_WORDS and not words & CONTENT_WORDS)) or (
        name == "article" and bool(words & {"comment", "comments", "related", "teaser", "promo", "ad", "sponsored"}))


def _kind_inside(name: str, attributes: str, around: str) -> str:
    if around == "chrome" or _chrome(name, attributes, around):
        return "chrome"
    if name == "article":
        return "article"
    if around in ("article", "main"):
        return around
    a = _attributes(attributes) if attributes.strip() else {}
    if name == "main" or a.get("role", "").lower() == "main":
        return "main"
    if around == "plain" and name in BLOCKS_OF_CONTENT and (
            a.get("itemprop", "").lower() == "articlebody"
            or set(_WORDS.findall(f"{a.get('class', '')} {a.get('id', '')}".lower())) & {"article", "content", "post", "entry", "story"}):
        return "content"
    return around


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in `a` of a longest common subsequence with `b`."""
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    rest = min(len(a), len(b)) - head
    tail = next((i for i in range(rest) if a[-1 - i] != b[-1 - i]), rest)
    out = {*range(head), *range(len(a) - tail, len(a))}
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    often = Counter(b)
    if len(a) > 1 and sum(often[x] for x in a) > PAIRS:  # lines that repeat a lot: halve `a`, and cut `b` where it fits best
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[:half - 1:-1], b[::-1])[::-1]))
        return out | {head + i for i in common_lines(a[:half], b[:cut])} | {head + half + i for i in common_lines(a[half:], b[cut:])}
    return out | {head + i for i in _chained(a, b)}


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of a longest common subsequence of `a` with each beginning of `b`, a bit per line of `b`."""
    where = defaultdict(list)
    for j, x in enumerate(b):
        where[x].append(j)

    def bits(x: str) -> int:
        flags = np.zeros(len(b), np.uint8)
        flags[where[x]] = 1
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")

    masks = {x: bits(x) for x in set(a) if x in where}
    whole = free = (1 << len(b)) - 1
    for x in a:
        met = free & masks.get(x, 0)
        free = ((free + met) | (free - met)) & whole
    taken = np.unpackbits(np.frombuffer((free ^ whole).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate([[0], np.cumsum(taken, dtype=np.int64)])


def _chained(a: list[str], b: list[str]) -> set[int]:
    where = defaultdict(list)
    for j, x in enumerate(b):
        where[x].append(j)
    tails: list[int] = []
    chain: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):  # from behind, so that a line of `a` is used once
            k = bisect_left(tails, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chain.append(link)
            else:
                tails[k], chain[k] = j, link
    out, link = set(), chain[-1] if chain else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def fresh_lines(own: list[tuple[str, str]], other: list[tuple[str, str]]) -> list[int]:
    """Positions of the lines that may be text and are not shared with the nearest page; all if nearly all are shared."""
    may = [i for i, (kind, _) in enumerate(own) if kind != "chrome"]
    if not other:
        return may
    shared = common_lines([t for _, t in own], [t for _, t in other])
    fresh = [i for i in may if i not in shared]
    same = len(may) - len(fresh)
    if same >= MIRROR * len(may) and same >= MIRROR * sum(kind != "chrome" for kind, _ in other):
        return may
    return fresh


def checked(own: list[tuple[str, str]], fresh: list[int]) -> list[str]:
    """The page's text: the region named by its fresh lines, whole; the fresh lines where there is no region."""
    regions = [r for r in REGIONS if any(kind == r for kind, _ in own)]
    if not regions:
        return [own[i][1] for i in fresh]
    named = {own[i][0] for i in fresh}
    region = next((r for r in regions if r in named), regions[0])
    return [t for kind, t in own if kind == region]


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _outlined(pages: DataFrame) -> DataFrame:
    """Per page its order key and all of its lines: where they stand, and their text."""
    id_type = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [lines_of(source) for source in batch.column(4).to_pylist()]
            yield pa.record_batch([*batch.columns[:4], pa.array([[k for k, _ in x] for x in lines], pa.list_(pa.string())),
                                   pa.array([[t for _, t in x] for x in lines], pa.list_(pa.string()))],
                                  names=["page_id", "url", "host", "path", "kinds", "lines"])

    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    return rows.mapInArrow(run, f"page_id {id_type}, url string, host string, path string, kinds array<string>, lines array<string>")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html)."""
    long_rows(pages.sparkSession)
    id_type = dict(pages.dtypes)["page_id"]
    key = F.concat(host_of(F.col("url")), F.lit("\x01"), path_of(F.col("url")), F.lit("\x01"),
                   F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0"))
    spans = cuts(pages.select(key.alias("key_")), "key_", 3 * partitions(pages.sparkSession))
    outlined = _outlined(pages).withColumn("key_", key)
    dealt = beside(outlined, "key_", spans, ["url"]).select("page_id", "url", "host", "path", "kinds", "lines", "range_", "order_")

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        """Each own row with the rows before and behind it in its range."""
        before = row = None
        for behind in rows:
            if row is not None:
                yield before, row, behind
            before, row = row, behind
        if row is not None:
            yield before, row, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        ids, urls, texts = [], [], []
        for before, row, behind in walk(rows):
            page_id, url, host, path, kinds, lines, here, order = row
            if order != 1:
                continue
            near = [x for x in (before, behind) if x is not None and x[6] == here and x[2] == host and x[5]]
            near.sort(key=lambda x: -_common_prefix(path, x[3]))  # a tie goes to the page before
            own = list(zip(kinds, lines))
            text = " ".join(checked(own, fresh_lines(own, list(zip(near[0][4], near[0][5])) if near else [])))
            ids.append(page_id)
            urls.append(url)
            texts.append(text)
            if len(ids) == 1000:
                yield _answer(ids, urls, texts, arrow_id)
                ids, urls, texts = [], [], []
        yield _answer(ids, urls, texts, arrow_id)

    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    return dealt.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")


def _answer(ids: list, urls: list, texts: list, arrow_id: pa.DataType) -> pa.RecordBatch:
    return pa.record_batch([pa.array(ids, arrow_id), pa.array(urls, pa.string()), pa.array(texts, pa.string()),
                            pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
