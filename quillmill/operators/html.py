"""Pages from HTML: text pieces, highlights, links, metadata, dates.

HTML is parsed once per page, on Arrow batches, by the standard library's parser feeding a
small tree. What can be said with built-ins (links by expression, titles, the junk cut) is also
here as column expressions, which need no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime
from functools import cached_property
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from dateutil import parser as dateparser
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType, TimestampType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quillmill.functions import text as T
from quillmill.functions import urls
from quillmill.functions.dates import dates_in

# Elements whose own text shows.
VISIBLE = frozenset((
    "body", "div", "span", "h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "a", "abbr", "acronym", "address", "big", "cite", "code", "del",
    "dfn", "em", "img", "ins", "kbd", "q", "s", "samp", "small", "strike", "strong", "sub", "sup", "tt", "var", "b", "u", "i", "center", "dl", "dt",
    "dd", "ol", "ul", "li", "fieldset", "form", "label", "legend", "table", "caption", "tbody", "tfoot", "thead", "tr", "th", "td", "article", "aside",
    "canvas", "details", "figcaption", "footer", "header", "hgroup", "menu", "nav", "output", "ruby", "section", "summary", "time", "mark",
))
# Elements whose short texts are highlights, and those that hold texts together.
SEMANTIC = frozenset(("span", "em", "strong", "dfn", "a", "big", "b", "u", "i", "mark", "figcaption", "q"))
GROUPING = frozenset(("p", "div", "article", "aside", "figcaption", "main", "nav", "section"))
HIGHLIGHT_WORDS, MIN_PIECE, JUNK_CUTOFF = 5, 2, 0.3

#: Elements without content, and what an element ends when it opens.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = frozenset("table ul ol dl select body div article section".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def nodes(self) -> Iterator[Node]:
        """This element and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[tuple[str, Node]]:
        """Each text below, with its element, in document order."""
        stack: list[tuple[Node, int]] = [(self, 0)]
        while stack:
            node, at = stack.pop()
            while at < len(node.children):
                child = node.children[at]
                at += 1
                if isinstance(child, Node):
                    stack.append((node, at))
                    node, at = child, 0
                else:
                    yield child, node

    def within(self, tags: frozenset[str]) -> Node | None:
        """The nearest element of these tags, itself included."""
        node: Node | None = self
        while node is not None and node.tag not in tags:
            node = node.parent
        return node


class TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _close_for(self, tag: str) -> None:
        closes = SIBLINGS.get(tag, frozenset()) | ({"p"} if tag in BLOCKS else set())
        node = self.at
        while closes and node.parent is not None:
            if node.tag in closes:
                self.at = node.parent
                if tag not in SIBLINGS:
                    return
            elif node.tag in LIMITS:
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._close_for(tag)
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        node = Node(tag, own, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def title_of(root: Node) -> str | None:
    found = next((n for n in root.nodes() if n.tag == "title"), None)
    return None if found is None else "".join(s for s, _ in found.strings()).strip()


def text_pieces(root: Node) -> tuple[list[tuple[str, Node]], list[str]]:
    """Visible texts of over MIN_PIECE characters with their elements, and highlights: short texts of semantic elements."""
    pieces, highlights = [], []
    for string, node in root.strings():
        if node.tag in VISIBLE:
            t = T.repair(string).strip()
            if t and node.tag in SEMANTIC and len(t.split()) <= HIGHLIGHT_WORDS:
                highlights.append(t)
            if len(t) > MIN_PIECE:
                pieces.append((t, node))
    return pieces, highlights


def group_text(pieces: list[tuple[str, Node]]) -> list[str]:
    """Neighbouring pieces with one grouping element, by identity, joined by a space."""
    out: list[list[str]] = []
    last: object = object()
    for t, node in pieces:
        group = node.within(GROUPING)
        if group is last and out:
            out[-1].append(t)
        else:
            out.append([t])
        last = group
    return [g for g in (" ".join(ts).strip() for ts in out) if g]


def cut_junk(text: list[str], highlights: list[str], cutoff: float = JUNK_CUTOFF) -> tuple[list[str], list[str]]:
    """Texts longer than cutoff of the longest, and the highlights that one of them holds."""
    longest = max(map(len, text), default=0)
    kept = [t for t in text if len(t) / longest > cutoff] if longest else []
    return kept, sorted({h for h in highlights if any(h in t for t in kept)})


def metadata_of(root: Node) -> dict[str, list[str]]:
    """Contents of meta tags by name, http-equiv, property or itemprop. Of runs of one key a later run replaces an earlier one."""
    out: dict[str, list[str]] = {}
    last = None
    for n in (n for n in root.nodes() if n.tag == "meta"):
        key = n.attrs.get("name") or n.attrs.get("http-equiv") or n.attrs.get("property") or n.attrs.get("itemprop")
        content = n.attrs.get("content")
        if key and content:
            values = [k.strip() for k in content.split(",") if k] if key == "keywords" else [content]
            name = key.lower().replace(".", "_")
            out[name] = (out[name] if key == last and name in out else []) + values
        last = key
    return out


def links_of(root: Node, base: str) -> list[str]:
    """Targets of the page's anchors, absolute and without fragment, each once, in order."""
    out = {}
    for n in root.nodes():
        if n.tag == "a" and n.attrs.get("href"):
            try:
                out[urldefrag(urljoin(base, n.attrs["href"]))[0]] = None
            except ValueError:
                continue
    return list(out)


def main_text(root: Node) -> str:
    """The text of the article: that of an <article> element, or else of the grouping element with most text outside links."""
    article = next((n for n in root.nodes() if n.tag == "article"), None)
    if article is None:
        weight: dict[int, int] = {}
        by_id: dict[int, Node] = {}
        for s, node in root.strings():
            if node.tag in VISIBLE and node.within(frozenset("a")) is None and (g := node.within(GROUPING)) is not None:
                g = g.parent.within(GROUPING) or g if g.tag == "p" and g.parent is not None else g
                weight[id(g)], by_id[id(g)] = weight.get(id(g), 0) + len(s.strip()), g
        article = by_id[max(weight, key=lambda k: weight[k])] if weight else root
    return " ".join(t for t, _ in text_pieces(article)[0])


def date_of(root: Node, now: datetime, fuzzy: bool = True) -> datetime | None:
    """The latest past date of the page's time elements; without any, of the dates in its text."""

    def read(x: str) -> datetime | None:
        try:
            return dateparser.parse(x, fuzzy=True, default=now.replace(hour=0, minute=0, second=0, microsecond=0)).replace(tzinfo=None)
        except (ValueError, OverflowError):
            return None

    times = [n.attrs.get("datetime") or "".join(s for s, _ in n.strings()) for n in root.nodes() if n.tag == "time"]
    past = [d for d in map(read, times) if d is not None and d < now]
    if not past and fuzzy:
        past = [d for d in dates_in(" ".join(s for s, _ in root.strings()), now) if d <= now]
    return max(past, default=None)


def scrape_soup(root: Node) -> tuple[list[str], list[str], str | None]:
    """Title and kept text groups, highlights, title."""
    pieces, highlights = text_pieces(root)
    text, marks = cut_junk(group_text(pieces), highlights)
    title = title_of(root)
    return ([title] if title else []) + text if text else [], marks, title


def scrape_readability(root: Node) -> tuple[list[str], list[str], str | None]:
    text = main_text(root)
    return [text] if text else [], [], title_of(root)


def scrape_newspaper(root: Node) -> tuple[list[str], list[str], str | None]:
    title, text = title_of(root) or "", main_text(root)
    return [f"{title}. {text}"] if text else [], [], title


SCRAPERS: dict[str, Callable] = {"BSoup": scrape_soup, "Readability": scrape_readability, "Newspaper": scrape_newspaper}
DEFAULT_SCRAPER = "Readability"


def scraper(name: str | None) -> tuple[str, Callable]:
    """A registered scraper by name, or by a name that starts with one; without a name the default."""
    if not name:
        return DEFAULT_SCRAPER, SCRAPERS[DEFAULT_SCRAPER]
    for known, function in SCRAPERS.items():
        if name.startswith(known):
            return known, function
    raise KeyError(f"no such scraper: {name}")


PAGE_DDL = "url string, parser string, title string, text array<string>, highlighted_strings array<string>, links array<string>, metadata map<string,array<string>>, keywords array<string>, date timestamp, charset string, reason string"


_LISTED = pa.list_(pa.string())
_TYPES = [pa.string(), pa.string(), pa.string(), _LISTED, _LISTED, _LISTED, pa.map_(pa.string(), _LISTED), _LISTED, pa.timestamp("us", tz="UTC"), pa.string(), pa.string()]
FIELDS = dict(zip([f.split()[0] for f in PAGE_DDL.split(", ")], _TYPES, strict=True))


class Page:
    """A page of HTML; each of FIELDS is worked out when it is asked for, and not before."""

    def __init__(self, url: str | None, html: str | None, kind: str, function: Callable, clock: datetime, with_links: bool = True, fuzzy_date: bool = True) -> None:
        self.url, self.parser, self._function, self._clock, self._with_links, self._fuzzy = url, kind, function, clock, with_links, fuzzy_date
        self._root = parse(" ".join((html or "").split()))

    @cached_property
    def _texts(self) -> tuple:
        return self._function(self._root)

    @cached_property
    def _meta(self) -> dict:
        return metadata_of(self._root)

    text = property(lambda self: self._texts[0])
    highlighted_strings = property(lambda self: self._texts[1])
    title = property(lambda self: title_of(self._root))
    links = property(lambda self: links_of(self._root, self.url or "") if self._with_links else [])
    metadata = property(lambda self: list(self._meta.items()))
    keywords = property(lambda self: self._meta.get("keywords", []))
    date = property(lambda self: date_of(self._root, self._clock, self._fuzzy))
    reason = property(lambda self: None if self.text else "no text")

    @property
    def charset(self) -> str:
        kind_of = " ".join(self._meta.get("content-type", [])).lower()
        return kind_of.split("charset=", 1)[1].strip() if "charset=" in kind_of else "utf-8"


def page_ddl(fields: Sequence[str]) -> str:
    """The schema of these fields, in this order."""
    if unknown := [f for f in fields if f not in FIELDS]:
        raise ValueError(f"no such fields of a page: {', '.join(unknown)}")
    kinds = dict(x.split(" ", 1) for x in PAGE_DDL.split(", "))
    return ", ".join(f"{f} {kinds[f]}" for f in fields)


def scrape(pages: DataFrame, name: str | None = None, now: datetime | None = None, with_links: bool = True, fuzzy_date: bool = True, fields: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """A row for each page (url, html), scraped, with these fields; reason says why a page has no text, and is null otherwise.

    Only what the fields need is worked out. The clock is read once, for all rows, so that a task run
    again gives the same rows.
    """
    kind, function = scraper(name)
    clock = now or datetime.now(UTC).replace(tzinfo=None)
    ddl, names = page_ddl(fields), list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(url, html, kind, function, clock, with_links, fuzzy_date)
                for col, f in zip(cols, names, strict=True):
                    col.append(getattr(page, f))
            yield pa.RecordBatch.from_arrays([pa.array(c, FIELDS[f]) for c, f in zip(cols, names, strict=True)], names=names)

    return pages.select("url", "html").mapInArrow(run, ddl)


class ParsePage:
    """The table function parse_page(html, url, fields): one row with the fields, a constant list of names separated by commas."""

    @staticmethod
    def analyze(html: AnalyzeArgument, url: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
        if not fields.isConstantExpression or not fields.value:
            raise ValueError("parse_page: fields must be a constant text, such as 'title,links'")
        names = [f.strip() for f in fields.value.split(",")]
        page_ddl(names)
        words = ArrayType(StringType())
        kinds = {pa.string(): StringType(), _LISTED: words, pa.map_(pa.string(), _LISTED): MapType(StringType(), words), pa.timestamp("us", tz="UTC"): TimestampType()}
        return AnalyzeResult(StructType([StructField(f, kinds[FIELDS[f]]) for f in names]))

    def eval(self, html: str, url: str, fields: str) -> Iterator[tuple]:
        page = Page(url, html, *scraper("BSoup"), datetime.now(UTC).replace(tzinfo=None))
        values = [getattr(page, f.strip()) for f in fields.split(",")]
        yield tuple(dict(v) if f.strip() == "metadata" else v for v, f in zip(values, fields.split(","), strict=True))


def register_parse_page(spark: SparkSession, name: str = "parse_page") -> None:
    """Makes parse_page known to SQL: SELECT url, t.* FROM pages, LATERAL parse_page(html, url, 'title,links') t."""
    spark.udtf.register(name, F.udtf(ParsePage))


# The same by column expressions, where they suffice


def link_column(url: Column, html: Column) -> Column:
    """Absolute URLs in the HTML and targets of its anchors, made absolute where built-ins can, without fragments, distinct, sorted."""
    anchors = F.transform(urls.anchor_targets(html), lambda h: urls.join_simple(url, h))
    found = F.concat(F.regexp_extract_all(html, F.lit(urls.ABSOLUTE_URL), F.lit(1)), anchors)
    return F.array_sort(F.array_distinct(F.transform(found, urls.without_fragment)))


def title_column(html: Column) -> Column:
    got = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(got != "", F.trim(got))


def literal_references(html: Column) -> Column:
    """The HTML with references that lack their semicolon (&amp and the like, as a cut text may end) as plain text, where a parser would read them."""
    return F.regexp_replace(html, r"&(?=#?[A-Za-z0-9]++(?!;))", "&amp;")


def kept_texts(text: Column, cutoff: float = JUNK_CUTOFF) -> Column:
    """Array elements longer than cutoff of the longest."""
    longest = F.array_max(F.transform(text, lambda t: F.length(t)))
    return F.filter(text, lambda t: (longest > 0) & (F.length(t) > longest * cutoff))


def kept_highlights(highlights: Column, text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(highlights, lambda h: F.exists(text, lambda t: F.contains(t, h)))))
