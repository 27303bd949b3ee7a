"""Main text of HTML pages: site templates found by counting element subtrees per host, and the rest by what elements are.

Subtrees are hashed twice. With its text, a subtree that recurs is a notice, a footer or a button. Without it, by place, tags and names, with
runs of equal children folded, one that recurs is a list of links whose texts differ from page to page: only subtrees of which half or
more is link text count so, as articles recur in shape, too.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .shared import BROADCAST_ROWS, Scratch, named, small_batches
from .urls import host_of

#: A subtree is a template's if it is on so many different pages of a host and on so large a part of them. On fewer pages chance
#: repeats can't be told from templates.
LEAST_PAGES, LEAST_SHARE = 12, 0.5
#: The part of a subtree's text that links hold where it counts by its shape; the part of a page's paragraphs that articles hold at least.
LINK_SHARE, ARTICLE_SHARE = 0.5, 0.25

#: Elements of HTML by how they are read.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "noframes", "iframe"))
BLOCKS = frozenset(
    (
        "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
        "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li",
        "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
    )
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that count by their shape: in an article only boxes, as its lists and tables are its own.
BOXES = frozenset(("aside", "div", "menu", "nav", "section"))
CONTAINERS = BOXES | frozenset("dl footer header ol table ul".split())
#: What is no text whatever it is called.
NO_TEXT = frozenset(
    (
        "canvas", "embed", "frameset", "head", "iframe", "noframes", "noscript", "object", "script", "style", "svg", "template", "title",
    )
)
DROPPED = frozenset(
    (
        "applet", "aside", "audio", "button", "canvas", "dialog", "embed", "footer", "form", "frameset", "head", "iframe", "input", "map",
        "menu", "nav", "noframes", "noscript", "object", "script", "select", "style", "svg", "template", "textarea", "title", "video",
    )
)
ROLES = frozenset(
    (
        "alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search",
        "toolbar",
    )
)
#: Words of a class or id that name what is not the article.
NAMES = frozenset(
    (
        "ad", "ads", "advert", "advertisement", "advertisements", "advertising", "adverts", "banner", "breadcrumb", "breadcrumbs",
        "comment", "comments", "cookie", "cookies", "consent", "disqus", "gdpr", "masthead", "menu", "modal", "nav", "navbar",
        "navigation", "newsletter", "notice", "notices", "pagination", "pager", "popup", "promo", "related", "share", "sharing",
        "sidebar", "sidebars", "sitefooter", "siteheader", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
    )
)
#: Words that may stand beside those in one name (comment-list, site-footer); any other word makes it another name (has-comments).
PARTS = frozenset(
    (
        "area", "bar", "block", "box", "button", "buttons", "container", "footer", "form", "header", "heading", "icons", "inner", "item",
        "items", "link", "links", "list", "post", "posts", "signup", "site", "slot", "title", "unit", "wrap", "wrapper",
    )
)
KNOWN = NAMES | PARTS
#: Of these names an article is none, if the page has another; elements of the first three hold no article but comments.
COMMENTS = frozenset(("comment", "comments", "disqus"))
NO_ARTICLE = COMMENTS | frozenset("ad ads advert advertisement advertisements advertising adverts".split())
#: A start tag on the left ends an open element on the right, up to the element after it.
ENDS = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: What a head can hold; any other element, and text, ends a head that is open.
IN_HEAD = frozenset(
    (
        "base", "basefont", "bgsound", "head", "link", "meta", "noframes", "noscript", "script", "style", "template", "title",
    )
)
#: What an article's own header keeps: its headings and leading paragraphs.
IN_HEADER = HEADINGS | frozenset("div header hgroup p".split())
KEEPS_P = frozenset(
    (
        "body", "html", "caption", "dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "summary", "legend", "figcaption",
    )
)

MASK = (1 << 64) - 1
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
NAME = re.compile(r"[a-z]+")


class Element:
    """An element of a page: its tag, the attributes that say what it is for, and its children (elements and decoded text)."""

    __slots__ = ("tag", "names", "named", "off", "children", "mark", "shape", "chars", "links")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children = tag, []
        self.mark = self.shape = self.chars = self.links = 0
        self.names: frozenset[str] = frozenset()
        #: The words of NAMES in those classes and ids that hold no words but NAMES and PARTS.
        self.named: frozenset[str] = frozenset()
        self.off = False
        if attributes.strip(" \t\n\r\f/"):
            names, named = [], set()
            for key, a, b, c in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), unescape(a or b or c)
                if key in ("class", "id"):
                    for token in value.lower().split():
                        words = NAME.findall(token)
                        names += words
                        if KNOWN.issuperset(words):
                            named |= NAMES.intersection(words)
                elif key == "role" and value.strip().lower() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
                    self.off = True
            self.names, self.named = frozenset(names), frozenset(named)


class Open:
    """The elements that are open, and how many of each tag, so that none is looked for in a deep page that is not there."""

    def __init__(self, root: Element):
        self.elements, self.tags = [root], Counter()

    def open(self, element: Element) -> None:
        self.elements.append(element)
        self.tags[element.tag] += 1

    def cut(self, at: int) -> None:
        self.tags.subtract(e.tag for e in self.elements[at:])
        del self.elements[at:]

    def close(self, tags, until) -> None:
        """Ends the nearest open element of these tags, unless one of `until` is open inside it."""
        if not any(self.tags[t] for t in tags):
            return
        for k in range(len(self.elements) - 1, 0, -1):
            tag = self.elements[k].tag
            if tag in tags:
                return self.cut(k)
            if tag in until:
                return


def parse(html: str) -> Element:
    """The tree of a page. Missing end tags are taken as browsers do for the elements of running text; what is open at the end closes."""
    root = Element("#page")
    stack, at, end = Open(root), 0, len(html)
    while at < end:
        m = MARKUP.search(html, at)
        if m is None:
            break
        if m.start() > at:
            _text_in(stack, html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            stack.close((tag,), ())
            continue
        attributes = m[3] or m[6] or ""
        if tag == "body":
            stack.close(("head",), ("body",))
        elif stack.elements[-1].tag == "head" and tag not in IN_HEAD:
            stack.cut(-1)
        if tag in BLOCKS and tag not in KEEPS_P:
            stack.close(("p",), ("table", "td", "button"))
        if tag in ENDS:
            stack.close(ENDS[tag][0].split(), ENDS[tag][1])
        element = Element(tag, attributes)
        stack.elements[-1].children.append(element)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>|\Z", re.I).search(html, at)
            if tag in ("title", "textarea"):
                element.children.append(unescape(html[at : close.start()]))
            at = close.end()
        elif tag not in VOID and not (attributes.endswith("/") and tag == "svg"):
            stack.open(element)
    if at < end:
        _text_in(stack, html[at:])
    return root


def _text_in(stack: Open, text: str) -> None:
    if stack.elements[-1].tag == "head" and not text.isspace():
        stack.cut(-1)
    stack.elements[-1].children.append(unescape(text))


def _down(root: Element) -> list[Element]:
    """Elements before all elements that they hold."""
    todo, out = [root], []
    while todo:
        e = todo.pop()
        out.append(e)
        todo += [c for c in e.children if isinstance(c, Element)]
    return out


def _walk(root: Element):
    """Elements after all elements that they hold."""
    return reversed(_down(root))


def _hash(text: str) -> int:
    return xxh64_intdigest(text.encode("utf-8", "replace"))


def _mixed(h: int, part: int) -> int:
    """A hash of a row of numbers, one after the other."""
    h = (h ^ part) * 0x9E3779B97F4A7C15 & MASK
    return h ^ h >> 29


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def mark(root: Element, texts: bool = True) -> list[int]:
    """Hashes every element's subtree and returns the different hashes of those with text: by text for all, by shape for lists of links.

    By text: tag, names and text, white space aside; the lowest bit is 1. By shape: the way down to it, and tags and names inside,
    where runs of equal children are one; the lowest bit is 0, and 0 stands for a subtree that does not count so.
    texts: without, only shapes are hashed.
    """
    down = _down(root)
    inner: dict[Element, int] = {}
    kinds: dict[tuple, int] = {}
    for e in reversed(down):
        kind = e.tag, e.names
        h = kinds.get(kind)
        if h is None:
            h = kinds[kind] = _hash(" ".join([e.tag, *sorted(e.names)]))
        text = shape = h
        chars = links = last = 0
        for c in e.children:
            if isinstance(c, Element):
                if texts:
                    text = _mixed(text, c.mark & MASK)
                chars += c.chars
                links += c.links
                if last != inner[c]:
                    last = inner[c]
                    shape = _mixed(shape, last)
            elif words := c.split():
                plain = " ".join(words)
                if texts:
                    text = _mixed(text, _hash(plain))
                chars += len(plain)
        e.chars, e.links = chars, chars if e.tag == "a" else links
        # without any text there is nothing to delete
        e.mark = _signed(text & ~1 | (chars > 0))
        inner[e] = shape
    found = set()
    place = {root: (0, False)}
    for e in down:
        if not e.chars:
            continue
        way, inside = place[e]
        if texts:
            found.add(e.mark)
        if e.tag in (BOXES if inside else CONTAINERS) and e.links >= LINK_SHARE * e.chars:
            e.shape = _signed(_mixed(way, inner[e]) & ~1)
            found.add(e.shape)
        below = (_mixed(way, kinds[e.tag, e.names]), inside or e.tag in ("article", "main"))
        for c in e.children:
            if isinstance(c, Element):
                place[c] = below
    return sorted(found)


def _pruned(root: Element, templates) -> None:
    """Takes out the subtrees that are templates by their shape."""
    for e in _down(root):
        if any(isinstance(c, Element) and c.shape and c.shape in templates for c in e.children):
            e.children = [c for c in e.children if not (isinstance(c, Element) and c.shape and c.shape in templates)]


def _wanted(e: Element, inside: bool, kept=frozenset()) -> bool:
    return not (e.tag in DROPPED or e.off or e.named and e.tag not in ("body", "html") and (inside or e.tag not in ("article", "main")) and e not in kept)


def _holders(root: Element, comments: bool) -> set[Element]:
    """Articles and main elements, and all elements around them; if not comments, none in an element that its name calls comments."""
    kept = set()
    for e in _walk(root):
        if e.tag in ("article", "main"):
            kept.add(e)
        elif (comments or not e.named & COMMENTS) and any(c in kept for c in e.children if isinstance(c, Element)):
            kept.add(e)
    return kept


def _articles(root: Element) -> tuple[list[Element], set[Element]]:
    """The outermost articles that no dropped element holds; else the main elements, else the page; and what no name drops in them.

    A page with an article outside of all named elements has other articles in these (comments, related ones). On a page without,
    no name drops an article, a main element or what holds one.
    """
    kept: set[Element] = set()
    for tag, but in (("article", NO_ARTICLE), ("main", frozenset())):
        found, todo = [], [root]
        while todo:
            e = todo.pop()
            if e.tag == tag and not e.named & but and not e.off:
                found.append(e)
            elif _wanted(e, False, kept):
                todo += [c for c in reversed(e.children) if isinstance(c, Element)]
        if found:
            return found, kept
        kept = kept or _holders(root, False)
    return [root], kept


def _teasers(root: Element, articles: list[Element], kept: set[Element]) -> bool:
    """Whether articles hold a small part of the page's paragraphs only, so that they are not what the page is about."""
    own, todo, others = {*articles}, [root], []
    while todo:
        e = todo.pop()
        if e.tag == "p":
            others.append(e)
        elif e not in own:
            todo += [c for c in e.children if isinstance(c, Element) and (c in own or c.tag != "article" and _wanted(c, False, kept))]
    outside = 0
    for p in others:
        words = len(_text([p], kept))
        outside += words * (sum(len(_text([x], kept)) for x in _down(p) if x.tag == "a") < LINK_SHARE * words)
    if not outside:
        return False
    inside = sum(len(_text([x], kept)) for e in articles for x in _down(e) if x.tag == "p")
    return inside < ARTICLE_SHARE * (inside + outside)


def _article(root: Element, lists: bool = True) -> tuple[list[Element], set[Element], str]:
    """The page's articles, what no name drops in them, and their text with no template deleted."""
    if not lists:
        return [root], set(), _text([root], set(), lists=False)
    articles, kept = _articles(root)
    if articles[0].tag == "article" and _teasers(root, articles, kept):
        articles, kept = [root], set()
    text = _text(articles, kept)
    if not text:
        # if names alone leave nothing, they do not hold for what holds an article
        kept = _holders(root, True)
        text = _text(articles, kept)
    return articles, kept, text


def article_text(html: str, templates: frozenset[int] | set[int] = frozenset(), lists: bool = True) -> str:
    """The article's blocks, one a line. templates: hashes of subtrees to delete; an article itself is never deleted.

    Nor is anything in articles of which templates are the greater part: these recur as near copies. What is left as the article is
    looked for once lists of links are gone. If templates are all of a page, they are no templates there.
    lists: without them, only templates are deleted, and no element goes for what it is or is called.
    """
    root = parse(html)
    texts = any(t & 1 for t in templates)
    if templates:
        mark(root, texts)
        _pruned(root, templates)
    articles, kept, text = _article(root, lists)
    if not templates:
        return text
    rest = _text(articles, kept, templates, lists) if texts else text
    if not rest:
        return article_text(html, lists=lists)
    return text if articles[0].tag == "article" and 2 * len(rest) <= len(text) else rest


def _text(articles: list[Element], kept: set[Element], templates: frozenset[int] | set[int] = frozenset(), lists: bool = True) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def flush():
        if words := "".join(line).split():
            blocks.append(" ".join(words))
        line.clear()

    for article in articles:
        todo = [iter(article.children)]
        open_ = [article]
        flush()
        while todo:
            for c in todo[-1]:
                if not isinstance(c, Element):
                    if not lists or open_[-1].tag != "header":
                        line.append(c)
                    continue
                if c.tag == "br":
                    line.append(" ")
                    continue
                if c.tag in BLOCKS:
                    flush()
                in_head = lists and open_[-1].tag == "header" and c.tag not in IN_HEADER
                if (_wanted(c, True, kept) if lists else c.tag not in NO_TEXT) and not (templates and c.mark in templates) and not in_head:
                    todo.append(iter(c.children))
                    open_.append(Element("header") if open_[-1].tag == "header" and c.tag not in HEADINGS | {"p"} else c)
                    break
            else:
                todo.pop()
                if open_.pop().tag in BLOCKS:
                    flush()
        flush()
    return "\n".join(blocks)


def _marks(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(host, page, marks): each page's subtree hashes, and the hash of its article's text, by which pages are told apart."""

    def run(batches):
        for batch in batches:
            page, marks = [], []
            for text in batch.column(1).to_pylist():
                root = parse(text or "")
                marks.append(mark(root))
                page.append(_signed(_hash(_article(root)[2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(page, pa.int64()), pa.array(marks, pa.list_(pa.int64()))], names=["host", "page", "marks"])

    return pages.select(F.col(host).alias("host"), F.col(html).alias("html")).mapInArrow(run, "host string, page long, marks array<bigint>")


def site_templates(pages: DataFrame, scratch: Scratch, host: str = "host", html: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, templates): the subtrees that recur across a host's pages, at least least_pages and least_share of them.

    Pages with the same article count once, whatever is around it. Counts are summed on the map side first, so that a large host
    is no single task's work. At most 1 / least_share times the subtrees of a mean page pass, so that a host's list is bounded.
    """
    marks = scratch.keep(_marks(pages, host, html), "marks")
    different = marks.select("host", "page", F.explode("marks").alias("mark")).distinct()
    sizes = marks.groupBy("host").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= least_pages)
    counts = different.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    common = scratch.keep(counts, "common")
    found = common.join(scratch.keep(sizes, "hosts"), "host").where(F.col("n") >= least_share * F.col("pages"))
    return found.groupBy("host").agg(F.collect_set("mark").alias("templates"))


def main_text(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text", n_chars: str = "n_chars", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, lists: bool = True) -> DataFrame:
    """Adds the main text of each page's whole html, and its code points.

    Subtrees that are the host's template, on least_pages and least_share of its pages, go first. Of the rest
    the article is kept without menus, headers (but for headings and paragraphs in the article), footers, sidebars, notices, adverts, forms, scripts,
    styles and reader comments; if not lists, all of the rest. Character references are decoded; white
    space inside a block is one space; blocks are trimmed and joined in page order by one newline. A null page is empty. Rows
    stay and other columns pass; a column of the input that has the name of a new one is replaced. Rows without a host share
    the host ''.
    """
    spark = pages.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    kept = [c for c in pages.columns if c.lower() not in {text.lower(), n_chars.lower()}]
    carried = kept if html in kept else [*kept, html]
    host = named("host", pages.columns)
    own = pages.withColumn(host, host_of(F.col(url)))
    templates = scratch.keep(site_templates(own, scratch, host, html, least_pages, least_share), "templates")
    few = templates.count()
    right = templates.withColumnRenamed("host", "t_host").withColumnRenamed("templates", named("t_marks", pages.columns))
    t_host = named("t_host", pages.columns)
    right = right.withColumnRenamed("t_host", t_host)
    # a row is a host's list, of some hundred hashes at most
    right = F.broadcast(right) if few <= BROADCAST_ROWS // 200 else right
    rows = own.join(right, own[host] == right[t_host], "left").select(*carried, named("t_marks", pages.columns))
    at = carried.index(html)

    def run(batches):
        for batch in batches:
            marks = batch.column(len(carried)).to_pylist()
            texts = [article_text(h or "", frozenset(t or ()), lists) for h, t in zip(batch.column(at).to_pylist(), marks, strict=True)]
            out = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], out, pc.cast(pc.utf8_length(out), pa.int64())], names=[*kept, text, n_chars])

    schema = pages.select(*kept).schema.add(text, "string", False).add(n_chars, "long", False)
    return rows.mapInArrow(run, schema)
